"""Settings of a run from the Spark session, and the models that it names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Each comes from spark.corpuswright.<name>, or has its default."""

    mode: str = "current_baseline"
    shadow: bool = False
    execute_refinement: bool = False
    max_refinements: int = 1
    max_total_tokens: int = 16_000
    trace_sample_rate: float = 1.0
    redact: bool = False
    answerer: str = "extractive"
    embedder: str = "hashed"

    def __post_init__(self) -> None:
        if self.max_refinements not in (0, 1):
            raise ValueError("max_refinements has to be 0 or 1")
        if self.max_total_tokens <= 0:
            raise ValueError("max_total_tokens has to be positive")
        if self.execute_refinement and not self.shadow:
            raise ValueError("a shadow refinement needs the shadow mode")

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        found = {}
        for f in fields(Settings):
            text = spark.conf.get(f"spark.corpuswright.{f.name}", None)
            if text is not None:
                found[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if f.type == "bool" else {"int": int, "float": float, "str": str}[f.type](text)
        return Settings(**found)


class Models:
    """Callables by kind and name; a name that isn't registered is an error that lists those that are."""

    def __init__(self):
        self._known: dict[tuple[str, str], Callable] = {}

    def register(self, kind: str, name: str, model: Callable) -> None:
        self._known[kind, name] = model

    def get(self, kind: str, name: str) -> Callable:
        if (kind, name) not in self._known:
            raise LookupError(f"no {kind} {name!r}; there are {sorted(n for k, n in self._known if k == kind)}")
        return self._known[kind, name]


def default_models() -> Models:
    from ..operators.retrieval import hashed_vectors
    from .pipeline import extractive

    out = Models()
    out.register("answerer", "extractive", extractive)
    out.register("embedder", "hashed", hashed_vectors)
    return out
