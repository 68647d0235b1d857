"""Names in texts by one automaton, whatever their number: where each occurs, and which a text names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_held: dict[str, ahocorasick.Automaton] = {}


def _automaton(names: dict[str, str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for order, name in enumerate(sorted(names, key=len, reverse=True)):
        if name:
            made.add_word(name, (order, name))
    made.make_automaton()
    return made


def places(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """Start, end and name of every occurrence, also inside another."""
    return [(end + 1 - len(name), end + 1, name) for end, (_, name) in automaton.iter(text)] if len(automaton) else []


def taken(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """Occurrences when longer names are taken out of the text before shorter ones are sought, from left to right, in that order."""
    if not len(automaton):
        return []
    found = sorted((order, end + 1 - len(name), name) for end, (order, name) in automaton.iter(text))
    free, out = bytearray(len(text)), []
    for _, start, name in found:
        end = start + len(name)
        if 1 not in free[start:end]:
            free[start:end] = b"\x01" * len(name)
            out.append((start, end, name))
    return out


def _without(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a space for each span."""
    for start, end, _ in sorted(spans, reverse=True):
        text = f"{text[:start]} {text[end:]}"
    return text


class Names:
    """Names with what each stands for, sent to the tasks once. As column functions these give what the chained ones in routing give, in one pass over a text."""

    def __init__(self, spark: SparkSession, codes: dict[str, str]):
        self.codes_of = {n: c for n, c in codes.items() if n}
        self._sent = spark.sparkContext.broadcast((uuid.uuid4().hex, self.codes_of))

    def _each(self, f, kind: str):
        sent = self._sent

        @F.pandas_udf(kind)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            key, codes = sent.value
            if key not in _held:  # a worker holds one
                _held.clear()
                _held[key] = _automaton(codes)
            for texts in parts:
                yield pd.Series([None if t is None else f(_held[key], codes, t) for t in texts], dtype=object)

        return run

    def codes(self, text: Column) -> Column:
        """What the text names, once each, longer names first."""
        return self._each(lambda a, codes, t: list(dict.fromkeys(codes[n] for _, _, n in taken(a, t))), "array<string>")(text)

    def first(self, text: Column) -> Column:
        """What the longest name stands for, or null."""
        return self._each(lambda a, codes, t: next((codes[n] for _, _, n in taken(a, t)), None), "string")(text)

    def bare(self, text: Column) -> Column:
        """The text with a space for each name."""
        return self._each(lambda a, codes, t: _without(t, taken(a, t)), "string")(text)

    def with_articles(self, text: Column, pattern: str) -> Column:
        """What the text names, each with each article number that the pattern finds outside of the names."""
        found = re.compile(pattern, re.A)

        def join(a, codes, t):
            spans = taken(a, t)
            bare = _without(t, spans)
            numbers = [m[1].replace(" ", "").replace("之", "-") for m in found.finditer(bare)]
            return [f"{c}-{n}" for c in dict.fromkeys(codes[n] for _, _, n in spans) for n in numbers]

        return self._each(join, "array<string>")(text)

    def offsets(self, text: Column) -> Column:
        """Every occurrence: start and end in characters from 0, and what its name stands for."""
        sent = self._sent

        @F.arrow_udf("array<struct<start: int, end: int, code: string>>")
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            key, codes = sent.value
            if key not in _held:
                _held.clear()
                _held[key] = _automaton(codes)
            for texts in parts:
                ends, found = [0], []
                for t in texts.to_pylist():
                    found += places(_held[key], t) if t else []
                    ends.append(len(found))
                fields = {"start": pa.array([s for s, _, _ in found], pa.int32()), "end": pa.array([e for _, e, _ in found], pa.int32()), "code": pa.array([codes[n] for _, _, n in found], pa.string())}
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=texts.is_null())

        return run(text)
