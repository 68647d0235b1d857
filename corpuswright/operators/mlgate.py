"""The linear gate: a standardised logistic model by full-batch gradient descent on a small labelled set."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import fixed
from . import gate
from .metrics import binary_metrics


@dataclass(frozen=True)
class LinearGate:
    intercept: float
    coefficients: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    training_count: int
    positive_count: int
    version: str = "linear-gate-1"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> LinearGate:
        return LinearGate(**json.loads(text))

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("risk", gate.risk(self.intercept, self.coefficients, self.means, self.scales))


def fitted(x: np.ndarray, y: np.ndarray, epochs: int = 2000, rate: float = 0.05, l2: float = 0.01) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Intercept, weights, means and scales (population deviation, 1e-6 at least)."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    b = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-np.clip(b + z @ w, -500, 500))) - y
        b -= rate * error.mean()
        w = w - rate * (z.T @ error / len(y) + l2 * w)
    return b, w, mean, scale


def descended(rows: DataFrame, features, label: str = "__y", epochs: int = 2000, rate: float = 0.05, l2: float = 0.01, near: float = 0.0) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """What fitted() gives, on rows of any number: each epoch sends the weights to the tasks, which sum the gradients of their rows. It ends after `epochs`, or when no weight moves by more than `near`.

    rows' features and label are written once, a task holds a batch at a time, and what comes back is a row a task.
    """
    spark, d = rows.sparkSession, len(features)
    held = fixed(rows.select(*[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("y")))
    moments = held.agg(F.count(F.lit(1)), F.avg("y"), *[F.avg(f"x{k}") for k in range(d)], *[F.stddev_pop(f"x{k}") for k in range(d)]).first()
    n, share = moments[0], min(max(moments[1], 1e-6), 1 - 1e-6)
    mean, scale = np.array(moments[2 : 2 + d], float), np.maximum(np.array(moments[2 + d :], float), 1e-6)
    b, w = float(np.log(share / (1 - share))), np.zeros(d)
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast((b, w))

        def gradient(batches, sent=sent):
            b, w = sent.value
            total = np.zeros(d + 1)
            for batch in batches:
                z = (np.column_stack([batch.column(k).to_numpy() for k in range(d)]) - mean) / scale
                error = 1 / (1 + np.exp(-np.clip(b + z @ w, -500, 500))) - batch.column(d).to_numpy()
                total += [error.sum(), *(z.T @ error)]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

        g = np.sum([r.g for r in held.mapInArrow(gradient, "g array<double>").collect()], axis=0) / n
        sent.destroy()
        step = rate * np.array([g[0], *(g[1:] + l2 * w)])
        b, w = b - step[0], w - step[1:]
        if np.abs(step).max() <= near:
            break
    return b, w, mean, scale


def train(rows: DataFrame, features=gate.FEATURES, label: str = "label", most: int = 10_000, **settings) -> LinearGate:
    """At least 40 labelled rows of both classes. Up to `most` are fitted on the driver; more are not moved, and each epoch sums their gradients where they are, by the same steps."""
    data = rows.filter(F.col(label).isNotNull()).select(*features, F.col(label).cast("double").alias("__y"))
    seen = data.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("positive"), F.count_distinct("__y").alias("classes")).first()
    if seen.n < 40:
        raise ValueError("at least 40 labelled rows are needed")
    if seen.classes < 2:
        raise ValueError("labels of both classes are needed")
    if seen.n <= most:
        some = data.toPandas()
        b, w, mean, scale = fitted(some[list(features)].to_numpy(float), some["__y"].to_numpy(), **settings)
    else:
        b, w, mean, scale = descended(data, features, **settings)
    named = lambda v: {f: float(x) for f, x in zip(features, v)}
    return LinearGate(float(b), named(w), named(mean), named(scale), seen.n, int(seen.positive))


def out_of_fold(rows: DataFrame, order: str, features=gate.FEATURES, label: str = "label", folds: int = 5, epochs: int = 1000, most: int = 10_000, seed: int = 7) -> DataFrame:
    """rows with fold and the risk that a model of the other folds gives. A fold is the row's place by `order` modulo folds; each fold's fit is a task.

    All rows get a risk. The models are fitted on the `most` rows that the seed puts first, those of the other folds, as a fit holds its rows in memory.
    """
    from .sampling import sample
    from .windows import place

    placed = place(rows, order).withColumn("fold", (F.col("place") % folds).cast("int")).drop("place")
    held = sample(placed.filter(F.col(label).isNotNull()), order, most, seed).select(*features, F.col(label).cast("double").alias("__y"), F.col("fold").alias("__of"))
    dealt = held.withColumn("__fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("__of <> __fold")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        b, w, mean, scale = fitted(part[list(features)].to_numpy(float), part["__y"].to_numpy(), epochs=epochs)
        return pd.DataFrame({"__fold": [part["__fold"].iloc[0]], "__b": [b], "__w": [w], "__mean": [mean], "__scale": [scale]})

    models = dealt.groupBy("__fold").applyInPandas(fit, "__fold int, __b double, __w array<double>, __mean array<double>, __scale array<double>")
    z = F.col("__b")
    for k, f in enumerate(features):
        z = z + F.col("__w")[k] * (F.col(f) - F.col("__mean")[k]) / F.col("__scale")[k]
    return placed.join(F.broadcast(models), F.col("fold") == F.col("__fold"), "left").select(*placed.columns, gate.sigmoid(z).alias("risk"))


def evaluate(rows: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Binary metrics of risk >= threshold, and the Brier score."""
    flagged = rows.withColumn("__p", F.col("risk") >= threshold)
    return binary_metrics(flagged, F.col(label), F.col("__p"), F.avg(F.pow(F.col("risk") - F.col(label).cast("double"), 2)).alias("brier_score"))
