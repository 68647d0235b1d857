"""A vector index below a path: cells around centroids, searched exactly by the triangle inequality or by the nearest cells alone.

Centroids come from k-means on a bounded sample; every vector is assigned to its nearest, and a cell is a folder. An exact
search reads each question's nearest cells first. How far its worst kept neighbour is then rules out every cell whose
nearest possible vector is farther: its centroid's distance less its radius. A probing search reads the nearest cells only.
Distances are between directions, so that their order is that of the cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import fixed
from .retrieval import CELLS, TOP, best_of, lengths_of, matrix_of, ranked, similarities

#: Vectors that centroids are made from and, of these, the ones that probes are tuned by.
SAMPLE, ASKED = 20_000, 500


def directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between directions, a row for each of a."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def kmeans(points: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of unit length; a cell that loses all its points takes one of the farthest."""
    r = np.random.default_rng(seed)
    centroids = points[np.sort(r.choice(len(points), min(cells, len(points)), replace=False))]
    for _ in range(rounds):
        near = distances(points, centroids)
        own = near.argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        empty = np.flatnonzero(np.sqrt((sums * sums).sum(axis=1)) < 1e-9)
        sums[empty] = points[np.argsort(-near.min(axis=1), kind="stable")[: len(empty)]]
        moved = directions(sums)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def usable(corpus: DataFrame) -> DataFrame:
    """doc_id and vector of the rows that a cosine is defined for: not null, finite and not all zeros."""
    v = F.col("vector").cast("array<double>")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return corpus.select("doc_id", v.alias("vector")).filter(F.col("vector").isNotNull()).filter(~odd & F.exists("vector", lambda x: x != 0))


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    @functools.cached_property
    def head(self) -> dict[str, np.ndarray]:
        """Cells with their centroids, radii and sizes, as arrays: cells of them, whatever the number of vectors."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return {"cell": np.array([r.cell for r in rows], int), "centroid": np.array([r.centroid for r in rows]).reshape(len(rows), len(rows[0].centroid) if rows else 1), "radius": np.array([r.radius for r in rows]), "reach": np.array([r.reach for r in rows], int)}

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def probes(self) -> int:
        """The number of cells that a probing search reads, as it was tuned when the index was built."""
        return int(self.head["reach"][0]) if len(self.head["reach"]) else 1


def build(corpus: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, recall: float = 0.95, seed: int = 1) -> VectorIndex:
    """Writes an index of corpus (doc_id, vector). Vectors without a direction are left out.

    Centroids are of the `sample` vectors that a hash puts first; cells: as many as the root of the number of vectors if not
    given, 4096 at most. Probes are tuned so that `recall` of some sample vectors' neighbours in the sample are reached.
    """
    rows = usable(corpus)
    some = rows.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "doc_id").limit(sample).select("vector").collect()
    n = rows.count() if cells is None else 0
    points = directions(np.array([r.vector for r in some])) if some else np.zeros((0, 1))
    centroids = kmeans(points, cells or min(4096, max(1, round(n**0.5))), seed=seed) if some else points
    reach = tuned(points, centroids, recall)

    def assign(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, CELLS // max(1, len(centroids)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                if batch.num_rows:
                    near = distances(directions(matrix_of(batch.column(1))), centroids)
                    own = near.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(near[np.arange(len(own)), own])], ["doc_id", "vector", "cell", "far"])

    dealt = rows.mapInArrow(assign, f"doc_id {dict(rows.dtypes)['doc_id']}, vector array<double>, cell int, far double")
    # large cells are split into several files
    dealt.hint("rebalance", "cell").write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/cells")
    spark = corpus.sparkSession
    if some:
        known = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
        size = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
        known.join(size, "cell").withColumn("reach", F.lit(reach)).coalesce(1).write.parquet(f"{path}/centroids")
    else:
        spark.createDataFrame([], "cell int, centroid array<double>, radius double, n long, reach int").write.parquet(f"{path}/centroids")
    return VectorIndex(spark, path)


def tuned(points: np.ndarray, centroids: np.ndarray, recall: float, top: int = TOP) -> int:
    """How many cells hold `recall` of the neighbours of sample vectors, in the order of their distance."""
    if len(points) < 2:
        return 1
    asked = points[:ASKED]
    near = distances(asked, points)
    near[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    neighbours = np.argsort(near, axis=1, kind="stable")[:, : min(top, len(points) - 1)]
    own = distances(points, centroids).argmin(axis=1)
    place = np.argsort(np.argsort(distances(asked, centroids), axis=1, kind="stable"), axis=1, kind="stable")
    return int(np.quantile(np.take_along_axis(place, own[neighbours], axis=1), recall, method="higher")) + 1


def search(index: VectorIndex, queries: DataFrame, top: int = TOP, probes: int | None = None, ahead: int = 4, skip_self: bool = False, most_bytes: int = 32 << 20, seen: list | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by cosine. queries: query_id, qvector. probes: the number of nearest cells that are read; without it the result is exact, equal to retrieval.dense.

    Queries without a direction have no hit. They are sent in blocks of about most_bytes. seen, if given, gets the numbers of
    (query, cell) pairs that there are and that were read.
    """
    spark, head = index.spark, index.head
    asked = usable(queries.select(F.col("query_id").alias("doc_id"), F.col("qvector").alias("vector")))
    size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(index.vectors.dtypes).get('doc_id', 'long') if len(head['cell']) else 'long'}, score double"
    blocks, out = max(1, -(-size // most_bytes)), None
    for i in range(blocks):
        part = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i)).collect()
        if not part or not len(head["cell"]):
            continue
        ids, vectors = [r.doc_id for r in part], np.array([r.vector for r in part])
        near = distances(directions(vectors), head["centroid"])
        order = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1, kind="stable")
        wanted = order < (probes or ahead)
        found = fixed(_read(index, ids, vectors, wanted, kinds, top, skip_self))
        if probes is None:
            worst = {r.query_id: r.score for r in found.filter(F.col("rank") == top).collect()}
            # scores are rounded to six places, and a distance that is a little too large only reads more
            limit = np.array([np.sqrt(max(0.0, 2 - 2 * (worst[q] - 1e-6))) + 1e-6 if q in worst else np.inf for q in ids])
            more = ~wanted & (near - head["radius"] <= limit[:, None])
            if more.any():
                found = ranked(found.drop("rank").unionByName(_read(index, ids, vectors, more, kinds, top, skip_self).drop("rank")), top)
            wanted = wanted | more
        if seen is not None:
            seen.append((wanted.size, int(wanted.sum())))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{kinds}, rank int")


def _read(index: VectorIndex, ids: list, vectors: np.ndarray, wanted: np.ndarray, kinds: str, top: int, skip_self: bool) -> DataFrame:
    """The best of the (query, cell) pairs that are wanted; other cells' folders aren't opened."""
    cells = index.head["cell"]
    ask = {int(c): np.flatnonzero(wanted[:, k]) for k, c in enumerate(cells) if wanted[:, k].any()}
    sent = index.spark.sparkContext.broadcast((ids, vectors, ask))

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, vectors, ask = sent.value
        for whole in batches:
            cell = whole.column(2).to_numpy()
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for at in range(0, len(rows), 4096):
                    batch = whole.take(pa.array(rows[at : at + 4096]))
                    matrix, names = matrix_of(batch.column(1)), batch.column(0)
                    lengths = lengths_of(matrix)
                    place = {d: k for k, d in enumerate(names.to_pylist())} if skip_self else {}
                    every = ask.get(int(c), [])
                    for first in range(0, len(every), CELLS // 4096):  # scores of a few queries at a time
                        mine = every[first : first + CELLS // 4096]
                        got = np.round(np.array([similarities(matrix, vectors[q], "cosine", lengths) for q in mine]), 6) + 0.0
                        for k, q in enumerate(mine):
                            if ids[q] in place:
                                got[k, place[ids[q]]] = np.nan
                        yield best_of(got, [ids[q] for q in mine], names, top, lambda x: ~np.isnan(x))

    rows = index.vectors.filter(F.col("cell").isin([int(c) for c in ask])).select("doc_id", "vector", "cell")
    return ranked(rows.mapInArrow(run, kinds), top)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall and mean_recall: how much of each query's exact hits was found, and the mean over all queries."""
    hits = exact.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    mean = hits.agg(F.avg("recall").alias("mean_recall"))
    return hits.crossJoin(F.broadcast(mean))  # one row
