"""Hard negatives: for an anchor and each of its positives, the different-label rows that score just below the positive.

Vectors become integers, so that every score is exact and ties are real. For each anchor all rows' scores are sorted, by
score and then id. Rows lie in slices, one Arrow batch each: a task sorts a slice's scores for every anchor of a block,
finds each positive's upper limit in them by binary search and reads the next different-label rows down to the lower limit.
What the slices give, a few rows for an anchor and positive, is ranked once more; Spark limits each group before it deals it
out. So no task ever holds all scores of an anchor, and no pair is written that isn't among a slice's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, staged

SLICE, CHUNK = 8192, 128


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """key, vec_id, label and vector of the rows that take part; staged, so that key tells rows apart that share an id."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col(label_col).isNotNull() & v.isNotNull() & ~odd)
    named = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("vector"))
    return staged(named.withColumn("key", F.monotonically_increasing_id()), "vectors")


def integers(lists: pa.Array, width: int | None = None, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) of each list's components, a row a list; short lists end in zeros, as what is missing adds nothing to a product."""
    at = lists.offsets.to_numpy()
    flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]])
    sizes = np.diff(at)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, (a, n) in enumerate(zip((at - at[0]).tolist(), sizes.tolist())):
        out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, a row an anchor: in floats of a size that holds every sum, else in Python's integers."""
    bound = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, rows.shape[1])
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(anchors) @ whole(rows).T if rows.size and anchors.size else np.zeros((len(anchors), len(rows)), object)


def full_sort(found: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rows' order by score, highest first, then by place."""
    if found.dtype == object:
        found = np.unique(found, return_inverse=True)[1]
    return np.lexsort((place, -found))


class _Block:
    """A block of anchors, as tasks get it."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.key, self.label = table["key"].to_numpy(), table["label"].to_numpy()
        lists = table["vector"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        self.matrix = integers(lists)
        self.positives: dict[int, list[int]] = {}

    def sorted_slices(self, batches) -> Iterator[tuple]:
        """For each slice and anchor: the anchor's place, the slice's keys, ids and labels, its scores and their order."""
        if not len(self.key):
            return
        for batch in slices(batches, SLICE):
            if batch.num_rows:
                ids, labels, keys = (batch.column(k) for k in ("vec_id", "label", "key"))
                place = np.argsort(np.lexsort((keys.to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))))
                rows, labels, keys = integers(batch.column("vector"), self.matrix.shape[1]), labels.to_numpy(), keys.to_numpy()
                for at in range(0, len(self.key), CHUNK):
                    found = scores(rows, self.matrix[at : at + CHUNK])
                    for i, own in enumerate(found, at):
                        yield i, keys, ids, labels, own, full_sort(own, place)


def _batch(columns: dict[str, list | np.ndarray], ids: list) -> pa.RecordBatch:
    arrays = [pa.array(v, pa.int64()) for v in columns.values()] + [pa.concat_arrays(ids) if ids else pa.array([], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, [*columns, "vec_id"])


def _emit(picks: Iterator[tuple], names: tuple[str, ...], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of picks: values for the names, keys, scores and ids."""
    held, ids, n = {k: [] for k in (*names, "key", "score")}, [], 0
    for values, keys, own, vec_ids in picks:
        for name, value in zip(names, values):
            held[name] += [value] * len(own)
        held["key"] += keys.tolist()
        held["score"] += own.tolist()
        ids.append(vec_ids)
        n += len(own)
        if n >= rows:
            yield _batch(held, ids)
            held, ids, n = {k: [] for k in held}, [], 0
    yield _batch(held, ids)


def _positives(block: _Block, k: int):
    def picks(batches):
        for i, keys, ids, labels, own, order in block.sorted_slices(batches):
            same = order[(labels[order] == block.label[i]) & (keys[order] != block.key[i])][:k]
            if len(same):
                yield (int(block.key[i]),), keys[same], own[same], ids.take(pa.array(same))

    return lambda batches: _emit(picks(batches), ("anchor",))


def _negatives(block: _Block, k: int, low: int, high: int):
    def picks(batches):
        for i, keys, ids, labels, own, order in block.sorted_slices(batches):
            wanted = block.positives.get(int(block.key[i]))
            if not wanted:
                continue
            order = order[labels[order] != block.label[i]]
            falling = -own[order]
            for rank, score in enumerate(wanted, 1):
                start = np.searchsorted(falling, -(high * score // 100), "left")
                end = np.searchsorted(falling, -low * score // 100, "right")  # rounded down, as scores are negated
                at = order[start : min(end, start + k)]
                if len(at):
                    yield (int(block.key[i]), rank), keys[at], own[at], ids.take(pa.array(at))

    return lambda batches: _emit(picks(batches), ("anchor", "positive"))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, block_bytes: int = 16 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    rows: what usable() gives. anchors: which of them are anchors. An anchor's positives are its first `positives` other rows
    of its label; its negatives for one are the first k rows of other labels with low % <= negative_score / positive_score <=
    high %, in whole numbers. Higher scores come first, then smaller ids, null ids last. Rows that share an id are rows each:
    each may be an anchor, and is another row to its copies. An anchor without positives, or a positive without rows between
    its limits (any with a score below zero), gives no row; an empty table gives an empty result. Vectors of different length
    are compared as if the shorter ended in zeros. Scores have to be longs; larger ones are an error.

    Anchors are broadcast in blocks of about block_bytes, whatever their number, and each block meets all rows twice.
    """
    spark = rows.sparkSession
    asked = rows.filter(anchors).select("key", "vec_id", "label", "vector")
    size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // block_bytes)), None
    inner = rows.select("vec_id", "label", "vector", "key")
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        block = _Block(mine.select("key", "label", "vector").toArrow())
        near = inner.mapInArrow(_positives(block, positives), "anchor long, key long, score long, vec_id long")
        near = staged(_best(near, ["anchor"], positives).select("anchor", F.col("rank").cast("long").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        for r in near.orderBy("anchor", "positive").collect():  # a few for each anchor of the block
            block.positives.setdefault(r.anchor, []).append(r.positive_score)
        far = inner.mapInArrow(_negatives(block, k, low, high), "anchor long, positive long, key long, score long, vec_id long")
        far = _best(far, ["anchor", "positive"], k).select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        part = far.join(near, ["anchor", "positive"]).join(mine.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        part = part.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        part = part if blocks == 1 else staged(part, "negatives")
        out = part if out is None else out.unionByName(part)
    return out


def mine(embeddings: DataFrame) -> DataFrame:
    """The contract's negatives: rows whose vec_id is divisible by 100 are anchors; where 7 divides it, the label is moved on by one of ten first. Rows without a label, a vector or with a component that isn't finite take no part."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(embeddings.select("vec_id", "embedding", moved.alias("label"))), F.col("vec_id") % 100 == 0)
