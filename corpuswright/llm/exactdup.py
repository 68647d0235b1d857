"""Exact duplicates by content-defined chunk recipes.

A text is normalised (each run of ASCII white space becomes one space) and cut where a rolling hash of its last 32 bytes
has zero high bits, so that equal content is cut alike. Each chunk becomes a 64-bit fingerprint with a SHA-256 digest.
An aggregate over all chunks verifies that a fingerprint has one digest; then it is the chunk's identifier. Only if two
digests share one do ranks tell them apart. A document is compared by the ordered list of its chunks' identifiers. Only
fingerprints and digests are shuffled, never a text; rows of large groups stay where they are and get their group by
broadcast.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, id_and_text, map_arrow, split_hot, staged, texts_of, without_ids

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_GEAR = np.random.default_rng(9).integers(0, 2**32, 256, dtype=np.uint32)
_MIN, _BITS, _MAX = 2048, 12, 32768
_PARTS = ("fp", "a", "b", "c", "d")


def normalise(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return _SPACE.sub(b" ", data)


def cut(data: bytes, small: int = 2 * _MIN) -> list[int]:
    """End offsets of the chunks of data; never empty, the last is len(data)."""
    n = len(data)
    if n <= small:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - _BITS) == 0) + 1).tolist() + [n]:
        while at - last > _MAX:
            last += _MAX
            ends.append(last)
        if at - last >= _MIN or at == n:
            last = at
            ends.append(at)
    return ends if ends[-1] == n else [*ends, n]


def chunk_recipes(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_sha256 and chunks (fingerprint, digest as four numbers) of every row, in order."""

    def recipes(batch: pa.RecordBatch) -> Iterator[dict]:
        part, ids = TaskContext.get().partitionId(), batch.column(0).to_pylist()
        out: dict[str, list] = {"row_id": [], "doc_id": ids, "text_sha256": [], "chunks": []}
        for text in texts_of(batch):
            data = normalise(text)
            ends = cut(data)
            whole = hashlib.sha256(data)
            out["text_sha256"].append(whole.hexdigest())
            parts = [data] if len(ends) == 1 else [data[a:b] for a, b in zip([0, *ends], ends)]
            digests = [whole.digest()] if len(ends) == 1 else [hashlib.sha256(x).digest() for x in parts]
            out["chunks"].append([dict(zip(_PARTS, (xxhash.xxh3_64_intdigest(x) - 2**63, *struct.unpack("<4q", d)))) for x, d in zip(parts, digests)])
            out["row_id"].append(part << 33 | next(counter[part]))
        yield out

    counter = _Counters()
    return map_arrow(docs, "row_id long, doc_id long, text_sha256 string, chunks array<struct<fp: long, a: long, b: long, c: long, d: long>>", recipes)


class _Counters(dict):
    """A row number for each partition that this worker reads, from 0."""

    def __missing__(self, part):
        from itertools import count

        self[part] = count()
        return self[part]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null text counts as empty. Of equal texts the smallest doc_id stays; null ids come last. Of rows that repeat both id
    and text one is kept. An empty table gives an empty result; other columns of docs are ignored.
    """
    recipes = staged(chunk_recipes(id_and_text(docs, id_col, text_col)), "recipes")
    # a row for each distinct (recipe, id), so that a hot group is summed before it is dealt out
    rows = identified(recipes).withColumn("key", F.xxhash64("ids")).groupBy("key", "ids", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    rows = staged(rows, "rows")
    groups = rows.groupBy("key", "ids").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("rows"))
    shared = staged(groups.filter("group_size > 1").select("key", "ids", F.col("first.doc_id").alias("keep"), "group_size", "rows", F.lit(True).alias("found")), "groups")
    joined = split_hot(rows, shared, ["key", "ids"], "rows")
    return joined.select(
        "doc_id",
        F.when(F.col("found"), F.col("keep")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        F.size("ids").alias("n_chunks"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256", "n_chunks")


def identified(recipes: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and ids of every recipe: its chunks' identifiers, a fingerprint and the rank of the digest among those that share it.

    Whether any do is one aggregate. Then, and only then, the chunks of these fingerprints are joined to their ranks.
    """
    one = lambda c: F.struct(c["fp"].alias("fp"), F.lit(1).alias("rank"))
    parts = recipes.select(F.explode("chunks").alias("c")).select("c.*")
    clash = staged(parts.groupBy("fp").agg(*[f(x).alias(f"{x}_{f.__name__}") for x in _PARTS[1:] for f in (F.min, F.max)]).filter(" or ".join(f"{x}_min <> {x}_max" for x in _PARTS[1:])).select("fp"), "clashes")
    if clash.isEmpty():
        return recipes.select("doc_id", "text_sha256", F.transform("chunks", one).alias("ids"))
    ranks = parts.join(clash, "fp", "left_semi").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy(*_PARTS[1:])))
    chunks = recipes.select("row_id", F.posexplode("chunks").alias("at", "c")).select("row_id", "at", "c.*")
    named = chunks.join(ranks, list(_PARTS), "left").select("row_id", F.struct("at", "fp", F.coalesce("rank", F.lit(1)).alias("rank")).alias("c"))
    # of a row, not of a group: as long as its text's recipe
    lists = named.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.struct(c["fp"].alias("fp"), c["rank"].alias("rank"))).alias("ids"))
    return recipes.join(lists, "row_id").select("doc_id", "text_sha256", "ids")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns, whatever their names; rows that repeat id and text stay once.

    Null text counts as empty, texts of any length are compared whole, of equal texts the smallest doc_id stays (null ids
    come last), and an empty table gives an empty one. Ids of which no row stays are taken out by id alone. Only where an id
    has rows of both kinds are texts compared.
    """
    rows = staged(exact_duplicates(docs), "marked")
    ids = staged(rows.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go")).filter("go > 0"), "dropped")
    out = without_ids(docs, ids.filter("stay = 0").select("doc_id"))
    id_, of = fresh(docs, "__id"), fresh(docs, "__of")
    mixed = ids.filter("stay > 0 or doc_id is null").select(F.col("doc_id").alias(id_))
    if mixed.isEmpty():
        return out
    same = F.col("doc_id").eqNullSafe(F.col(id_))
    kept = rows.filter("kept").join(mixed, same, "left_semi").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(of)).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    again = docs.join(mixed, same, "left_semi").join(kept, same & (sha == F.col(of))).dropDuplicates([id_, of])
    return out.join(mixed, same, "left_anti").unionByName(again.select(*docs.columns))
