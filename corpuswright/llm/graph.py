"""Connected components of an edge table: union-find inside partitions, then alternating star contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def local_forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars (node, smallest node of its tree); a map."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while (y := up.get(x, x)) != top:
                up[x], x = top, y
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > 2_000_000:  # bounded memory: what is joined so far goes out
                yield out([(x, root(x)) for x in up])
                up.clear()
        yield out([(x, root(x)) for x in up])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge; comp is the smallest node reachable. edges: a, b (long, any order, repeats allowed)."""
    now = staged(local_forest(edges).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark[0] == 0 or tuple(mark) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        before = tuple(mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = staged(large, "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = staged(linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
