"""Deterministic sampling: quotas, turns, shuffles and disjoint pairs. A seed takes the place of a random generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import fixed
from .windows import place


def seeded(seed: int, *cols: str) -> Column:
    """A pseudo-random number fixed by the seed and the row's keys."""
    return F.xxhash64(F.lit(seed), *cols)


def quotas(sizes: DataFrame, total: int, least: int = 2) -> DataFrame:
    """stratum and quota: proportional, rounded half to even, `least` at least; what is left over goes to the largest. sizes: stratum, n."""
    share = F.greatest(F.lit(least), F.bround(F.col("n") * total / F.sum("n").over(Window.partitionBy()), 0).cast("int"))
    first = sizes.withColumn("quota", share)
    rest = total - F.sum("quota").over(Window.partitionBy())
    largest = F.row_number().over(Window.orderBy(F.desc("quota"), "stratum")) == 1
    return first.select("stratum", F.when(largest, F.col("quota") + rest).otherwise(F.col("quota")).cast("int").alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int, least: int = 2) -> DataFrame:
    """rows drawn by quota in a seeded order."""
    wanted = quotas(rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n")), total, least)
    w = Window.partitionBy(stratum).orderBy(seeded(seed, key), key)
    numbered = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= total)
    return numbered.join(F.broadcast(wanted), F.col(stratum) == F.col("stratum")).filter(F.col("__n") <= F.col("quota")).select(*rows.columns)


def round_robin(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, one of each group in turn, with their turn."""
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col("turn") <= n)
    return turns.orderBy("turn", group).limit(n)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(seeded(seed, key), key).limit(n)


def flipped(seed: int, key: str) -> Column:
    """Whether a blind comparison shows a pair in reverse."""
    return F.pmod(seeded(seed, key), F.lit(2)) == 1


def unflipped(winner: Column, flip: Column) -> Column:
    """The verdict as if nothing had been reversed."""
    return F.when(flip & (winner == "A"), "B").when(flip & (winner == "B"), "A").otherwise(winner)


def disjoint_edges(edges: DataFrame, seed: int) -> DataFrame:
    """A maximal set of edges (source, target) without a common node: in each round edges that come first at both ends are taken and their neighbours leave. The result is the greedy one in seeded order."""
    left = fixed(edges.filter("source <> target").withColumn("p", F.struct(seeded(seed, "source", "target").alias("h"), "source", "target")))
    taken = None
    while True:
        ends = left.select(F.col("source").alias("n"), "p").unionByName(left.select(F.col("target").alias("n"), "p"))
        first = ends.groupBy("n").agg(F.min("p").alias("first"))
        a, b = first.toDF("source", "fa"), first.toDF("target", "fb")
        won = left.join(a, "source").join(b, "target").filter("p = fa and p = fb").select("source", "target", "p")
        won = fixed(won)
        if won.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.col("source").alias("n")).unionByName(won.select(F.col("target").alias("n")))
        # written, so that a round reads what the one before left and not all rounds again
        left = fixed(left.join(used.withColumnRenamed("n", "source"), "source", "left_anti").join(used.withColumnRenamed("n", "target"), "target", "left_anti").select("source", "target", "p"))
    return (taken if taken is not None else left.limit(0)).select("source", "target")


def specifications(sources: DataFrame, key: str, n: int) -> DataFrame:
    """n rows that go round the sources in order: spec_no from 0, the source, and variant from 1."""
    numbered = place(sources.select(key), key).withColumnRenamed("place", "i")
    size = numbered.count()
    specs = sources.sparkSession.range(n).select(F.col("id").alias("spec_no"), F.pmod("id", F.lit(max(size, 1))).alias("i"), (F.floor(F.col("id") / max(size, 1)) + 1).cast("int").alias("variant"))
    return specs.join(numbered, "i").select("spec_no", key, "variant")


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two splits have in common; disjoint splits have none."""
    return a.select(key).intersect(b.select(key))


def export_packet(questions: DataFrame, known: DataFrame, prefix: str = "Q") -> DataFrame:
    """The first of each question by hash, without known hashes, numbered. questions: question, question_hash, ord."""
    new = questions.join(known.select("question_hash"), "question_hash", "left_anti")
    once = new.groupBy("question_hash").agg(F.min_by("question", "ord").alias("question"), F.min("ord").alias("ord"))
    return place(once, "ord").select(F.concat(F.lit(prefix), F.lpad((F.col("place") + 1).cast("string"), 4, "0")).alias("item_id"), "question", "question_hash")
