"""Calls of a model over a table of prompts: batched in tasks, with a cache of replies, a budget, retries and resumption.

A reply belongs to its prompt's hash. Prompts whose reply is cached aren't sent; of equal ones one is. What the tasks get is
appended to the cache as they end, so a run that stops, or is out of budget, goes on with what is missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.shared import fixed
from .versions import Store

_CACHE = "prompt_hash string, reply string, tries int, valid boolean"
#: What became of an item: its reply was there, was made by this run, was never valid, or its prompt is still to be sent.
CACHED, MADE, INVALID, PENDING = "cached", "made", "invalid", "pending"


def cache_of(spark: SparkSession, path: str) -> DataFrame:
    """prompt_hash, reply, tries and valid of all prompts sent so far; of several valid replies to one prompt the smallest."""
    if not Store(spark, path)._exists("replies"):
        return spark.createDataFrame([], StructType.fromDDL(_CACHE))
    rows = spark.read.schema(_CACHE).parquet(f"{path}/replies")
    best = F.min_by(F.struct("reply", "valid"), F.struct(~F.col("valid"), F.coalesce("reply", F.lit(""))))
    return rows.groupBy("prompt_hash").agg(best.alias("b"), F.sum("tries").cast("int").alias("tries")).select("prompt_hash", "b.reply", "tries", "b.valid")


def _sent(model, valid, batch: int, tries: int, budget: int | None, per_second: float | None):
    def run(batches) -> Iterator[pa.RecordBatch]:
        left, last = budget, 0.0
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                hashes, prompts = part.column(0).to_pylist(), part.column(1).to_pylist()
                reply, used, open_ = [None] * len(prompts), [0] * len(prompts), list(range(len(prompts)))
                for _ in range(tries):
                    if left is not None:
                        open_ = open_[:left]
                    if not open_:
                        break
                    if per_second:
                        time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                        last = time.monotonic()
                    try:
                        got: Sequence[str | None] = model([prompts[i] for i in open_])
                    except Exception:  # noqa: BLE001  a call that fails is a try without a reply
                        got = [None] * len(open_)
                    if left is not None:
                        left -= len(open_)
                    for i, text in zip(open_, got):
                        used[i] += 1
                        reply[i] = text
                    open_ = [i for i in open_ if reply[i] is None or not valid(reply[i])]
                kept = [i for i, n in enumerate(used) if n]
                fine = [reply[i] is not None and valid(reply[i]) for i in kept]
                yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in kept], pa.string()), pa.array([reply[i] for i in kept], pa.string()), pa.array([used[i] for i in kept], pa.int32()), pa.array(fine, pa.bool_())], ["prompt_hash", "reply", "tries", "valid"])

    return run


def replies(items: DataFrame, path: str, model: Callable[[list[str]], Sequence[str | None]], valid: Callable[[str], bool] = bool, key: str = "item_id", text: str = "prompt", batch: int = 16, tries: int = 3, budget: int | None = None, per_second: float | None = None, parts: int | None = None) -> DataFrame:
    """key, prompt_hash, reply and status of each item (key, text); the cache below path gets what is new.

    The model takes a list of up to `batch` prompts and gives a reply, or None, for each; a call that raises gives none. What
    isn't valid is asked again, up to `tries` times. budget: the number of prompts, repeats included, that a task may send;
    the others stay pending, as do items without a prompt. Prompts that were never valid are sent again by the next run.
    parts and per_second bound the tasks that call at once, and the calls of each. A task that is lost calls again.
    """
    spark = items.sparkSession
    asked = items.select(key, F.col(text).alias("__p")).withColumn("prompt_hash", F.sha2(F.col("__p"), 256))
    before = cache_of(spark, path)
    open_ = asked.filter("__p is not null").groupBy("prompt_hash").agg(F.min("__p").alias("prompt")).join(before.filter("valid").select("prompt_hash"), "prompt_hash", "left_anti")
    dealt = open_.repartition(parts, "prompt_hash") if parts else open_
    known = before.filter("valid").select("prompt_hash", F.lit(True).alias("was"))
    was = asked.select("prompt_hash").distinct().join(known, "prompt_hash")
    was = fixed(was)
    dealt.select("prompt_hash", "prompt").mapInArrow(_sent(model, valid, batch, tries, budget, per_second), _CACHE).write.mode("append").parquet(f"{path}/replies")
    now = cache_of(spark, path)
    joined = asked.join(now, "prompt_hash", "left").join(was, "prompt_hash", "left")
    status = F.when(F.col("was"), CACHED).when(F.col("valid"), MADE).when(F.col("valid").isNotNull(), INVALID).otherwise(PENDING)
    return joined.select(key, "prompt_hash", F.when(F.col("valid"), F.col("reply")).alias("reply"), status.alias("status"))


def missing(items: DataFrame, path: str, text: str = "prompt") -> DataFrame:
    """Items that have no valid reply yet."""
    have = cache_of(items.sparkSession, path).filter("valid").select(F.col("prompt_hash").alias("__h"))
    return items.join(have, F.sha2(F.col(text), 256) == F.col("__h"), "left_anti")
