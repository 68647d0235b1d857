"""A log sink that keeps each batch of a stream once, and sessions that are decided on event by event."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.trace import redacted_all, sampled
from ..operators.versions import Store


class OnceSink:
    """Below a path: batches/<id>/ with the rows, and ledger/<id>.json for each batch that is whole. Readers see what the ledger names."""

    def __init__(self, spark: SparkSession, path: str, key: str = "event_id", sample_rate: float = 1.0, redact: bool = False, always: Callable[[DataFrame], Column] | None = None):
        """key: what sampling is decided by, so that a row is kept in each run or in none; redact: personal data is taken out of all strings but the key's; always: rows that are kept whatever the rate."""
        self.spark, self.store, self.path = spark, Store(spark, path), path.rstrip("/")
        self.key, self.sample_rate, self.redact, self.always = key, sample_rate, redact, always

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Writes a batch, sampled and redacted before anything is stored. A batch that the ledger has is left as it is; one that was begun is written anew. Gives whether it was written."""
        if self.store._exists(f"ledger/{batch:012d}.json"):
            return False
        keep = sampled(F.coalesce(F.col(self.key).cast("string"), F.lit("")), self.sample_rate, *([self.always(rows)] if self.always else []))
        kept = rows.filter(keep)
        kept = redacted_all(kept, (self.key,)) if self.redact else kept
        kept.write.mode("overwrite").parquet(f"{self.path}/batches/{batch:012d}")
        self.store._write_atomic(f"ledger/{batch:012d}.json", {"batch": batch})
        return True

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """What is available, batch by batch; then the query ends. A restart goes on behind the checkpoint, and a batch that it replays adds nothing."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.write(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def batches(self) -> list[int]:
        folder = self.store._fs_path(f"{self.path}/ledger")
        if not self.store._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self.store._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self) -> DataFrame | None:
        """The rows of all whole batches, or None without any."""
        found = self.batches()
        return self.spark.read.parquet(*[f"{self.path}/batches/{b:012d}" for b in found]) if found else None


class _Quota(StatefulProcessor):
    """A user's open session: when it began, its last event, and how many there were."""

    def __init__(self, gap_ms: int, quota: int):
        self.gap, self.quota = gap_ms, quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "start long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(list(rows), ignore_index=True)
        events["ms"] = events["ts"].astype("datetime64[ms]").astype("int64")
        events = events.sort_values(["ms", "event_id"], kind="stable")
        start, last, n = self.session.get() if self.session.exists() else (None, None, 0)
        out = []
        for event, ms in zip(events["event_id"].tolist(), events["ms"].tolist()):
            if start is None or ms - last > self.gap:
                start, n = ms, 0
            last, n = ms if last is None else max(last, ms), n + 1
            out.append((event, key[0], start, n, n > self.quota))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.session.update((start, last, n))
        self.handle.registerTimer(last + self.gap + 1)
        made = pd.DataFrame(out, columns=["event_id", "user_id", "start", "n", "over_quota"])
        made["session_start"] = pd.to_datetime(made.pop("start"), unit="ms")
        yield made[["event_id", "user_id", "session_start", "n", "over_quota"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.session.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "user_id": pd.Series(dtype="int64"), "session_start": pd.Series(dtype="datetime64[ns]"), "n": pd.Series(dtype="int64"), "over_quota": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"


def decided(events: DataFrame, gap_seconds: int = 1800, quota: int = 20, late: str = "2 days") -> DataFrame:
    """event_id, user_id, session_start, n and over_quota of each event as it comes: n is its number in the user's session, which a pause of more than gap_seconds ends.

    events: a stream of event_id, user_id and ts, with each user's events in order. A user without an event for that long, by
    the watermark, has no state. The session's state store has to be RocksDB's, which keeps several states a key.
    """
    spark = events.sparkSession
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_Quota(gap_seconds * 1000, quota), "event_id long, user_id long, session_start timestamp, n long, over_quota boolean", "Append", "EventTime")


def decided_batch(events: DataFrame, gap_seconds: int = 1800, quota: int = 20) -> DataFrame:
    """The batch twin of decided()."""
    from ..operators.windows import gap_runs, running_sum

    rows = gap_runs(events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "ts", gap_seconds, "user_id", "ts", "event_id")
    rows = rows.withColumn("key", F.concat_ws("/", "user_id", "run"))
    counted = running_sum(rows, F.lit(1), "key", "ts", "event_id", name="n")
    starts = rows.groupBy("key").agg(F.min("ts").alias("session_start"))
    return counted.join(starts, "key").select("event_id", "user_id", "session_start", "n", (F.col("n") > quota).alias("over_quota"))
