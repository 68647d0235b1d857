"""Rows fixed in the cluster's shared folder, where what follows reads them several times or depends on their being the same in every run."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.util import inheritable_thread_target

_made: list[tuple[SparkSession, str]] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master without the setting, as in tests, a temporary one. On a cluster that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuswright-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/corpuswright/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made.append((spark, path))
    return path


def fixed(rows: DataFrame) -> DataFrame:
    """rows written there as Parquet and read again, so that a lost executor costs a task; deleted when the interpreter ends.

    Row groups are small, so that what one task wrote can be read by several.
    """
    spark = rows.sparkSession
    path = new_path(spark)
    in_groups(rows.write).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def in_groups(out: DataFrameWriter, most_bytes: int = 8 << 20) -> DataFrameWriter:
    """A writer of row groups of about most_bytes, which a reader decodes whole. Bytes are counted from the first row on, as Parquet else gathers a hundred rows first, however large they are."""
    return out.option("compression", "zstd").option("parquet.block.size", most_bytes).option("parquet.page.size.row.check.min", 1)


def lean(spark: SparkSession) -> None:
    """Rows go to Python about 8 MB at a time from now on, if the session names no limit: the JVM holds a batch up to three times as it grows, and a worker holds it with what it makes of it."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "8m")


def spread(rows: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """rows of a few files, or of files of many rows, dealt out to all slots and to tasks of about most_rows, as a file of one row group is read by one task; rows of many small files, or of none, stay where they are."""
    slots, files = rows.sparkSession.sparkContext.defaultParallelism, len(rows.inputFiles())
    if not files:
        return rows
    n = rows.count()
    return rows.repartition(max(slots, -(-n // most_rows))) if files < slots // 2 or n > files * 5 * most_rows else rows


def tasks_for(rows: DataFrame, each: int = 2_000_000) -> int:
    """How many tasks rows of a few columns are dealt to: `each` rows a task, so that a task's memory doesn't grow with the table. Rows read from files are counted without their columns."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def together(*tasks: Callable):
    """What the tasks give, in order. Their jobs run beside each other, so that a small one doesn't wait for a large one's last task; the first error is raised."""
    as_here = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(tasks)) as pool:
        futures = [pool.submit(as_here(task)) for task in tasks]
        return [f.result() for f in futures]


def _forget() -> None:
    for spark, path in _made:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at exit
            return
