"""What the operators share: the shared working folder, staged tables and column handling."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master without the setting, as in tests, a temporary one. On a cluster that is an error, as executors couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuswright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/corpuswright/{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(_forget)
    _made.append((spark, path))
    return path


def _forget() -> None:
    for spark, path in _made:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at exit
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: later reads neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, schema: StructType | str, f: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """mapInArrow where f yields column lists (name -> list) for a batch."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in slices(batches, 1000):
            for columns in f(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id as long and the text, under fixed names; other columns never reach an operator's inner plan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts_of(batch: pa.RecordBatch, column: str = "text", step: int = 256) -> Iterator[str]:
    """The batch's texts, a few rows at a time as Python strings; null becomes the empty text."""
    found = batch.column(batch.schema.get_field_index(column))
    for at in range(0, len(found), step):
        yield from (x or "" for x in found.slice(at, step).to_pylist())


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most `rows` rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_held: dict = {}


def worker_cache(name, make: Callable):
    """What a worker process keeps between tasks. A worker serves many operators in turn, so it holds one operator's cache at a time."""
    if name not in _held:
        _held.clear()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass
        _held[name] = make()
    return _held[name]


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, least: int = 1000, most: int = 100_000) -> DataFrame:
    """rows left-joined to groups by keys. groups' column `size` says how many of rows each has; the column isn't kept.

    Groups of at least max(least, rows / most) rows are broadcast, and their rows aren't moved: there can't be more than
    `most` such groups. So no task of the other rows' join gets a large group.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    large = F.col(size) >= max(least, -(-total // most))
    hot, cold = groups.filter(large).drop(size), groups.filter(~large).drop(size)
    if hot.isEmpty():
        return rows.join(cold, keys, "left")
    mine = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return mine.unionByName(others.join(cold, keys, "left"))


def without_ids(docs: DataFrame, gone: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The rows of docs whose doc_id isn't in gone (a column doc_id). Up to `most` ids (8 bytes each) are broadcast; more are joined, which moves the rows of docs once. Rows without an id stay; docs may have columns of any name."""
    own = fresh(docs, "__gone")
    gone = gone.select(F.col("doc_id").alias(own))
    few = gone.limit(most + 1).count() <= most
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(own), "left_anti")
