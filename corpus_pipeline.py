"""From raw documents to packed training sequences, in stages that each call one operator.

Every stage takes the rows that the one before kept and returns those that it keeps, with the columns of documents; the
last returns pieces. Between stages the rows are written as Parquet in the shared folder and read again.

Each stage reads whole texts of any length, takes an empty table (and gives an empty one) and columns of any other name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuswright.llm import common, decontam, exactdup, langid, neardup, packing


#: Rows that go to Python at once. The JVM and the worker each hold a batch whole, and texts may be long.
ROWS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _lean(spark: SparkSession) -> None:
    """Lowers the session's limit of rows a batch, if it is higher."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS_AT_ONCE:
        spark.conf.set(_BATCH, str(ROWS_AT_ONCE))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told with confidence go, and so do null and empty texts and those without a letter. Repeated rows and rows without an id are judged each; the model learns from rows with id, text and lang."""
    _lean(spark)
    return langid.keep_identified(docs, langid.fit(langid.learnable(docs)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, an id before none; null counts as empty. Of rows that repeat id and text one stays."""
    _lean(spark)
    return exactdup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id. Null and empty texts and rows without an id are in no group and stay."""
    _lean(spark)
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts stay; items without words hit nothing."""
    _lean(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048. A null or empty text is its end token alone; every row, repeated ones and those without an id too, is packed."""
    _lean(spark)
    return packing.pack(docs).drop("n_pieces")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", pack)]
#: SQL can't express the language model; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
