"""JSON and text sources, and sinks that append or replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "law_name string, pcode string, chapter string, article_no string, content string, url string, law_modified_date string, fetched_at string, source_update_date string"
LAW = "pcode string, law_name string, law_modified_date string, article_count int, chapter_count int"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Laws and articles of a whole-file corpus; articles have ord, their place in the file."""
    whole = spark.read.schema(f"meta struct<laws: array<struct<{_nested(LAW)}>>>, articles array<struct<{_nested(ARTICLE)}>>").option("multiLine", True).json(path)
    laws = whole.select(F.inline("meta.laws"))
    articles = whole.select(F.posexplode("articles").alias("ord", "a")).select("ord", "a.*")
    return laws, articles


def _nested(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in ddl.split(",")))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges with ord."""
    whole = spark.read.schema("nodes array<struct<id: string, pcode: string, article_no: string, law_name: string>>, edges array<struct<source: string, target: string, provenance: string>>").option("multiLine", True).json(path)
    return whole.select(F.inline("nodes")), whole.select(F.posexplode("edges").alias("ord", "e")).select("e.source", "e.target", "e.provenance", "ord")


def parsed_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """record and malformed of each line of JSON; a blank line and one that isn't an object are malformed."""
    record = F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.withColumn("record", record)
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull() | (F.trim(column) == "")
    return out.withColumn("malformed", F.coalesce(bad, F.lit(True)))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parsed_lines(spark.read.text(path), schema)


def read_reviewed(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of a test set that a human has reviewed; an error if none is."""
    whole = spark.read.schema(f"human_reviewed boolean, items array<struct<{_nested(item)}>>").option("multiLine", True).json(path)
    checked = whole.withColumn("__ok", F.assert_true(F.coalesce("human_reviewed", F.lit(False)), "the set isn't reviewed"))
    return checked.filter("__ok is null").select(F.posexplode("items").alias("ord", "i")).select("ord", "i.*")


def json_strings(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Every string under a key, at any depth of a JSON text."""
    pattern = rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"'
    raw = rows.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("raw"))
    return raw.select(F.from_json(F.concat(F.lit('{"v":"'), "raw", F.lit('"}')), "v string")["v"].alias("value")).distinct()
