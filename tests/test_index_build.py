import pytest

from corpuswright.operators import versions
from corpuswright.plans import index_build


def test_build_reuses_vectors_and_checks_recall(spark):
    articles = spark.createDataFrame([(f"L-{i}", f"word{i} shared text number{i}") for i in range(12)] + [("L-99", "?!")], "article_id string, content string")
    asked = spark.createDataFrame([("q1", "word3 number3"), ("q2", "number7")], "query_id string, text string")
    gold = spark.createDataFrame([("q1", "L-3"), ("q2", "L-7")], "query_id string, article_id string")
    first = index_build.build(articles, gold, asked)
    assert (first.reused, first.embedded, first.recall) == (0, 13, 1.0)
    rows = {r.chunk_id: r.vector for r in first.chunks.collect()}
    assert sum(x * x for x in rows["L-3"]) == pytest.approx(1) and set(rows["L-99"]) == {0.0}
    edited = articles.filter("article_id <> 'L-0'").unionByName(spark.createDataFrame([("L-0", "another text")], articles.schema))
    again = index_build.build(edited, gold, asked, previous=first.chunks.select("chunk_id", "text", "vector"))
    assert (again.reused, again.embedded) == (12, 1)
    assert {r.chunk_id: r.vector for r in again.chunks.collect()}["L-3"] == rows["L-3"]
    wrong = spark.createDataFrame([("q1", "L-404")], gold.schema)
    with pytest.raises(versions.ActivationRefused):
        index_build.build(articles, wrong, asked)


def test_summaries_count_for_their_text_only(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    from corpuswright.functions.text import short_hash
    from pyspark.sql import functions as F

    cache = chunks.filter("chunk_id = 'a'").select("chunk_id", short_hash(F.col("text")).alias("hash"), F.lit("S").alias("summary")).unionByName(spark.createDataFrame([("b", "old", "T")], "chunk_id string, hash string, summary string"))
    assert {r.chunk_id: r.text for r in index_build.compose(chunks, cache).collect()} == {"a": "S\r\nx", "b": "y"}
