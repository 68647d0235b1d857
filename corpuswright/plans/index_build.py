"""Versioned indexes: chunks, composed texts, vectors that are made only where a text is new, postings, a regression, activation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composite_text, short_hash
from ..operators import chunking, retrieval, versions
from ..operators.retrieval import Embedder, hashed_vectors
from ..operators.segments import Segments
from .shared import fixed

@dataclass
class Built:
    chunks: DataFrame  # chunk_id, parent_id, part, text, vector
    postings: retrieval.Index
    reused: int
    embedded: int
    recall: float


def compose(chunks: DataFrame, summaries: DataFrame | None) -> DataFrame:
    """Chunks with their cached summary in front, if it was made for just this text. summaries: chunk_id, hash, summary."""
    if summaries is None:
        return chunks
    found = chunks.withColumn("hash", short_hash(F.col("text"))).join(summaries, ["chunk_id", "hash"], "left")
    return found.select(*[c for c in chunks.columns if c != "text"], composite_text(F.coalesce("summary", F.lit("")), F.col("text")).alias("text"))


def build(articles: DataFrame, gold: DataFrame, questions: DataFrame, previous: DataFrame | None = None, summaries: DataFrame | None = None, embed: Embedder = hashed_vectors, prefix: Column | None = None, count: Callable[[Column], Column] = F.length, most: int = 512, least_recall: float = 0.9) -> Built:
    """A new index; an error if its regression fails. articles: article_id, content; gold: query_id, article_id; questions: query_id, text; previous: chunk_id, text, vector."""
    prefix = F.lit("") if prefix is None else prefix
    chunks = compose(chunking.chunk_articles(articles, "article_id", "content", prefix, count, most).select("chunk_id", "parent_id", "part", "text"), summaries)
    old = previous if previous is not None else chunks.select("chunk_id", "text", F.lit(None).cast("array<double>").alias("vector")).limit(0)
    known = fixed(versions.reused(chunks, old))
    new = embed(known.filter("vector is null").select("chunk_id", "text")).withColumnRenamed("vector", "made")
    done = fixed(known.join(new, "chunk_id", "left").withColumn("vector", F.coalesce("vector", "made")).drop("made"))
    counts = known.agg(F.count("vector"), F.count_if(F.col("vector").isNull())).first()
    recall = regression(done, questions, gold, embed, least_recall).first()
    versions.check_activation("ready", recall["passed"])
    return Built(done, retrieval.build_index(done, "chunk_id", "text"), counts[0], counts[1], recall["recall"])


def regression(chunks: DataFrame, questions: DataFrame, gold: DataFrame, embed: Embedder, least: float) -> DataFrame:
    """recall and passed, one row: recall among the first twenty fused candidates, by article."""
    found = retrieval.retrieve(retriever_of(chunks, embed), questions)
    by_article = found.fused.join(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("parent_id").alias("article_id")), "doc_id").select("query_id", F.col("article_id").alias("doc_id"), "fused_rank")
    return retrieval.recall_regression(by_article, gold.select("query_id", F.col("article_id").alias("doc_id")), 20, least)


def retriever_of(chunks: DataFrame, embed: Embedder = hashed_vectors) -> retrieval.Retriever:
    """Over chunks (chunk_id, text, vector) whose vectors are made already."""
    docs = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    return retrieval.Retriever(docs, retrieval.build_index(docs), chunks.select(F.col("chunk_id").alias("doc_id"), "vector"), embed)


def drill(first: DataFrame, then: DataFrame, path: str, embed: Embedder = hashed_vectors) -> DataFrame:
    """A law update played through below a path of its own: a version is built, then the next one from what changed, then the first is made active again.

    first, then: chunk_id, text. One row: unchanged, new, changed and deleted chunks, and passed: only new and changed chunks
    were written, the second version holds just `then`, and the first is back as it was.
    """
    spark = first.sparkSession
    store = Segments(spark, path, embed)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")
    a, b = (x.select("chunk_id", digest) for x in (first, then))
    n = {r.status: r["count"] for r in versions.diff(a, b, "chunk_id").groupBy("status").count().collect()}
    store.build(first, "before")
    head = store.build(then, "after")
    same = lambda want: store.chunks().select("chunk_id", "hash").exceptAll(want).isEmpty() and store.chunks().count() == want.count()
    passed = head["written"] == n.get("NEW", 0) + n.get("CHANGED", 0) and head["reused"] == n.get("UNCHANGED", 0) and same(b)
    store.rollback()
    passed = passed and store.manifest()["version"] == "before" and same(a)
    counts = [(n.get("UNCHANGED", 0), n.get("NEW", 0), n.get("CHANGED", 0), n.get("DELETED", 0), passed)]
    return spark.createDataFrame(counts, "unchanged long, new long, changed long, deleted long, passed boolean")
