"""Articles to chunks of a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import paragraphs


def segments(paras: Column, budget: Column, count: Callable[[Column], Column]) -> Column:
    """Greedy packing of paragraphs: array of segments, each an array of paragraphs. A single paragraph over the budget stays whole; separators don't count."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, para: Column) -> Column:
        n, open_ = count(para), F.size(acc["now"]) > 0
        alone = ~open_ & (n > budget)
        full = open_ & (acc["n"] + n > budget)
        done = F.when(alone, F.concat(acc["done"], F.array(F.array(para)))).when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(alone, empty).when(full, F.array(para)).otherwise(F.concat(acc["now"], F.array(para)))
        total = F.when(alone, F.lit(0)).when(full, n).otherwise(acc["n"] + n)
        return F.struct(done.alias("done"), now.alias("now"), total.alias("n"))

    return F.aggregate(paras, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def chunk_articles(articles: DataFrame, id_col: str, content_col: str, prefix: Column, count: Callable[[Column], Column] = F.length, most: int = 512) -> DataFrame:
    """chunk_id, parent_id, part, text beside the articles' other columns. A short article is one chunk, part 0; parts of a long one begin with the prefix."""
    content, parent = F.col(content_col), F.col(id_col).cast("string")
    budget = F.lit(most) - count(F.concat(prefix, F.lit("\r\n")))
    parts = F.transform(segments(paragraphs(content), budget, count), lambda seg, i: F.struct((i + 1).alias("part"), F.concat(prefix, F.lit("\r\n"), F.array_join(seg, "\r\n")).alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("part"), content.alias("text")))
    out = articles.withColumn("__c", F.explode(F.when(count(content) <= most, whole).otherwise(parts)))
    chunk_id = F.when(F.col("__c.part") == 0, parent).otherwise(F.concat(parent, F.lit("-p"), F.col("__c.part").cast("string")))
    return out.select(chunk_id.alias("chunk_id"), parent.alias("parent_id"), F.col("__c.part").alias("part"), F.col("__c.text").alias("text"), *[F.col(c) for c in articles.columns if c not in (content_col, "chunk_id", "parent_id", "part", "text")])


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts over all chunks and the split parents in order."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_distinct("parent_id").alias("parent_count"),
        F.count_if(F.col("part") > 0).alias("part_count"),
        F.array_sort(F.collect_set(F.when(F.col("part") > 0, F.col("parent_id")))).alias("split_parents"),
    )
