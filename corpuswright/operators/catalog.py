"""Catalogues of chapters, in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import roc_date


def chapters(articles: DataFrame) -> DataFrame:
    """pcode, chapter, lo, hi, article_count, first_ord: by the order of the document, not of the numbers."""
    return articles.groupBy("pcode", F.coalesce("chapter", F.lit("")).alias("chapter")).agg(F.min_by("article_no", "ord").alias("lo"), F.max_by("article_no", "ord").alias("hi"), F.count(F.lit(1)).alias("article_count"), F.min("ord").alias("first_ord"))


def overview(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """pcode and the text of its catalogue. laws: pcode, law_name, law_modified_date."""
    line = F.format_string("・%s：第 %s〜%s 條（共 %d 條）", F.when(F.col("chapter") == "", "（未分章）").otherwise(F.regexp_replace("chapter", r"(?U)\s+", "")), "lo", "hi", "article_count")
    lists = chapters(articles).groupBy("pcode").agg(
        F.sum("article_count").alias("n"), F.array_sort(F.collect_list(F.struct("first_ord", line.alias("line"), "chapter", "lo", "hi"))).alias("parts")
    )
    first = F.col("parts")[0]
    divided = (F.size("parts") > 1) | (first["chapter"] != "")
    body = F.when(divided, F.concat(F.lit("章節結構：\n"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n"))).otherwise(F.format_string("本法未分章，條號為第 %s〜%s 條。", first["lo"], first["hi"]))
    head = F.format_string("《%s》全文共 %d 條（最近修正：%s）。\n\n", F.col("law_name"), F.col("n"), roc_date(F.col("law_modified_date")))
    return laws.join(lists, "pcode").select("pcode", F.concat(head, body).alias("text"))


def counts(rows: DataFrame) -> DataFrame:
    """Articles and headings of each law. rows: pcode, article_type."""
    return rows.groupBy("pcode").agg(F.count_if(F.col("article_type") == "A").alias("article_count"), F.count_if(F.col("article_type") == "C").alias("chapter_count"))
