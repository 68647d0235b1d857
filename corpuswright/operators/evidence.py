"""Evidence requirements of a question and how far retrieved articles meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .routing import is_multi_hop

# fixed values: facets as (id, description, words of a question, words of evidence)
FACETS = (
    ("eligibility", "資格、適用對象或前提條件", ("資格", "符合", "對象", "誰可以", "失能", "幾歲"), ("資格", "符合", "對象", "申請", "失能", "年滿", "以上")),
    ("application", "申請、評估或受理程序", ("申請", "評估", "送件", "受理", "辦理"), ("申請", "評估", "受理", "文件", "主管機關", "照管中心")),
    ("establishment", "籌設、設立或許可條件", ("設立", "籌設", "開辦", "許可"), ("設立", "籌設", "許可", "長照機構", "應備文件")),
    ("benefit", "給付、補助、額度或費用負擔", ("給付", "補助", "額度", "費用", "負擔"), ("給付", "補助", "額度", "費用", "負擔", "自付")),
    ("restriction", "限制、禁止、期限或例外", ("限制", "不得", "禁止", "期限", "多久", "例外", "最長"), ("不得", "限制", "期限", "日內", "年", "月", "例外")),
)


def matching(rows: Column, words: tuple[str, ...]) -> Column:
    """Article ids, once each and in order, of the rows (article_id, text) that hold one of the words."""
    return F.array_distinct(F.transform(F.filter(rows, lambda r: contains_any(r["text"], words)), lambda r: r["article_id"]))


def evidence_plan(question: Column, route: Column, required: Column, rows: Column, facets=FACETS) -> Column:
    """Requirements with the articles that satisfy them, and their coverage (null without requirements).

    rows: array of (article_id, text), retrieved ones first. Articles that the question names are requirements; a question
    of several hops also has its facets, and an unsatisfied one where it has fewer than two.
    """
    def requirement(id_: Column, description: Column, words: Column, met: Column) -> Column:
        return F.struct(id_.alias("requirement_id"), description.alias("description"), words.cast("array<string>").alias("query_terms"), met.cast("array<string>").alias("satisfied_article_ids"))

    explicit = F.transform(required, lambda a: requirement(F.concat(F.lit("explicit:"), a), F.concat(F.lit("article named: "), a), F.array(a), F.transform(F.filter(rows, lambda r: r["article_id"] == a), lambda r: r["article_id"])))
    found = []
    for id_, description, words, evidence in facets:
        used = F.array_compact(F.array(*[F.when(question.contains(w), F.lit(w)) for w in words]))
        found.append(F.when(contains_any(question, words), requirement(F.lit(f"facet:{id_}"), F.lit(description), used, matching(rows, evidence))))
    hops = F.concat(explicit, F.array_compact(F.array(*found)))
    gap = F.array(requirement(F.lit("facet:unresolved_second_hop"), F.lit("second condition not recognised"), F.array(), F.array()))
    several = F.when(F.size(hops) < 2, F.concat(hops, gap)).otherwise(hops)
    needs = F.when(is_multi_hop(route), several).otherwise(explicit)
    return F.struct(F.when(F.size(needs) > 0, "explicit_articles_and_query_facets").otherwise("no_additional_requirements").alias("strategy"), needs.alias("requirements"), coverage(needs).alias("coverage"))


def coverage(requirements: Column) -> Column:
    met = F.size(F.filter(requirements, lambda r: F.size(r["satisfied_article_ids"]) > 0))
    return F.try_divide(met.cast("double"), F.size(requirements).cast("double"))


def with_plan(frame: DataFrame) -> DataFrame:
    """Adds evidence_plan to question, route, required and rows."""
    return frame.withColumn("evidence_plan", evidence_plan(F.col("question"), F.col("route"), F.col("required"), F.col("rows")))
