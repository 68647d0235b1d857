"""The gate between retrieval and answer: signals, rules and decisions as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sigmoid

#: Thresholds of the baseline and the modes' switches: whether the gate decides, whether it may refine, whether routes count.
BASELINE_TOP1 = 0.636
MODES = (("current_baseline", False, False, False), ("confidence_gate_only", True, False, False), ("refinement_enabled", True, True, False), ("full_adaptive_route", True, True, True))


@dataclass(frozen=True)
class Policy:
    min_top1: float = 0.60
    strong_top1: float = 0.69
    min_margin: float = 0.015
    min_overlap_count: int = 1
    min_overlap_jaccard: float = 0.03
    max_refinements: int = 1
    max_query_tokens: int = 384


def refuse_before_generation(candidates: Column, top1: Column, least: float = BASELINE_TOP1) -> Column:
    """No candidate refuses; a missing score doesn't; a score below the threshold does."""
    return F.when(candidates == 0, True).when(top1.isNull(), False).otherwise(top1 < least)


def covered_signals(required: Column, direct: Column, graph: Column) -> dict[str, Column]:
    """Coverage of the required articles (null without any) and whether the graph alone brought one."""
    need = F.array_distinct(required)
    met = F.size(F.array_intersect(need, F.array_union(direct, graph))).cast("double")
    return {
        "required_article_coverage": F.try_divide(met, F.size(need).cast("double")),
        "graph_added_required_article": F.size(F.array_intersect(need, F.array_except(graph, direct))) > 0,
    }


def gate_signals(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """top1 and margin of each query from ranked hits (rank, score nullable), with the articles in order of rank."""
    ranked = F.filter(F.array_sort(F.collect_list(F.struct("rank", "score", "article_id"))), lambda x: x["score"].isNotNull())
    out = hits.groupBy(key).agg(ranked.alias("scored"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"])).alias("retrieved_articles"))
    first, second = F.get("scored", F.lit(0))["score"], F.get("scored", F.lit(1))["score"]
    return out.select(key, first.alias("top1_rerank"), (first - second).alias("top1_top2_margin"), "retrieved_articles")


def triggered_rules(s, policy: Policy) -> Column:
    """Names of the rules that fire, in the rules' order. s: a function from a signal's name to its column."""
    top1, margin = s("top1_rerank"), s("top1_top2_margin")
    required, evidence = s("required_article_coverage"), s("evidence_requirement_coverage")
    rules = [
        F.when(top1.isNull(), "missing_reranker_score").when(top1 < policy.min_top1, "low_top1").when(top1 >= policy.strong_top1, "strong_top1"),
        F.when(margin < policy.min_margin, "small_top1_top2_margin"),
        F.when(~overlap_ok(s, policy), "no_lexical_semantic_overlap"),
        F.when(required == 0, "explicit_article_missing").when(required < 1, "partial_explicit_article_coverage"),
        F.when(s("graph_added_required_article"), "graph_rescued_required_article"),
        F.when(s("ambiguous_or_multi_hop"), "ambiguous_or_multi_hop"),
        F.when(evidence < 1, "incomplete_evidence_requirements"),
    ]
    return F.array_compact(F.array(*rules))


def overlap_ok(s, policy: Policy) -> Column:
    return (s("bm25_dense_overlap_count") >= policy.min_overlap_count) | (s("bm25_dense_overlap_jaccard") >= policy.min_overlap_jaccard)


def grade(s, refinements: Column, policy: Policy = Policy()) -> Column:
    """decision, confidence and rules_triggered from the signals; a missing signal speaks neither way, a missing score against."""
    no = F.lit(False)
    top1, overlap = s("top1_rerank"), overlap_ok(s, policy)
    required, evidence = s("required_article_coverage"), s("evidence_requirement_coverage")
    low = F.coalesce(top1 < policy.min_top1, no)
    absent = top1.isNull() | F.coalesce(required == 0, no)
    partial = F.coalesce((required < 1) & (required != 0), no)
    incomplete = F.coalesce(evidence < 1, no)
    hard = absent | (low & ~overlap)
    unsure = s("ambiguous_or_multi_hop") | ~overlap | partial | F.coalesce(s("top1_top2_margin") < policy.min_margin, no) | incomplete | F.coalesce(top1 < policy.strong_top1, no)
    end = absent | low | ~overlap | incomplete
    refine = (refinements < policy.max_refinements) & (hard | unsure)
    decision = F.when(refine, "refine_once").when(end, "refuse").otherwise("answer")
    confidence = F.when(refine, 0.78).when(end, 0.92).otherwise(0.86)
    return F.struct(decision.alias("decision"), confidence.alias("confidence"), triggered_rules(s, policy).alias("rules_triggered"))


def graded(signals: DataFrame, refinements: int = 0, policy: Policy = Policy()) -> DataFrame:
    return signals.withColumn("gate", grade(F.col, F.lit(refinements), policy))


def with_modes(signals: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Each query under each mode: mode, decision and refused. Routes are masked where the mode doesn't count them; a mode that can't refine refuses what it would have to."""
    spark = signals.sparkSession
    modes = spark.createDataFrame(MODES, "mode string, gated boolean, refines boolean, routes boolean")
    both = signals.crossJoin(F.broadcast(modes))
    masked = both.withColumn("ambiguous_or_multi_hop", F.col("ambiguous_or_multi_hop") & F.col("routes"))
    gate = grade(F.col, F.lit(0), policy)["decision"]
    base = F.when(F.coalesce(F.col("top1_rerank") < BASELINE_TOP1, F.lit(True)), "refuse").otherwise("answer")
    decided = masked.withColumn("decision", F.when(F.col("gated"), gate).otherwise(base))
    refused = F.when(F.col("refines"), F.col("decision") == "refuse").otherwise(F.col("decision") != "answer")
    return decided.withColumn("refused", refused).drop("gated", "refines", "routes")


def corrective_outcome(before: Column, after: Column) -> Column:
    """What a refinement did to a hit: rescue, regression or neutral."""
    return F.when(~before & after, "rescue").when(before & ~after, "regression").otherwise("neutral")


def within_budget(tokens: Column, policy: Policy = Policy()) -> Column:
    return tokens <= policy.max_query_tokens


FEATURES = (
    "top1_rerank", "top1_missing", "top1_top2_margin", "margin_missing", "bm25_dense_overlap_count", "bm25_dense_overlap_jaccard",
    "required_article_coverage", "has_required_articles", "graph_added_required_article", "ambiguous_or_multi_hop",
    "evidence_requirement_coverage", "has_evidence_requirements",
)


def gate_features(s=F.col) -> list[Column]:
    """The twelve features of the linear gate as doubles; a coverage without requirements counts as full."""
    double = lambda c: c.cast("double")
    made = {
        "top1_rerank": F.coalesce(s("top1_rerank"), F.lit(0.0)), "top1_missing": double(s("top1_rerank").isNull()),
        "top1_top2_margin": F.coalesce(s("top1_top2_margin"), F.lit(0.0)), "margin_missing": double(s("top1_top2_margin").isNull()),
        "bm25_dense_overlap_count": double(F.coalesce(s("bm25_dense_overlap_count"), F.lit(0))), "bm25_dense_overlap_jaccard": F.coalesce(s("bm25_dense_overlap_jaccard"), F.lit(0.0)),
        "required_article_coverage": F.coalesce(s("required_article_coverage"), F.lit(1.0)), "has_required_articles": double(F.size(F.coalesce(s("required_articles"), F.array().cast("array<string>"))) > 0),
        "graph_added_required_article": double(F.coalesce(s("graph_added_required_article"), F.lit(False))), "ambiguous_or_multi_hop": double(F.coalesce(s("ambiguous_or_multi_hop"), F.lit(False))),
        "evidence_requirement_coverage": F.coalesce(s("evidence_requirement_coverage"), F.lit(1.0)), "has_evidence_requirements": double(s("evidence_requirement_coverage").isNotNull()),
    }
    return [double(made[f]).alias(f) for f in FEATURES]


def risk(intercept: float, coefficients: dict[str, float], means: dict[str, float], scales: dict[str, float]) -> Column:
    """The linear gate's risk, one expression over the feature columns."""
    z = F.lit(float(intercept))
    for f, weight in coefficients.items():
        z = z + F.lit(float(weight)) * (F.col(f) - F.lit(float(means[f]))) / F.lit(float(scales[f]))
    return sigmoid(z)
