"""Measuring a gate on a dataset, calibrating a linear one against the rules, and deciding on its adoption by a holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, gate, metrics, mlgate, retrieval, routing
from .pipeline import Corpus, graded
from .shared import fixed


def measure(corpus: Corpus, items: DataFrame, aliases: dict[str, str] | None = None, scorer=retrieval.overlap_score) -> DataFrame:
    """Each item with its route, what retrieval and graph made available, the gate's features and rule, and whether the evidence is short of what it needs.

    items: id, question, stratum, expected_route, answerable, expected (array of article ids). Every item is retrieved,
    whatever its route. evidence_complete: answerable, and all expected articles available; needs_correction: not that.
    """
    asked = items.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "stratum", "expected_route", "answerable", "expected")
    asked = asked.withColumn("route", routing.route_question(F.col("text"), aliases)).withColumn("required", routing.required_articles(F.col("text"), aliases)).withColumn("query", F.col("text"))
    by = asked.select("query_id", "text")
    rows = graded(corpus, fixed(asked), by.withColumn("ord", F.lit(0)), by, 0, scorer).withColumn("required_articles", F.col("required"))
    available = F.array_sort(F.array_distinct(F.concat("retrieved_articles", "graph_articles")))
    complete = F.col("answerable") & evaluation.includes(available, F.col("expected"))
    made = rows.select("*", available.alias("available"), complete.alias("evidence_complete"))
    return made.select(
        F.col("query_id").alias("id"), "stratum", "expected_route", F.col("route.route").alias("actual_route"), "answerable", "expected", "available", "evidence_complete", (~F.col("evidence_complete")).alias("needs_correction"),
        F.col("gate.decision").alias("rule_decision"), (F.col("gate.decision") != "answer").alias("rule_activates"), *gate.gate_features(),
    )


def route_accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(metrics.rate(F.count_if(F.col("expected_route") == F.col("actual_route")), F.count(F.lit(1))).alias("route_accuracy"), F.count(F.lit(1)).alias("items"), F.count_if("needs_correction").alias("needs_correction"))


def rates_of(rows: DataFrame, predicted: str) -> DataFrame:
    return metrics.binary_metrics(rows, F.col("needs_correction"), F.col(predicted))


def calibrate(rows: DataFrame, features: tuple[str, ...] = gate.FEATURES, epochs: int = 1200) -> tuple[mlgate.LinearGate, float]:
    """A linear gate trained on all measured rows, and the threshold that out-of-fold risks choose under the rules' recall."""
    labelled = rows.withColumnRenamed("needs_correction", "label")
    least = rates_of(rows, "rule_activates").first()["recall"] or 0.0
    risks = mlgate.out_of_fold(labelled, "id", features, epochs=epochs)
    best = metrics.threshold_search(risks, "label", "risk", least).first()
    return mlgate.train(labelled, features, epochs=epochs), best["threshold"]


def judged(rows: DataFrame, risk: str, threshold: float) -> DataFrame:
    """One row: the rules' and the candidate's rates side by side, and whether the candidate is adopted. rows: needs_correction, rule_activates and a risk."""
    label = F.col("needs_correction")
    rule = metrics.binary_metrics(rows, label, F.col("rule_activates"))
    candidate = metrics.binary_metrics(rows, label, F.col(risk) >= threshold)
    both = rule.select(F.struct("*").alias("rule")).crossJoin(candidate.select(F.struct("*").alias("candidate")))
    return both.withColumn("adopted", metrics.adopted(F.col("candidate"), F.col("rule")))


class HoldoutSpent(RuntimeError):
    """A candidate that has read its holdout already, or another cycle's."""


def read_once(artifact: dict, cycle: str) -> dict:
    """The artifact as it is after its only reading of the holdout of its own cycle."""
    if artifact.get("adoption_state") != "pending_holdout":
        raise HoldoutSpent("the candidate isn't frozen for a first reading")
    if artifact.get("cycle_id") != cycle:
        raise HoldoutSpent("the holdout is of another cycle")
    return artifact | {"adoption_state": "holdout_read", "holdout_reads": 1}
