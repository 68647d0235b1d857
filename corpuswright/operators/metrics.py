"""Evaluation: rates, confusion, percentiles, thresholds, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import fixed, tasks_for
from .windows import MOST, hot


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def binary_counts(label: Column, predicted: Column) -> dict[str, Column]:
    return {"tp": F.count_if(label & predicted), "fp": F.count_if(~label & predicted), "fn": F.count_if(label & ~predicted), "tn": F.count_if(~label & ~predicted)}


def binary_rates(c) -> list[Column]:
    """Rates from the columns tp, fp, fn and tn."""
    tp, fp, fn, tn = (c(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return [
        n.alias("count"), rate(tp + tn, n).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"),
        rate(tp + fp, n).alias("activation_rate"), rate(fp, fp + tn).alias("false_activation_rate"), rate(fn, fn + tp).alias("missed_rate"), tp, fp, fn, tn,
    ]


def binary_metrics(rows: DataFrame, label: Column, predicted: Column, *more: Column, by: tuple[str, ...] = ()) -> DataFrame:
    counts = rows.groupBy(*by).agg(*[c.alias(k) for k, c in binary_counts(label.cast("boolean"), predicted.cast("boolean")).items()], *more)
    extra = [x for x in counts.columns if x not in ("tp", "fp", "fn", "tn", *by)]
    return counts.select(*by, *binary_rates(F.col), *extra)


def threshold_search(rows: DataFrame, label: str, risk: str, least_recall: float) -> DataFrame:
    """The best of the thresholds 0.01 to 0.99 for risk >= threshold, in one pass over the rows.

    Rows are counted by the number of thresholds that they reach, so what meets the thresholds is a hundred sums. Among
    those with the recall (or all, if none has it): accuracy, then specificity, then fewer activations, then the threshold.
    """
    spark = rows.sparkSession
    steps = spark.range(1, 100).select((F.col("id") / 100.0).alias("threshold"), F.col("id").cast("int").alias("step"))
    # thresholds reached, by comparison with the same quotients that the steps are
    level = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: i / 100.0), lambda t: F.col(risk) >= t))
    sums = rows.groupBy(level.alias("level")).agg(F.count_if(F.col(label).cast("boolean")).alias("pos"), F.count_if(~F.col(label).cast("boolean")).alias("neg"))
    counts = F.broadcast(steps).join(sums, F.lit(True), "cross").groupBy("threshold").agg(
        F.sum(F.when(F.col("level") >= F.col("step"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("level") >= F.col("step"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("level") < F.col("step"), F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("level") < F.col("step"), F.col("neg")).otherwise(0)).alias("tn"),
    )
    rated = counts.select("threshold", *binary_rates(F.col))
    feasible = F.coalesce(F.col("recall"), F.lit(0.0)) >= least_recall
    key = F.struct(feasible, "accuracy", F.coalesce("specificity", F.lit(0.0)), -F.col("activation_rate"), "threshold")
    return rated.groupBy().agg(F.max_by(F.struct(*rated.columns), key).alias("best")).filter("best is not null").select("best.*")


def confusion(rows: DataFrame, expected: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row for each label, with a column for each label and the label's accuracy; zero where nothing falls."""
    frame = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in labels], "expected string"))
    counts = rows.groupBy(F.col(expected).alias("expected")).agg(*[F.count_if(F.col(predicted) == x).alias(x) for x in labels], F.count_if(F.col(expected) == F.col(predicted)).alias("hit"), F.count(F.lit(1)).alias("n"))
    return frame.join(counts, "expected", "left").select("expected", *[F.coalesce(x, F.lit(0)).alias(x) for x in labels], rate(F.col("hit"), F.col("n")).alias("accuracy"))


def linear_percentile(c: Column | str, q: float) -> Column:
    """Interpolated between neighbours."""
    return F.percentile(c, q)


def nearest_rank(c: str, q: float) -> Column:
    """The value at rank ceil(q n)."""
    return F.expr(f"percentile_disc({q}) within group (order by {c})")


def score_separation(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Score ranges of both classes and a threshold: the midpoint if they are apart, else just below the positives' lowest."""
    s = rows.agg(F.min(F.when(positive, score)).alias("positive_min"), F.max(F.when(positive, score)).alias("positive_max"), F.min(F.when(~positive, score)).alias("negative_min"), F.max(F.when(~positive, score)).alias("negative_max"))
    apart = F.col("positive_min") > F.col("negative_max")
    return s.withColumn("separable", apart).withColumn("threshold", F.when(apart, (F.col("positive_min") + F.col("negative_max")) / 2).otherwise(F.col("positive_min") - 0.01))


def first_hit(ranked: DataFrame, hit: Column, by: tuple[str, ...]) -> DataFrame:
    """The rank of the first hit of each query, null without one."""
    return ranked.groupBy(*by).agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"))


def recall_mrr(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of queries with a hit, and the mean reciprocal rank (0 without a hit), from hit_rank."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("hit_rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"))


def citation_metrics(citations: DataFrame, known: DataFrame, gold: DataFrame) -> DataFrame:
    """Per answer: citations that exist, and that are gold. citations: answer_id, article_id; known: article_id; gold: answer_id, article_id."""
    parts, none = tasks_for(citations), F.lit(None).cast("boolean")
    known = known.select("article_id", F.lit(True).alias("valid")).distinct()
    if known.limit(2_000_001).count() <= 2_000_000:
        said = citations.join(F.broadcast(known), "article_id", "left")
    else:
        said = citations.repartition(parts, "article_id").join(known.repartition(parts, "article_id"), "article_id", "left")
    said = said.select("answer_id", "article_id", F.lit(True).alias("said"), "valid", none.alias("right"))
    # an answer's rows meet once, and are then made distinct, marked and summed up where they are
    right = gold.filter("answer_id is not null and article_id is not null").select("answer_id", "article_id", none.alias("said"), none.alias("valid"), F.lit(True).alias("right"))
    met = said.unionByName(right).repartition(parts, "answer_id").groupBy("answer_id", "article_id")
    marked = met.agg(F.max("said").alias("said"), F.max("valid").alias("valid"), F.max("right").alias("right")).filter("said")
    return marked.groupBy("answer_id").agg(F.count(F.lit(1)).alias("citations"), F.coalesce(rate(F.count("valid"), F.count(F.lit(1))), F.lit(0.0)).alias("validity"), rate(F.count("right"), F.count(F.lit(1))).alias("correctness"))


def tally(rows: DataFrame, pairing: str, winner: str, outcomes: list[str]) -> DataFrame:
    return rows.groupBy(pairing).pivot(winner, outcomes).count().na.fill(0)


def summed_modes(rows: DataFrame) -> DataFrame:
    """Per mode: recall and MRR of answerable queries, precision and recall of refusals, refinement rates. rows: mode, answerable, decision, hit_rank, outcome."""
    refused, open_ = F.col("decision") == "refuse", F.col("answerable")
    return rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("queries"), rate(F.count_if(open_ & F.col("hit_rank").isNotNull()), F.count_if(open_)).alias("recall"),
        F.avg(F.when(open_, F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))).alias("mrr"),
        rate(F.count_if(refused & ~open_), F.count_if(refused)).alias("refusal_precision"), rate(F.count_if(refused & ~open_), F.count_if(~open_)).alias("refusal_recall"),
        rate(F.count_if(F.col("decision") == "refine_once"), F.count(F.lit(1))).alias("activation_rate"), F.count_if(F.col("outcome") == "rescue").alias("rescues"), F.count_if(F.col("outcome") == "regression").alias("regressions"),
    )


def faithfulness(scores: DataFrame, low: float = 0.7) -> DataFrame:
    return scores.agg(F.avg("faithfulness").alias("faithfulness"), F.avg("relevancy").alias("relevancy"), F.array_sort(F.collect_list(F.when(F.col("faithfulness") < low, F.col("id")))).alias("low"))


def adopted(candidate: Column, rule: Column) -> Column:
    """Whether a candidate has at least the rule's recall and accuracy, and activates and falsely activates less; a rate that isn't defined counts as 0."""
    of = lambda c, name: F.coalesce(c[name], F.lit(0.0))
    more = [of(candidate, x) >= of(rule, x) for x in ("recall", "accuracy")]
    less = [of(candidate, x) < of(rule, x) for x in ("activation_rate", "false_activation_rate")]
    return more[0] & more[1] & less[0] & less[1]


def group_percentiles(rows: DataFrame, by: str, value: str, qs: list[float], most: int = MOST) -> DataFrame:
    """by, q, linear (interpolated) and nearest (value at rank ceil(q n)), exact for groups of any size; nulls don't count.

    Groups of up to `most` rows are aggregated at once. Larger ones are narrowed first: an approximate pass gives each
    quantile a band that must hold it, rows below the band are counted, and only the band's distinct values are ordered.
    """
    rows = rows.select(F.col(by).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    if not hot(rows, "k", most):
        each = [F.struct(F.lit(q).alias("q"), F.percentile("v", q).alias("linear"), nearest_rank("v", q).alias("nearest")) for q in qs]
        out = rows.groupBy("k").agg(F.array(*each).alias("p")).select("k", F.inline("p"))
        return out.select(F.col("k").alias(by), "q", "linear", "nearest")
    slack = 2e-4  # twice the error of an approximate percentile of accuracy 10,000
    ends = [0.0, 1.0] + [x for q in qs for x in (max(0.0, q - slack), min(1.0, q + slack))]
    # in a small group the slack is less than a rank, so its band is all of it
    end = lambda i, whole: F.when(F.col("n") < 20_000, F.col("e")[whole]).otherwise(F.col("e")[i])
    bands = rows.groupBy("k").agg(F.count("v").alias("n"), F.percentile_approx("v", ends, 10_000).alias("e"))
    bands = bands.select("k", "n", F.posexplode(F.array(*[F.struct(F.lit(q).alias("q"), end(2 * i + 2, 0).alias("low"), end(2 * i + 3, 1).alias("high")) for i, q in enumerate(qs)])).alias("i", "b")).select("k", "n", "b.*")
    bands = fixed(bands).withColumnRenamed("k", "of")
    met = rows.join(bands, F.col("k").eqNullSafe(F.col("of")) & (F.col("v") <= F.col("high"))).select("k", "n", "q", "low", "v")
    counts = met.groupBy("k", "q", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("k", "q").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("c").over(w)).filter("v is not null")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    place = F.col("q") * (F.col("n") - 1)
    found = upto.groupBy("k", "q", "n").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), at(F.greatest(F.ceil(F.col("q") * F.col("n")) - 1, F.lit(0))).alias("nearest"))
    return found.select(F.col("k").alias(by), "q", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("linear"), "nearest")
