"""Evaluation over whole runs: datasets that are prepared, frozen and locked, answers' citations, strategies and end-to-end telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_citations, long_tail, question_hash, sanitize_question, sha256_json, valid_question
from ..plans.shared import fixed
from . import digests, retrieval
from .metrics import nearest_rank, rate

# fixed values: routes of questions, and those that need no article
ROUTES = ("no_retrieval", "structured", "single_hop", "global_or_multi_hop", "corrective_candidate")
WITHOUT_ARTICLES = ("no_retrieval", "structured")
LONG_TAIL_COUNT = 10


class DatasetError(ValueError):
    """A dataset that doesn't keep its rules."""


def includes(available: Column, expected: Column) -> Column:
    """Whether all expected ids are available; nothing expected always is."""
    return F.size(F.array_except(expected, available)) == 0


def strategy_hits(retriever: retrieval.Retriever, docs: DataFrame, questions: DataFrame, strategies: dict[str, DataFrame], gold: DataFrame, scorer=retrieval.overlap_score) -> DataFrame:
    """strategy, hits and queries: questions with a gold document among the first five, by the queries that a strategy asks of them.

    strategies: queries by name (query_id, ord, text), of which the first is what candidates are ranked again by; gold:
    query_id, doc_id. A question that a strategy leaves out is no hit.
    """
    total, every = gold.select("query_id").distinct().agg(F.count(F.lit(1)).alias("queries")), None
    for name, queries in strategies.items():
        part = queries.select(F.lit(name).alias("strategy"), "query_id", "ord", "text")
        every = part if every is None else every.unionByName(part)
    # one retrieval for all: a strategy's question has a key of its own
    every = fixed(every.withColumn("key", F.to_json(F.array("strategy", F.col("query_id").cast("string")))))
    queries = every.select(F.col("key").alias("query_id"), "ord", "text")
    first = queries.groupBy("query_id").agg(F.min_by("text", "ord").alias("text"))
    final = retrieval.rerank(retrieval.retrieve_multi(retriever, queries).fused, docs, first, scorer).select(F.col("query_id").alias("key"), "doc_id")
    hits = final.join(every.select("key", "strategy", "query_id").distinct(), "key").join(gold, ["query_id", "doc_id"], "left_semi").groupBy("strategy").agg(F.count_distinct("query_id").alias("hits"))
    names = gold.sparkSession.createDataFrame([(name,) for name in strategies], "strategy string")
    return names.join(hits, "strategy", "left").select("strategy", F.coalesce("hits", F.lit(0)).alias("hits")).crossJoin(F.broadcast(total))


def answer_metrics(answers: DataFrame, laws: DataFrame, expected: DataFrame) -> DataFrame:
    """answer_id, citations, cited (sorted ids of those that exist), coverage and validity of each answer.

    answers: answer_id, text; laws: law_name, article_no, article_id; expected: answer_id, article_id. Validity counts each
    citation, repeated ones too, and is 0 without any; coverage is the share of the expected articles that are cited, null
    where none is expected.
    """
    cited = answers.select("answer_id", F.posexplode(extract_citations(F.col("text"))).alias("at", "c")).select("answer_id", "at", "c.law_name", "c.article_no")
    known = laws.groupBy("law_name", "article_no").agg(F.max("article_id").alias("article_id"))
    marked = cited.join(known, ["law_name", "article_no"], "left")
    want = expected.distinct().withColumn("wanted", F.lit(True))
    once = marked.filter("article_id is not null").select("answer_id", "article_id").distinct().withColumn("said", F.lit(True))
    met = want.join(once, ["answer_id", "article_id"], "left").groupBy("answer_id").agg(rate(F.count("said"), F.count(F.lit(1))).alias("coverage"))
    sums = marked.groupBy("answer_id").agg(F.count(F.lit(1)).alias("citations"), rate(F.count("article_id"), F.count(F.lit(1))).alias("validity"), F.array_sort(F.collect_set("article_id")).alias("cited"))
    out = answers.select("answer_id").join(sums, "answer_id", "left").join(met, "answer_id", "left")
    return out.select("answer_id", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"), "coverage", F.coalesce("validity", F.lit(0.0)).alias("validity"))


def frozen_answer(answerable: Column, refused: Column, changed: Column, coverage: Column, validity: Column) -> Column:
    """answer_source, correctness, coverage and validity of an answer that was kept from an earlier run: it counts only if the evidence is still the same."""
    none = F.lit(None).cast("double")
    made = lambda source, a, b, c: F.struct(F.lit(source).alias("answer_source"), a.alias("correctness"), b.alias("coverage"), c.alias("validity"))
    right = ((F.coalesce(coverage, F.lit(0.0)) > 0) & (validity == 1.0)).cast("double")
    return (
        F.when(~answerable, made("not_applicable_unanswerable", none, none, none)).when(refused, made("refused", F.lit(0.0), F.lit(0.0), none))
        .when(changed, made("not_evaluated_changed_evidence", none, none, none)).otherwise(made("frozen_baseline_reused", right, coverage, validity))
    )


def end_to_end(rows: DataFrame) -> DataFrame:
    """One row that sums up served answers with their traces.

    rows: answerable, refused, hit_rank, answer_correctness, citation_coverage, citation_validity, support_rate,
    removed_count, judge_error, and of the trace latency_ms, token_usage and shadow_adaptive. Latency percentiles are
    nearest ranks; rates without anything to count are null, but those of refinements 0.
    """
    open_, refused = F.col("answerable"), F.col("refused")
    shadow = F.col("shadow_adaptive")
    has, ran = shadow.isNotNull(), F.coalesce(shadow["refinement_executed"], F.lit(False))
    first, last = shadow["initial_gate"]["decision"], shadow["final_gate"]["decision"]
    answered = F.coalesce(last == "answer", F.lit(False))
    rescued, regressed = ran & F.coalesce(first == "refine_once", F.lit(False)) & answered, ran & F.coalesce(first == "answer", F.lit(False)) & ~answered
    main, side = F.coalesce(F.col("token_usage")["total_tokens"], F.lit(0)), F.coalesce(shadow["token_usage"]["total_tokens"], F.lit(0))
    timed = rows.withColumn("__ms", F.coalesce(F.col("latency_ms")["total"], F.lit(0.0)))
    sums = timed.agg(
        F.count(F.lit(1)).alias("item_count"), F.count_if(open_).alias("answerable_count"), F.count_if(~open_).alias("unanswerable_count"),
        rate(F.count_if(open_ & (F.col("hit_rank") <= 5)), F.count_if(open_)).alias("recall_at_5"), F.avg(F.when(open_, F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))).alias("mrr"),
        F.count(F.when(open_, F.col("hit_rank"))).alias("observed_hits"), F.avg(F.when(open_, F.col("answer_correctness"))).alias("correctness"),
        F.avg(F.when(open_, F.col("citation_coverage"))).alias("coverage"), F.avg(F.when(open_, F.col("citation_validity"))).alias("validity"), F.avg(F.when(open_, F.col("support_rate"))).alias("support_rate"),
        F.count_if(~open_ & refused).alias("tp"), F.count_if(open_ & refused).alias("fp"), F.count_if(~open_ & ~refused).alias("fn"),
        nearest_rank("__ms", 0.5).alias("p50"), nearest_rank("__ms", 0.95).alias("p95"), F.sum(main).alias("main_tokens"), F.sum(side).alias("shadow_tokens"),
        F.count_if(has).alias("shadow_count"), F.count_if(has & ~F.coalesce(first == "answer", F.lit(False))).alias("activated"), F.count_if(ran).alias("refined"),
        F.count_if(rescued).alias("rescued"), F.count_if(regressed).alias("regressed"), F.sum(F.col("removed_count")).alias("removed_sentences"), F.count_if("judge_error").alias("judge_errors"),
    )
    c = F.col
    return sums.select(
        "item_count", "answerable_count", "unanswerable_count", "recall_at_5", "mrr", "observed_hits", "correctness", "coverage", "validity", "support_rate", "tp", "fp", "fn",
        rate(c("tp"), c("tp") + c("fp")).alias("refusal_precision"), rate(c("tp"), c("tp") + c("fn")).alias("refusal_recall"), "p50", "p95", "main_tokens", "shadow_tokens",
        (c("main_tokens") + c("shadow_tokens")).alias("combined_tokens"), F.coalesce(rate(c("main_tokens") + c("shadow_tokens"), c("item_count")), F.lit(0.0)).alias("tokens_per_query"),
        "shadow_count", rate(c("activated"), c("shadow_count")).alias("activation_rate"), rate(c("refined"), c("shadow_count")).alias("refinement_rate"),
        F.coalesce(rate(c("rescued"), c("refined")), F.lit(0.0)).alias("rescue_rate"), F.coalesce(rate(c("regressed"), c("refined")), F.lit(0.0)).alias("regression_rate"), "removed_sentences", "judge_errors",
    )


def candidate_problems(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """ord and problem of the candidates (ord, question) that can't enter a blind packet: empty, overlaps or duplicate. known: question_hash of earlier evaluations."""
    asked = candidates.select("ord", F.regexp_replace(F.coalesce("question", F.lit("")), r"(?U)^\s+|\s+$", "").alias("question")).withColumn("question_hash", question_hash(F.col("question")))
    first = asked.filter("question <> ''").groupBy("question_hash").agg(F.min("ord").alias("first"))
    marked = asked.join(known.select("question_hash", F.lit(True).alias("seen")).distinct(), "question_hash", "left").join(first, "question_hash", "left")
    problem = F.when(F.col("question") == "", "empty").when(F.col("seen"), "overlaps").when(F.col("ord") > F.col("first"), "duplicate")
    return marked.select("ord", problem.alias("problem")).filter("problem is not null")


def prepare_packet(candidates: DataFrame, known: DataFrame, least: int = 100) -> DataFrame:
    """id, question, query_sha256, source and stratum of candidates (ord, id, question, source, stratum) for annotation; an error if any has a problem or there are too few."""
    wrong = candidate_problems(candidates, known).orderBy("ord").limit(1).collect()
    if wrong:
        raise DatasetError(f"candidate {wrong[0].ord}: {wrong[0].problem}")
    if (n := candidates.count()) < least:
        raise DatasetError(f"at least {least} candidates are needed, there are {n}")
    bare = F.regexp_replace("question", r"(?U)^\s+|\s+$", "")
    return candidates.select(F.coalesce("id", F.format_string("prod-%04d", "ord")).alias("id"), bare.alias("question"), question_hash(bare).alias("query_sha256"), F.coalesce("source", F.lit("anonymized_production")).alias("source"), F.coalesce("stratum", F.lit("unassigned")).alias("stratum"))


def annotation_problems(items: DataFrame) -> DataFrame:
    """id and problem (the first) of annotated items that can't be frozen. items: id, expected_route, answerable, reviewed, reviewer, expected_article_ids."""
    problem = (
        F.when(~F.coalesce(F.col("expected_route").isin(*ROUTES), F.lit(False)), "expected_route").when(F.col("answerable").isNull(), "answerable")
        .when(~F.coalesce(F.col("reviewed"), F.lit(False)) | (F.coalesce("reviewer", F.lit("")) == ""), "review").when(F.col("expected_article_ids").isNull(), "expected_article_ids")
        .when(F.col("answerable") & ~F.col("expected_route").isin(*WITHOUT_ARTICLES) & (F.size("expected_article_ids") == 0), "articles_needed")
    )
    return items.select("id", problem.alias("problem")).filter("problem is not null")


def dataset_hash(items: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """One row, item_count and dataset_sha256: a hash over the items' hashes in order. An item's hash goes over its fields as compact JSON."""
    found = digests.ordered(items, None, [F.col(order), sha256_json({f: F.col(f) for f in fields})], sha256_json({f: F.col(f) for f in fields}))
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("item_count"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("dataset_sha256"))


def freeze(items: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Annotated items and their manifest (item_count, dataset_sha256), locked; an error if any is incomplete or there are too few."""
    if (n := items.count()) < least:
        raise DatasetError(f"cannot freeze fewer than {least} items, there are {n}")
    wrong = annotation_problems(items).orderBy("id").limit(1).collect()
    if wrong:
        raise DatasetError(f"{wrong[0].id}: {wrong[0].problem}")
    return items, dataset_hash(items, "id", ["id", "question", "expected_route", "answerable", "expected_article_ids"])


def verify_dataset(head: dict, items_hash: str, split: str) -> None:
    """An error unless the dataset is locked, of this split, valid, no claim of production, and its items have its hash."""
    if head.get("split") != split or not head.get("locked"):
        raise DatasetError(f"the {split} dataset isn't locked")
    if head.get("represents_production_distribution") is not False:
        raise DatasetError("a proxy must not claim to represent production")
    if str(head.get("evaluation_validity", "")).startswith("invalid"):
        raise DatasetError("the dataset was invalidated")
    if head.get("dataset_sha256") != items_hash:
        raise DatasetError(f"the {split} dataset's hash differs")


def locked_items(answerable: DataFrame, hard: DataFrame, traps: DataFrame) -> DataFrame:
    """id, numeric_id, question, answerable, expected and category of the three groups. answerable: id, question, expected, category; hard: ord, question, expected; traps: ord, question."""
    a = answerable.select(F.format_string("a-%02d", "id").alias("id"), F.col("id").cast("long").alias("numeric_id"), "question", F.lit(True).alias("answerable"), "expected", "category")
    h = hard.select(F.format_string("h-%02d", "ord").alias("id"), F.lit(None).cast("long").alias("numeric_id"), "question", F.lit(True).alias("answerable"), "expected", F.lit("long_tail").alias("category"))
    u = traps.select(F.format_string("u-%02d", "ord").alias("id"), F.lit(None).cast("long").alias("numeric_id"), "question", F.lit(False).alias("answerable"), F.array().cast("array<string>").alias("expected"), F.lit("unanswerable").alias("category"))
    return a.unionByName(h).unionByName(u)


def chosen_questions(replies: DataFrame, known: DataFrame, law_names: tuple[str, ...] = ()) -> DataFrame:
    """id and question: of the cached replies of each id (id, attempt, reply) the first that is a valid question, not known and not taken by an earlier id. An id without one has no row, and has to be asked again."""
    clean = replies.select("id", "attempt", sanitize_question(F.col("reply"), law_names).alias("question")).withColumn("question_hash", question_hash(F.col("question")))
    fine = clean.filter(valid_question(F.col("question"), law_names)).join(known.select("question_hash"), "question_hash", "left_anti")
    first = fine.groupBy("id").agg(F.min_by(F.struct("question", "question_hash"), "attempt").alias("q")).select("id", "q.*")
    return first.groupBy("question_hash").agg(F.min(F.struct("id", "question")).alias("x")).select("x.id", "x.question")


def materialised(specs: DataFrame, questions: DataFrame, split: str, tails: int = LONG_TAIL_COUNT) -> DataFrame:
    """Items of generated questions: id, question, stratum, expected_route, expected, source_laws. specs: spec_no, id, sources (array of article_id, law_name); questions: id, question.

    Of the holdout's questions of one source the first `tails` get a typing error and a stratum of their own.
    """
    rows = specs.join(questions, "id")
    several = F.size("sources") > 1
    if split == "holdout":
        first = rows.filter(~several).select("id", "spec_no").orderBy("spec_no").limit(tails).select("id", F.lit(True).alias("tail"))
        rows = rows.join(F.broadcast(first), "id", "left").withColumn("tail", F.coalesce("tail", F.lit(False)))
    else:
        rows = rows.withColumn("tail", F.lit(False))
    return rows.select(
        "id", F.when(F.col("tail"), long_tail(F.col("question"))).otherwise(F.col("question")).alias("question"),
        F.when(several, "multi_hop").when(F.col("tail"), "long_tail_typo").otherwise("single_hop").alias("stratum"), F.when(several, "global_or_multi_hop").otherwise("single_hop").alias("expected_route"),
        F.transform("sources", lambda s: s["article_id"]).alias("expected"), F.array_distinct(F.transform("sources", lambda s: s["law_name"])).alias("source_laws"),
    )


def usable_sources(articles: DataFrame, used: DataFrame, edges: DataFrame, trivial: Column) -> tuple[DataFrame, DataFrame]:
    """Articles that no evaluation used and that say something, and the edges between two of them. articles: article_id, content; used: article_id."""
    fine = articles.join(used, "article_id", "left_anti").filter(~trivial)
    ids = fine.select("article_id")
    inner = edges.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi").filter("source <> target")
    return fine, inner.select("source", "target")


def blind_pairs(a: DataFrame, b: DataFrame, flip: Column) -> DataFrame:
    """id, shown_a, shown_b and flip of two systems' answers (id, answer), in reverse where flip says so."""
    both = a.select("id", F.col("answer").alias("x")).join(b.select("id", F.col("answer").alias("y")), "id").withColumn("flip", flip)
    return both.select("id", F.when(F.col("flip"), F.col("y")).otherwise(F.col("x")).alias("shown_a"), F.when(F.col("flip"), F.col("x")).otherwise(F.col("y")).alias("shown_b"), "flip")

