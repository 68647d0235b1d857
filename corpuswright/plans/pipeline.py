"""A batch of questions to answers: one plan of joins and column expressions, with models behind column functions and tables of replies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import citations, evidence, gate, grounding, retrieval, routing, sentences
from .shared import fixed

Answerer = Callable[[Column, Column], Column]
MODES = tuple(m[0] for m in gate.MODES)


def extractive(question: Column, context: Column) -> Column:
    """The default answer in place of a model: the context itself."""
    return context


@dataclass
class Corpus:
    """articles (doc_id, article_id, law_name, article_no, text), their citations (source, target, ord) and a retriever over them. edges: all citations, or a function that gives those of some articles (source)."""

    articles: DataFrame
    edges: DataFrame | Callable[[DataFrame], DataFrame]
    retriever: retrieval.Retriever

    @staticmethod
    def of(articles: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], embed: retrieval.Embedder = retrieval.hashed_vectors) -> Corpus:
        return Corpus(articles, edges, retrieval.Retriever.of(articles, embed))


def retrieved(corpus: Corpus, queries: DataFrame, questions: DataFrame, scorer=retrieval.overlap_score) -> tuple[DataFrame, DataFrame]:
    """The best five hits of each question, ranked again by `questions` (query_id, text), and diagnostics. queries: query_id, ord, text."""
    found = retrieval.retrieve_multi(corpus.retriever, queries)
    final = fixed(retrieval.rerank(found.fused, corpus.articles, questions, scorer))
    return final, retrieval.diagnostics(found.lexical, found.dense, final)


def graded(corpus: Corpus, asked: DataFrame, queries: DataFrame, by: DataFrame, refinements: int, scorer=retrieval.overlap_score) -> DataFrame:
    """asked (query_id, text, route, required) with hits, related articles, the evidence plan, signals and the gate's result. by: what hits are ranked again by."""
    final, seen = retrieved(corpus, queries, by, scorer)
    articles = corpus.articles
    # few rows meet the articles and citations where these are
    named = articles.select("doc_id", "article_id", "law_name", "article_no").join(retrieval.small(final.select("doc_id").distinct(), 100_000), "doc_id", "left_semi")
    hits = fixed(final.join(fixed(named), "doc_id").withColumn("score", F.col("rerank_score")))
    sources = retrieval.small(hits.select(F.col("article_id").alias("source")).distinct(), 100_000)
    edges = fixed(corpus.edges(sources) if callable(corpus.edges) else corpus.edges.join(sources, "source", "left_semi"))
    targets = articles.select(F.col("article_id").alias("target")).join(retrieval.small(edges.select("target").distinct(), 100_000), "target", "left_semi")
    related = fixed(citations.expand(hits.select("query_id", F.col("article_id").alias("item"), "rank"), edges, targets))
    near = retrieval.small(related, 100_000).join(articles.select(F.col("article_id").alias("target"), F.col("text").alias("doc_text")), "target")
    rows = hits.select("query_id", F.struct(F.lit(0).alias("kind"), "rank", "article_id", F.col("doc_text").alias("text")).alias("r")).unionByName(near.select("query_id", F.struct(F.lit(1).alias("kind"), F.col("place").alias("rank"), F.col("target").alias("article_id"), F.col("doc_text").alias("text")).alias("r")))
    # five hits and five related articles a question at most
    rows = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["article_id"].alias("article_id"), r["text"].alias("text"))).alias("rows"))
    graph = related.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda r: r["target"]).alias("graph_articles"))
    none = F.expr("cast(array() as array<string>)")
    joined = asked.join(gate.gate_signals(hits), "query_id", "left").join(seen.select("query_id", "overlap_count", "overlap_jaccard"), "query_id", "left").join(rows, "query_id", "left").join(graph, "query_id", "left")
    joined = joined.withColumn("retrieved_articles", F.coalesce("retrieved_articles", none)).withColumn("graph_articles", F.coalesce("graph_articles", none))
    empty = F.expr("cast(array() as array<struct<article_id: string, text: string>>)")
    plan = evidence.evidence_plan(F.col("text"), F.col("route"), F.col("required"), F.coalesce("rows", empty))
    signals = joined.withColumns(gate.covered_signals(F.col("required"), F.col("retrieved_articles"), F.col("graph_articles"))).withColumns({
        "bm25_dense_overlap_count": F.coalesce("overlap_count", F.lit(0)), "bm25_dense_overlap_jaccard": F.coalesce("overlap_jaccard", F.lit(0.0)),
        "ambiguous_or_multi_hop": (F.col("route.route") == "corrective_candidate") | routing.is_multi_hop(F.col("route")), "evidence_requirement_coverage": plan["coverage"],
    })
    return fixed(gate.graded(signals.drop("overlap_count", "overlap_jaccard"), refinements=refinements))


def masked(asked: DataFrame, mode: str) -> DataFrame:
    """Only the full adaptive mode lets the gate see that a route is ambiguous or of several hops."""
    if mode == "full_adaptive_route":
        return asked
    single = F.col("route").withField("route", F.lit("single_hop")).withField("handler", F.lit("hybrid_retrieval"))
    return asked.withColumn("route", F.when(routing.requires_retrieval(F.col("route")), single).otherwise(F.col("route")))


def first_pass(corpus: Corpus, asked: DataFrame, rewrites: DataFrame | None = None, scorer=retrieval.overlap_score) -> DataFrame:
    """graded after one retrieval by the rewritten question. rewrites: query_id, rewritten; without a rewrite the question itself."""
    if rewrites is None:
        asked = asked.withColumn("query", F.col("text"))
    else:
        asked = asked.join(rewrites.select("query_id", F.col("rewritten").alias("query")), "query_id", "left").withColumn("query", F.coalesce("query", "text"))
    by = asked.select("query_id", F.col("query").alias("text"))
    return graded(corpus, asked, by.withColumn("ord", F.lit(0)), by, 0, scorer)


def second_pass(corpus: Corpus, first: DataFrame, replies: DataFrame | None = None, scorer=retrieval.overlap_score) -> DataFrame:
    """graded again where the gate asks for it: once, by question, first query and refined query together. replies: query_id, reply (a model's); without one the first query stands."""
    again = first.filter("gate.decision = 'refine_once'").select("query_id", "text", "route", "required", "query")
    again = again.withColumn("reply", F.lit(None).cast("string")) if replies is None else again.join(replies.select("query_id", "reply"), "query_id", "left")
    again = again.withColumn("refined", grounding.refined_query(F.col("text"), F.col("query"), F.col("reply"))).drop("reply")
    queries = again.select("query_id", F.posexplode(F.array("text", "query", "refined")).alias("ord", "text"))
    asked = again.drop("query").withColumnRenamed("refined", "query")
    return graded(corpus, asked, queries, again.select("query_id", "text"), 1, scorer)


def shadowed(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id and shadow: what the gate would have decided, with one refinement; the served answer doesn't depend on it."""
    last = second.select("query_id", F.col("gate.decision").alias("last"))
    joined = first.select("query_id", F.col("gate.decision").alias("initial")).join(last, "query_id", "left")
    ran = F.col("last").isNotNull()
    return joined.select("query_id", F.struct(
        F.lit("current_baseline").alias("served_mode"), F.lit(False).alias("control_path_affected"), F.when(ran, "refine_once").otherwise("decision_only").alias("execution"),
        F.struct(F.col("initial").alias("decision")).alias("initial_gate"), F.when(ran, F.struct(F.col("last").alias("decision"))).alias("final_gate"), ran.alias("refinement_executed"),
    ).alias("shadow_adaptive"))


def decided(corpus: Corpus, asked: DataFrame, mode: str, rewrites: DataFrame | None = None, replies: DataFrame | None = None, shadow: bool = False, scorer=retrieval.overlap_score) -> DataFrame:
    """graded with served (answer or refuse), refinement_count and shadow_adaptive, as the mode says.

    The baseline refuses below its threshold of the best score. The gate alone refuses whatever it doesn't answer at once.
    The adaptive modes retrieve a second time where it says refine_once, and then refuse what it still doesn't answer.
    """
    asked = masked(asked, mode)
    first = first_pass(corpus, asked, rewrites, scorer)
    none = F.lit(None).cast("struct<served_mode: string, control_path_affected: boolean, execution: string, initial_gate: struct<decision: string>, final_gate: struct<decision: string>, refinement_executed: boolean>")
    if mode == "current_baseline":
        out = first.withColumn("refinement_count", F.lit(0)).withColumn("served", F.when(gate.refuse_before_generation(F.size("retrieved_articles"), F.col("top1_rerank")), "refuse").otherwise("answer"))
        if not shadow:
            return out.withColumn("shadow_adaptive", none)
        return out.join(shadowed(first, second_pass(corpus, first, replies, scorer)), "query_id", "left")
    if mode in ("refinement_enabled", "full_adaptive_route"):
        second = second_pass(corpus, first, replies, scorer).withColumn("refinement_count", F.lit(1))
        first = first.filter("gate.decision <> 'refine_once'").withColumn("refinement_count", F.lit(0)).unionByName(second)
    else:
        first = first.withColumn("refinement_count", F.lit(0))
    return first.withColumn("served", F.when(F.col("gate.decision") == "answer", "answer").otherwise("refuse")).withColumn("shadow_adaptive", none)


def answer_batch(questions: DataFrame, corpus: Corpus, answer: Answerer = extractive, mode: str = "current_baseline", aliases: dict[str, str] | None = None, rewrites: DataFrame | None = None, replies: DataFrame | None = None, shadow: bool = False, scorer=retrieval.overlap_score) -> DataFrame:
    """query_id, route, served, decision, rules_triggered, refinement_count, retrieval, graph_expansion, shadow_adaptive, final_text and removed_count of every question.

    questions: query_id, text. Questions that their route answers without retrieval never reach it; those that are refused
    never reach the answerer. rewrites and replies are cached replies of models; answers are checked sentence by sentence.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    routed = fixed(questions.withColumn("route", routing.route_question(F.col("text"), aliases)).withColumn("required", routing.required_articles(F.col("text"), aliases)))
    asked = routed.filter(routing.requires_retrieval(F.col("route")))
    seen = fixed(decided(corpus, asked, mode, rewrites, replies, shadow, scorer))
    cleared = seen.filter("served = 'answer'").select("query_id", "text", "rows")
    texts = cleared.select(F.col("query_id").alias("answer_id"), answer(F.col("text"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("text"))
    contexts = cleared.select(F.col("query_id").alias("answer_id"), F.posexplode("rows").alias("i", "r")).select("answer_id", (F.col("i") + 1).alias("context_no"), F.col("r.article_id").alias("article"), F.col("r.text").alias("text"))
    said = sentences.sentences(texts)
    checked = grounding.reconciled(said, grounding.overlap_judge(said, contexts), contexts.drop("text"))
    done = grounding.applied(texts, checked).withColumnRenamed("answer_id", "query_id")
    kept = seen.select("query_id", "served", "gate", "refinement_count", F.col("retrieved_articles").alias("retrieval"), F.col("graph_articles").alias("graph_expansion"), "shadow_adaptive")
    out = routed.select("query_id", "route").join(kept, "query_id", "left").join(done, "query_id", "left")
    text = F.when(F.col("served").isNull(), F.concat(F.lit("handled by "), F.col("route.handler"))).otherwise(F.coalesce("final_text", F.lit(grounding.REFUSAL_TEXT)))
    return out.select(
        "query_id", F.col("route.route").alias("route"), F.coalesce("served", F.lit("answer")).alias("served"), F.col("gate.decision").alias("decision"), F.col("gate.rules_triggered").alias("rules_triggered"),
        F.coalesce("refinement_count", F.lit(0)).alias("refinement_count"), "retrieval", "graph_expansion", "shadow_adaptive", text.alias("final_text"), F.coalesce("removed_count", F.lit(0)).alias("removed_count"),
    )
