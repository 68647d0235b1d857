"""Queries over routing, evidence, labels and thresholds. Turns of conversations stand for questions, labels for gold."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import calls, evidence, gate, grounding, metrics, mlgate, retrieval, routing, sampling, sentences
from . import pipeline
from .catalogue import query, table
from .queries_retrieval import _HYBRID, _RERANKED
from .shared import fixed, new_path

#: Names and patterns for the synthetic languages, in the places of the laws' names and of the intents.
ALIASES = {"und der": "A1", "der": "A2", "la de": "B1", "la": "B2", "the": "C1"}
PATTERNS = {"meta": "(?i)^(to be|is it|what)", "enumeration": "(?i)(enung|tionre|cióna)", "global": "(?i)(anst|ement|heit)", "ambiguous": "(?i)(this|nicht|pour)", "multi_hop": "(?i)(and.{0,20}or|und.{0,20}ein|et.{0,20}par)"}


def _rlike(name: str) -> str:
    return f"regexp_matches(q, '{PATTERNS[name]}')"


_NAMES = sorted(ALIASES, key=len, reverse=True)


def _laws_sql() -> str:
    """Names by length, each sought in what longer ones leave."""
    rest, parts = "q", []
    for n in _NAMES:
        parts.append(f"CASE WHEN contains({rest}, '{n}') THEN '{ALIASES[n]}' END")
        rest = f"replace({rest}, '{n}', ' ')"
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_FIRST = "coalesce(" + ", ".join(f"CASE WHEN contains(q, '{n}') THEN '{ALIASES[n]}' END" for n in _NAMES) + ")"


@query(f"""WITH t AS (SELECT conv_id, turn, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) AS q FROM conversations WHERE role = 'user'),
f AS (SELECT *, {_FIRST} AS one, {_laws_sql()} AS laws FROM t),
r AS (SELECT conv_id, turn, CASE WHEN {_rlike('meta')} THEN 1 WHEN {_rlike('enumeration')} AND one IS NOT NULL THEN 2 WHEN {_rlike('global')} AND len(laws) > 0 THEN 3
 WHEN length(q) < 5 OR {_rlike('ambiguous')} THEN 4 WHEN {_rlike('multi_hop')} THEN 5 ELSE 6 END AS k, one, laws FROM f)
SELECT conv_id, turn, ['no_retrieval', 'structured', 'global_or_multi_hop', 'corrective_candidate', 'global_or_multi_hop', 'single_hop'][k] AS route,
 ([0.99, 0.99, 0.96, 0.82, 0.78, 0.90]::DOUBLE[])[k] AS confidence, ['meta_response', 'law_overview', 'chapter_summary', 'hybrid_retrieval', 'citation_graph', 'hybrid_retrieval'][k] AS handler,
 CASE k WHEN 2 THEN [one] WHEN 3 THEN laws ELSE [] END AS matched FROM r""")
def route_cascade(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("route", routing.route_question(F.col("text"), ALIASES, PATTERNS))
    return asked.select("conv_id", "turn", "route.route", "route.confidence", "route.handler", F.col("route.matched_pcodes").alias("matched"))


# fixed values: the words of a small rule that guesses a document's language
GUESS = (("de", "und|nicht|eine?|mit"), ("fr", "les|des|une|pour"), ("es", "los|las|una|del"))
LANGS = ["en", "de", "fr", "es"]
_GUESS = "CASE " + " ".join(rf"WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}])({w})([^\p{{L}}]|$)') THEN '{n}'" for n, w in GUESS) + " ELSE 'en' END"


@query(f"""WITH g AS (SELECT lang, {_GUESS} AS guess FROM documents), l(expected) AS (VALUES ('en'), ('de'), ('fr'), ('es'))
SELECT expected, {', '.join(f"count(*) FILTER (guess = '{x}') AS {x}" for x in LANGS)}, (count(*) FILTER (guess = lang))::DOUBLE / nullif(count(lang), 0) AS accuracy FROM l LEFT JOIN g ON lang = expected GROUP BY 1""")
def route_confusion(spark, sf_dir):
    guess = F.lit("en")
    for name, words in reversed(GUESS):
        guess = F.when(F.col("text").rlike(rf"(?i)(^|[^\p{{L}}])({words})([^\p{{L}}]|$)"), name).otherwise(guess)
    return metrics.confusion(table(spark, sf_dir, "documents").withColumn("guess", guess), "lang", "guess", LANGS)


# fixed values: facets for the synthetic languages
FACETS = (("first", "words of the first kind", ("the ", "and "), ("thth", "ing ")), ("second", "words of the second kind", ("der ", "und "), ("keit", "ung ")), ("third", "words of the third kind", ("de ", "la "), ("tion", "ment")))
_MET = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(b.text, '{w}')''' for w in f[2])} THEN (SELECT count(*) > 0 FROM documents d JOIN gold g ON g.doc_id = d.doc_id AND g.item_id = b.item_id WHERE {' OR '.join(f'''contains(d.text, '{w}')''' for w in f[3])})::INT END" for f in FACETS)


@query(f"""WITH gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
m AS (SELECT item_id, list_filter([{_MET}], lambda x: x IS NOT NULL) AS met FROM benchmark b),
n AS (SELECT item_id, CASE WHEN len(met) < 2 THEN list_append(met, 0) ELSE met END AS met FROM m)
SELECT item_id, len(met) AS requirements, list_sum(met)::DOUBLE / len(met) AS coverage FROM n""")
def facet_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    rows = retrieval.containing(table(spark, sf_dir, "documents"), items).join(docs, "doc_id").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.col("body").alias("text")))), lambda x: F.struct(x["doc_id"].cast("string").alias("article_id"), x["text"].alias("text"))).alias("rows"))
    none = F.expr("cast(array() as array<struct<article_id: string, text: string>>)")
    route = F.struct(F.lit("global_or_multi_hop").alias("route"), F.lit("citation_graph").alias("handler"))
    plan = evidence.evidence_plan(F.col("text"), route, F.expr("cast(array() as array<string>)"), F.coalesce("rows", none), FACETS)
    return items.join(rows, "item_id", "left").withColumn("plan", plan).select("item_id", F.size("plan.requirements").cast("long").alias("requirements"), F.col("plan.coverage").alias("coverage"))


_SCORED = "s AS (SELECT quality = 1 AS label, toxic = 1 AS toxic, least(n_chars, 4000) / 4000.0::DOUBLE AS risk, l.doc_id FROM labels l JOIN documents d USING (doc_id))"
_RATES = """n AS count, (tp + tn)::DOUBLE / n AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, tn::DOUBLE / nullif(tn + fp, 0) AS specificity,
 (tp + fp)::DOUBLE / n AS activation_rate, fp::DOUBLE / nullif(fp + tn, 0) AS false_activation_rate, fn::DOUBLE / nullif(fn + tp, 0) AS missed_rate, tp, fp, fn, tn"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    risk = F.least("n_chars", F.lit(4000)) / 4000.0
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("label"), (F.col("toxic") == 1).alias("toxic"), risk.alias("risk"))


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) AS n, count(*) FILTER (label AND risk >= 0.5) AS tp, count(*) FILTER (NOT label AND risk >= 0.5) AS fp, count(*) FILTER (label AND risk < 0.5) AS fn, count(*) FILTER (NOT label AND risk < 0.5) AS tn FROM s)
SELECT {_RATES} FROM c""")
def binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(scored(spark, sf_dir), F.col("label"), F.col("risk") >= 0.5)


@query(f"""WITH {_SCORED}, th AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) AS n, count(*) FILTER (label AND risk >= threshold) AS tp, count(*) FILTER (NOT label AND risk >= threshold) AS fp, count(*) FILTER (label AND risk < threshold) AS fn, count(*) FILTER (NOT label AND risk < threshold) AS tn FROM s, th GROUP BY 1),
r AS (SELECT threshold, {_RATES} FROM c)
SELECT * FROM r ORDER BY (coalesce(recall, 0) >= 0.8) DESC, accuracy DESC, coalesce(specificity, 0) DESC, activation_rate, threshold DESC LIMIT 1""")
def threshold_search(spark, sf_dir):
    return metrics.threshold_search(scored(spark, sf_dir), "label", "risk", 0.8)


@query(f"""WITH {_SCORED}, a AS (SELECT min(risk) FILTER (toxic) AS positive_min, max(risk) FILTER (toxic) AS positive_max, min(risk) FILTER (NOT toxic) AS negative_min, max(risk) FILTER (NOT toxic) AS negative_max FROM s)
SELECT *, positive_min > negative_max AS separable, CASE WHEN positive_min > negative_max THEN (positive_min + negative_max) / 2 ELSE positive_min - 0.01 END AS threshold FROM a""")
def score_separation(spark, sf_dir):
    return metrics.score_separation(scored(spark, sf_dir), F.col("toxic"), F.col("risk"))


@query(f"""WITH {_SCORED}, w AS (SELECT CASE WHEN label THEN 'A' ELSE 'B' END AS winner, CASE WHEN toxic THEN 'toxic' ELSE 'plain' END AS pairing FROM s)
SELECT pairing, count(*) FILTER (winner = 'A') AS "A", count(*) FILTER (winner = 'B') AS "B" FROM w GROUP BY 1""")
def head_to_head(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.when(F.col("label"), "A").otherwise("B").alias("winner"), F.when(F.col("toxic"), "toxic").otherwise("plain").alias("pairing"))
    return metrics.tally(rows, "pairing", "winner", ["A", "B"])


@query(f"""WITH {_SCORED}, o AS (SELECT CASE WHEN NOT label AND toxic THEN 'rescue' WHEN label AND NOT toxic THEN 'regression' ELSE 'neutral' END AS outcome FROM s) SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def corrective_outcome(spark, sf_dir):
    return scored(spark, sf_dir).select(gate.corrective_outcome(F.col("label"), F.col("toxic")).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query()
def ml_train_eval(spark, sf_dir):
    """Out-of-fold risks of a model of two features for all labelled rows, evaluated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("lines"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", (F.col("toxic") == 1).alias("label"), F.log1p("n_chars").alias("size"), F.log1p("lines").alias("lines"))
    risks = mlgate.out_of_fold(rows, "doc_id", ("size", "lines"), epochs=300)
    return mlgate.evaluate(risks)


def answer_corpus(spark, sf_dir) -> pipeline.Corpus:
    """Documents as articles, with edges between those whose ids a line item joins."""
    docs = table(spark, sf_dir, "documents")
    articles = docs.select("doc_id", F.concat_ws("-", "source", "doc_id").alias("article_id"), F.col("source").alias("law_name"), F.col("doc_id").cast("string").alias("article_no"), "text")
    names = articles.select("doc_id", "article_id")

    def edges(sources: DataFrame) -> DataFrame:
        """Lines of the sources alone, before they are put together."""
        orders = fixed(names.toDF("l_orderkey", "source").join(sources, "source", "left_semi"))
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("ord"))
        pairs = lines.join(retrieval.small(orders, 100_000), "l_orderkey").groupBy("source", "l_suppkey").agg(F.min("ord").alias("ord"))
        return retrieval.small(fixed(pairs), 100_000).join(names.toDF("l_suppkey", "target"), "l_suppkey").select("source", "target", "ord")

    return pipeline.Corpus.of(articles, edges)


_SEEN = f"""{_HYBRID}, {_RERANKED},
t1 AS (SELECT query_id, max(rerank_score) FILTER (rank = 1) AS s1, max(rerank_score) FILTER (rank = 1) - max(rerank_score) FILTER (rank = 2) AS margin, list(source || '-' || doc_id ORDER BY rank) AS retrieval FROM fi JOIN documents USING (doc_id) GROUP BY 1),
ol AS (SELECT query_id, count(*) AS u, count(*) FILTER (len(lists) = 2) AS cnt FROM fu GROUP BY 1),
sg AS (SELECT query_id, s1, margin, retrieval, s1 < 0.6 AS low, (cnt >= 1 OR cnt / u::DOUBLE >= 0.03) AS ok, coalesce(margin < 0.015, false) AS small FROM t1 JOIN ol USING (query_id)),
gd AS (SELECT *, CASE WHEN low OR NOT ok OR small OR s1 < 0.69 THEN 'refine_once' ELSE 'answer' END AS first, CASE WHEN low OR NOT ok THEN 'refuse' ELSE 'answer' END AS last,
       list_filter([CASE WHEN low THEN 'low_top1' WHEN s1 >= 0.69 THEN 'strong_top1' END, CASE WHEN small THEN 'small_top1_top2_margin' END, CASE WHEN NOT ok THEN 'no_lexical_semantic_overlap' END], lambda v: v IS NOT NULL) AS rules FROM sg)"""


@query(f"""WITH {_SEEN} SELECT query_id, 'single_hop' AS route, CASE WHEN first = 'answer' THEN 'answer' ELSE last END AS served, CASE WHEN first = 'answer' THEN 'answer' ELSE last END AS decision,
rules AS rules_triggered, (first <> 'answer')::INT AS refinement_count, retrieval, '{grounding.REFUSAL_TEXT}' AS final_text FROM gd""")
def answer_batch(spark, sf_dir):
    """The whole adaptive plan from questions to checked answers. The invented prose has no Han sentence that a judge could support, so every answer ends as the refusal's text."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = pipeline.answer_batch(asked, answer_corpus(spark, sf_dir), mode="refinement_enabled")
    return out.select("query_id", "route", "served", "decision", "rules_triggered", "refinement_count", "retrieval", "final_text")


@query(f"""WITH {_SEEN} SELECT query_id, CASE WHEN s1 < 0.636 THEN 'refuse' ELSE 'answer' END AS served, first AS initial, CASE WHEN first = 'refine_once' THEN last END AS last, first = 'refine_once' AS refinement_executed FROM gd""")
def shadow_decisions(spark, sf_dir):
    """What the gate would have done beside the baseline, which serves."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = pipeline.answer_batch(asked, answer_corpus(spark, sf_dir), mode="current_baseline", shadow=True)
    s = F.col("shadow_adaptive")
    return out.select("query_id", "served", s["initial_gate"]["decision"].alias("initial"), s["final_gate"]["decision"].alias("last"), s["refinement_executed"].alias("refinement_executed"))


@query(f"""WITH {_SCORED}, m(mode, cut, back) AS (VALUES ('current_baseline', 0.1::DOUBLE, 0.0::DOUBLE), ('refinement_enabled', 0.05, 0.2)),
r AS (SELECT mode, label AS answerable, CASE WHEN risk < cut THEN 'refuse' WHEN risk < back THEN 'refine_once' ELSE 'answer' END AS decision, CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN doc_id % 7 END AS hit_rank,
 CASE WHEN toxic AND NOT label THEN 'rescue' WHEN label AND NOT toxic THEN 'regression' ELSE 'neutral' END AS outcome FROM s, m)
SELECT mode, count(*) AS queries, count(*) FILTER (answerable AND hit_rank IS NOT NULL)::DOUBLE / nullif(count(*) FILTER (answerable), 0) AS recall, round(avg(CASE WHEN answerable THEN coalesce(1.0 / hit_rank, 0) END), 9) AS mrr,
 count(*) FILTER (decision = 'refuse' AND NOT answerable)::DOUBLE / nullif(count(*) FILTER (decision = 'refuse'), 0) AS refusal_precision, count(*) FILTER (decision = 'refuse' AND NOT answerable)::DOUBLE / nullif(count(*) FILTER (NOT answerable), 0) AS refusal_recall,
 count(*) FILTER (decision = 'refine_once')::DOUBLE / count(*) AS activation_rate, count(*) FILTER (outcome = 'rescue') AS rescues, count(*) FILTER (outcome = 'regression') AS regressions FROM r GROUP BY 1""")
def mode_summary(spark, sf_dir):
    modes = spark.createDataFrame([("current_baseline", 0.1, 0.0), ("refinement_enabled", 0.05, 0.2)], "mode string, cut double, back double")
    rows = scored(spark, sf_dir).crossJoin(F.broadcast(modes))
    rank = F.col("doc_id") % 7
    made = rows.select("mode", F.col("label").alias("answerable"), F.when(F.col("risk") < F.col("cut"), "refuse").when(F.col("risk") < F.col("back"), "refine_once").otherwise("answer").alias("decision"), F.when(rank.between(1, 5), rank).alias("hit_rank"), gate.corrective_outcome(F.col("label"), F.col("toxic")).alias("outcome"))
    return metrics.summed_modes(made).withColumn("mrr", F.round("mrr", 9))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS answer_id, l_partkey AS article_id FROM lineitem), g AS (SELECT DISTINCT l_orderkey AS answer_id, l_partkey AS article_id FROM lineitem WHERE l_returnflag = 'R')
SELECT c.answer_id, count(*) AS citations, count(*) FILTER (c.article_id IN (SELECT p_partkey FROM part WHERE p_size > 10))::DOUBLE / count(*) AS validity, count(g.article_id)::DOUBLE / count(*) AS correctness
FROM c LEFT JOIN g ON g.answer_id = c.answer_id AND g.article_id = c.article_id GROUP BY 1""")
def citation_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_partkey").alias("article_id"), "l_returnflag")
    known = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("article_id"))
    return metrics.citation_metrics(lines.drop("l_returnflag"), known, lines.filter("l_returnflag = 'R'").drop("l_returnflag"))


@query(r"""WITH q AS (SELECT conv_id * 1000 + turn AS ord, text, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM conversations),
u AS (SELECT h AS question_hash, min(ord) AS ord FROM q WHERE h NOT IN (SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) FROM benchmark) GROUP BY 1)
SELECT 'Q' || lpad(row_number() OVER (ORDER BY ord)::VARCHAR, 4, '0') AS item_id, question_hash FROM u""")
def export_packet(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("question"), text.question_hash(F.col("text")).alias("question_hash"))
    known = table(spark, sf_dir, "benchmark").select(text.question_hash(F.col("text")).alias("question_hash"))
    return sampling.export_packet(asked, known).select("item_id", "question_hash")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5)
SELECT source AS query_id, md5(string_agg('《' || lang || '》第 ' || doc_id || ' 條：' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM r GROUP BY 1""")
def context_assembly(spark, sf_dir):
    """The five longest documents of each source as one prompt's context."""
    docs = table(spark, sf_dir, "documents")
    top = retrieval.ranked(docs.select("source", "doc_id", "n_chars"), 5, "source", "doc_id", "n_chars").select("source", "doc_id", "rank")
    best = top.join(docs.select("doc_id", "lang", "text"), "doc_id").withColumn("parent_id", F.col("doc_id").cast("string"))
    articles = best.select("parent_id", F.col("lang").alias("law_name"), F.col("parent_id").alias("article_no"), F.lit(None).cast("string").alias("content"))
    return grounding.context_text(best.select(F.col("source").alias("query_id"), "parent_id", "rank", "text"), articles).withColumn("context", F.md5("context"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem),
k AS (SELECT l_orderkey AS answer_id, i, (i - 1) // 3 AS para, '第' || i || '項貨品' || l_partkey || '依規定可以辦理。' AS sentence, l_partkey % 11 <> 0 AND l_returnflag <> 'R' AND i % 4 < 3 AS ok FROM s),
p AS (SELECT answer_id, para, string_agg(sentence, '' ORDER BY i) FILTER (ok) AS t, count(*) FILTER (NOT ok) AS gone FROM k GROUP BY 1, 2)
SELECT answer_id, coalesce(string_agg(t, chr(10) ORDER BY para) FILTER (t IS NOT NULL), '{grounding.REFUSAL_TEXT}') AS final_text, sum(gone)::BIGINT AS removed_count FROM p GROUP BY 1""")
def checked_answers(spark, sf_dir):
    """Answers of several paragraphs, a sentence a line of an order, checked by a judge's replies: what it supports stays, by paragraph, and an answer without any is the refusal.

    The judge leaves out every eleventh part, doesn't support returned lines, and names a context that there isn't for every fourth sentence.
    """
    # an order has a few lines
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def sentence(x, i):
        mark = F.when((i > 0) & (i % 3 == 0), "\n").otherwise("")
        return F.concat(mark, F.lit("第"), (i + 1).cast("string"), F.lit("項貨品"), x["l_partkey"].cast("string"), F.lit("依規定可以辦理。"))

    def verdict(x, i):
        return F.when(x["l_partkey"] % 11 != 0, F.struct((i + 1).alias("index"), (x["l_returnflag"] != "R").alias("supported"), ((i + 1) % 4 + 1).alias("context_no"), F.lit("").alias("reason")))

    reply = F.concat(F.lit("評核：\n"), F.to_json(F.array_compact(F.transform("lines", verdict))))
    answers = fixed(each.select("answer_id", F.array_join(F.transform("lines", sentence), "").alias("text"), reply.alias("reply")))
    contexts = answers.select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("context_no")).withColumn("article", F.concat(F.lit("L-"), F.col("context_no")))
    checked = grounding.reconciled(sentences.sentences(answers), grounding.parsed_verdicts(answers), contexts)
    return grounding.applied(answers, checked)


@query("""SELECT doc_id, sha256(text) AS prompt_hash, CASE WHEN NOT starts_with(md5(text), '0') THEN md5(text) END AS reply, CASE WHEN starts_with(md5(text), '0') THEN 'invalid' ELSE 'made' END AS status FROM documents""")
def model_replies(spark, sf_dir):
    """Replies of a model, here a digest, to every document; those that begin with a nought count as invalid. Equal texts are sent once."""
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return calls.replies(items, new_path(spark), lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts], lambda reply: not reply.startswith("0"), "doc_id", tries=2)
