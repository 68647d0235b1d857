"""Queries over evaluation: benchmark texts stand for questions, documents for articles, labels for judgements, turns of conversations for candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, sampling
from . import prospective
from .catalogue import query, table
from .queries_gate import _RATES, _SEEN, answer_corpus, scored
from .queries_retrieval import gold

_MEASURED = f"""{_SEEN}, ids AS (SELECT doc_id, source || '-' || doc_id AS article FROM documents),
ed AS (SELECT a.article AS source, b.article AS target, min(l_linenumber) AS ord FROM lineitem JOIN ids a ON a.doc_id = l_orderkey JOIN ids b ON b.doc_id = l_suppkey GROUP BY 1, 2),
hi AS (SELECT query_id, article AS item, rank FROM fi JOIN ids USING (doc_id)),
ex AS (SELECT query_id, target, min((rank, ord, source)) AS b FROM hi JOIN ed ON item = source WHERE NOT EXISTS (SELECT 1 FROM hi h WHERE h.query_id = hi.query_id AND h.item = ed.target) GROUP BY 1, 2),
near AS (SELECT query_id, target FROM (SELECT query_id, target, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], target) AS place FROM ex) WHERE place <= 5),
av AS (SELECT query_id, list_sort(list(DISTINCT a)) AS available FROM (SELECT query_id, item AS a FROM hi UNION SELECT query_id, target FROM near) GROUP BY 1),
gold AS (SELECT item_id AS query_id, article FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN ids USING (doc_id)),
it AS (SELECT item_id AS id, item_id % 3 <> 0 AS answerable, coalesce((SELECT list_sort(list(article)) FROM gold WHERE query_id = item_id), []) AS expected FROM benchmark),
me AS (SELECT id, answerable, expected, available, answerable AND len(list_filter(expected, lambda x: NOT list_contains(available, x))) = 0 AS evidence_complete, first AS rule_decision, s1, margin, ol.cnt, ol.u
       FROM it JOIN gd ON gd.query_id = id JOIN av ON av.query_id = id JOIN ol ON ol.query_id = id)"""


def measured(spark, sf_dir) -> DataFrame:
    """Of the benchmark's questions, two of three count as answerable; the documents that hold a question's text are expected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "doc_id").alias("article"))
    truth = gold(spark, sf_dir).join(docs, "doc_id").groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list("article")).alias("expected"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("single_hop").alias("stratum"), F.lit("single_hop").alias("expected_route"), (F.col("item_id") % 3 != 0).alias("answerable"))
    items = items.join(truth, "id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    return prospective.measure(answer_corpus(spark, sf_dir), items)


@query(f"""WITH {_MEASURED} SELECT id, answerable, expected, available, evidence_complete, NOT evidence_complete AS needs_correction, rule_decision, rule_decision <> 'answer' AS rule_activates,
s1 AS top1_rerank, round(margin, 9) AS top1_top2_margin, cnt::DOUBLE AS bm25_dense_overlap_count, round(cnt / u::DOUBLE, 6) AS bm25_dense_overlap_jaccard FROM me""")
def measure_rows(spark, sf_dir):
    rows = measured(spark, sf_dir)
    return rows.select("id", "answerable", "expected", "available", "evidence_complete", "needs_correction", "rule_decision", "rule_activates", "top1_rerank", F.round("top1_top2_margin", 9).alias("top1_top2_margin"), "bm25_dense_overlap_count", F.round("bm25_dense_overlap_jaccard", 6).alias("bm25_dense_overlap_jaccard"))


@query(f"""WITH {_MEASURED}, r AS (SELECT 'rule' AS gate, NOT evidence_complete AS label, rule_decision <> 'answer' AS p FROM me UNION ALL SELECT 'candidate', NOT evidence_complete, s1 < 0.8 FROM me),
c AS (SELECT gate, count(*) AS n, count(*) FILTER (label AND p) AS tp, count(*) FILTER (NOT label AND p) AS fp, count(*) FILTER (label AND NOT p) AS fn, count(*) FILTER (NOT label AND NOT p) AS tn FROM r GROUP BY 1),
m AS (SELECT gate, {_RATES} FROM c)
SELECT a.recall AS rule_recall, b.recall AS candidate_recall, a.accuracy AS rule_accuracy, b.accuracy AS candidate_accuracy, a.activation_rate AS rule_activation, b.activation_rate AS candidate_activation,
coalesce(b.recall, 0) >= coalesce(a.recall, 0) AND b.accuracy >= a.accuracy AND b.activation_rate < a.activation_rate AND coalesce(b.false_activation_rate, 0) < coalesce(a.false_activation_rate, 0) AS adopted
FROM m a, m b WHERE a.gate = 'rule' AND b.gate = 'candidate'""")
def holdout_adoption(spark, sf_dir):
    """A candidate that corrects whatever ranks below 0.8, held against the rules."""
    both = prospective.judged(measured(spark, sf_dir).withColumn("risk", F.when(F.col("top1_rerank") < 0.8, 1.0).otherwise(0.0)), "risk", 0.5)
    pair = [F.col(f"{who}.{name}").alias(f"{who}_{short}") for name, short in (("recall", "recall"), ("accuracy", "accuracy"), ("activation_rate", "activation")) for who in ("rule", "candidate")]
    return both.select(*pair, "adopted")


_TRACED = """tr AS (SELECT l.doc_id, quality = 1 AS answerable, n_chars < 400 AS refused, CASE WHEN l.doc_id % 7 BETWEEN 1 AND 5 THEN l.doc_id % 7 END AS hit_rank, CASE WHEN l.doc_id % 4 <> 0 THEN (l.doc_id % 4) / 4.0::DOUBLE END AS cov,
 n_chars::DOUBLE AS ms, n_chars % 1000 AS main, l.doc_id % 5 <> 0 AS has, l.doc_id % 90 AS side, CASE WHEN l.doc_id % 3 = 0 THEN 'answer' ELSE 'refine_once' END AS first, l.doc_id % 3 = 1 AS ran, CASE WHEN toxic = 1 THEN 'refuse' ELSE 'answer' END AS last, l.doc_id % 6 AS removed
 FROM labels l JOIN documents d USING (doc_id))"""


def traced(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows, i = table(spark, sf_dir, "labels").join(docs, "doc_id"), F.col("doc_id")
    usage = lambda total: F.struct(total.cast("long").alias("total_tokens"))
    shadow = F.struct(
        F.struct(F.when(i % 3 == 0, "answer").otherwise("refine_once").alias("decision")).alias("initial_gate"), F.struct(F.when(F.col("toxic") == 1, "refuse").otherwise("answer").alias("decision")).alias("final_gate"),
        (i % 3 == 1).alias("refinement_executed"), usage(i % 90).alias("token_usage"),
    )
    covered = F.when(i % 4 != 0, (i % 4) / 4.0)
    return rows.select(
        (F.col("quality") == 1).alias("answerable"), (F.col("n_chars") < 400).alias("refused"), F.when((i % 7).between(1, 5), i % 7).alias("hit_rank"), covered.alias("answer_correctness"), covered.alias("citation_coverage"), F.coalesce(covered, F.lit(0.0)).alias("citation_validity"),
        covered.alias("support_rate"), (i % 6).alias("removed_count"), (i % 11 == 0).alias("judge_error"), F.create_map(F.lit("total"), F.col("n_chars").cast("double")).alias("latency_ms"), usage(F.col("n_chars") % 1000).alias("token_usage"), F.when(i % 5 != 0, shadow).alias("shadow_adaptive"),
    )


@query(f"""WITH {_TRACED}, s AS (SELECT count(*) AS item_count, count(*) FILTER (answerable) AS answerable_count, count(*) FILTER (NOT answerable) AS unanswerable_count,
count(*) FILTER (answerable AND hit_rank <= 5) / nullif(count(*) FILTER (answerable), 0)::DOUBLE AS recall_at_5, round(avg(CASE WHEN answerable THEN coalesce(1.0 / hit_rank, 0) END), 9) AS mrr, count(*) FILTER (answerable AND hit_rank IS NOT NULL) AS observed_hits,
round(avg(cov) FILTER (answerable), 9) AS correctness, round(avg(cov) FILTER (answerable), 9) AS coverage, round(avg(coalesce(cov, 0)) FILTER (answerable), 9) AS validity, round(avg(cov) FILTER (answerable), 9) AS support_rate,
count(*) FILTER (NOT answerable AND refused) AS tp, count(*) FILTER (answerable AND refused) AS fp, count(*) FILTER (NOT answerable AND NOT refused) AS fn, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95,
sum(main)::BIGINT AS main_tokens, sum(CASE WHEN has THEN side ELSE 0 END)::BIGINT AS shadow_tokens, count(*) FILTER (has) AS shadow_count, count(*) FILTER (has AND first <> 'answer') AS activated, count(*) FILTER (has AND ran) AS refined,
count(*) FILTER (has AND ran AND first = 'refine_once' AND last = 'answer') AS rescued, count(*) FILTER (has AND ran AND first = 'answer' AND last <> 'answer') AS regressed, sum(removed)::BIGINT AS removed_sentences, count(*) FILTER (doc_id % 11 = 0) AS judge_errors FROM tr)
SELECT item_count, answerable_count, unanswerable_count, recall_at_5, mrr, observed_hits, correctness, coverage, validity, support_rate, tp, fp, fn, tp / nullif(tp + fp, 0)::DOUBLE AS refusal_precision, tp / nullif(tp + fn, 0)::DOUBLE AS refusal_recall, p50, p95,
main_tokens, shadow_tokens, main_tokens + shadow_tokens AS combined_tokens, (main_tokens + shadow_tokens) / item_count::DOUBLE AS tokens_per_query, shadow_count, activated / nullif(shadow_count, 0)::DOUBLE AS activation_rate, refined / nullif(shadow_count, 0)::DOUBLE AS refinement_rate,
coalesce(rescued / nullif(refined, 0)::DOUBLE, 0) AS rescue_rate, coalesce(regressed / nullif(refined, 0)::DOUBLE, 0) AS regression_rate, removed_sentences, judge_errors FROM s""")
def end_to_end_summary(spark, sf_dir):
    out = evaluation.end_to_end(traced(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("mrr", "correctness", "coverage", "validity", "support_rate")})


_CITED = "ci AS (SELECT l_orderkey AS answer_id, p_brand AS law, p_size AS no, l_returnflag = 'R' AS want FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"""WITH {_CITED}, kn AS (SELECT DISTINCT p_brand AS law, p_size AS no, p_brand || '-' || p_size AS article FROM part WHERE p_size > 10),
m AS (SELECT ci.*, article FROM ci LEFT JOIN kn USING (law, no)), ex AS (SELECT DISTINCT answer_id, law || '-' || no AS article FROM ci WHERE want),
co AS (SELECT answer_id, count(s.article) / count(*)::DOUBLE AS coverage FROM ex e LEFT JOIN (SELECT DISTINCT answer_id, article FROM m) s USING (answer_id, article) GROUP BY 1)
SELECT answer_id, count(*) AS citations, coalesce(list_sort(list(DISTINCT article) FILTER (article IS NOT NULL)), []) AS cited, any_value(coverage) AS coverage, count(article) / count(*)::DOUBLE AS validity FROM m LEFT JOIN co USING (answer_id) GROUP BY 1""")
def answer_citations(spark, sf_dir):
    """Orders as answers that cite a brand and a size for each line; sizes above ten exist, returned lines are expected."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("answer_id"), "l_linenumber", F.format_string("so says [%s §%d]", "p_brand", "p_size").alias("c"), F.concat_ws("-", "p_brand", "p_size").alias("article_id"), "l_returnflag")
    # an order has seven lines at most
    answers = lines.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "c"))), lambda x: x["c"]), ". ").alias("text"))
    laws = part.filter("p_size > 10").select(F.col("p_brand").alias("law_name"), F.col("p_size").cast("string").alias("article_no"), F.concat_ws("-", "p_brand", "p_size").alias("article_id"))
    return evaluation.answer_metrics(answers, laws, lines.filter("l_returnflag = 'R'").select("answer_id", "article_id"))


@query(f"""WITH {_TRACED} SELECT doc_id, CASE WHEN NOT answerable THEN 'not_applicable_unanswerable' WHEN refused THEN 'refused' WHEN doc_id % 5 = 0 THEN 'not_evaluated_changed_evidence' ELSE 'frozen_baseline_reused' END AS answer_source,
CASE WHEN NOT answerable THEN NULL WHEN refused THEN 0.0::DOUBLE WHEN doc_id % 5 = 0 THEN NULL ELSE (coalesce(cov, 0) > 0 AND doc_id % 2 = 0)::INT::DOUBLE END AS correctness,
CASE WHEN NOT answerable THEN NULL WHEN refused THEN 0.0::DOUBLE WHEN doc_id % 5 = 0 THEN NULL ELSE cov END AS coverage, CASE WHEN NOT answerable OR refused OR doc_id % 5 = 0 THEN NULL ELSE (doc_id % 2 = 0)::INT::DOUBLE END AS validity FROM tr""")
def frozen_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows, i = table(spark, sf_dir, "labels").join(docs, "doc_id"), F.col("doc_id")
    made = evaluation.frozen_answer(F.col("quality") == 1, F.col("n_chars") < 400, i % 5 == 0, F.when(i % 4 != 0, (i % 4) / 4.0), (i % 2 == 0).cast("double"))
    return rows.select("doc_id", made.alias("m")).select("doc_id", "m.*")


_HASH = r"sha256(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))))"


@query(rf"""WITH q AS (SELECT conv_id * 1000 + turn AS ord, CASE WHEN turn % 6 = 5 THEN ' ' ELSE coalesce(text, '') END AS question FROM conversations UNION ALL SELECT 100000000 + item_id, '  ' || text FROM benchmark WHERE item_id % 2 = 0),
h AS (SELECT ord, trim(question) AS question, {_HASH.format("question")} AS h FROM q), f AS (SELECT h, min(ord) AS first FROM h WHERE question <> '' GROUP BY 1), k AS (SELECT DISTINCT {_HASH.format("text")} AS h FROM benchmark)
SELECT * FROM (SELECT ord, CASE WHEN question = '' THEN 'empty' WHEN h.h IN (SELECT h FROM k) THEN 'overlaps' WHEN ord > first THEN 'duplicate' END AS problem FROM h LEFT JOIN f USING (h)) WHERE problem IS NOT NULL""")
def holdout_candidates(spark, sf_dir):
    """What keeps turns of conversations, and some of the benchmark's own questions, out of a blind packet."""
    turns, bench = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("turn") % 6 == 5, " ").otherwise(F.col("text")).alias("question"))
    asked = asked.unionByName(bench.filter("item_id % 2 = 0").select((F.col("item_id") + 100_000_000).alias("ord"), F.concat(F.lit("  "), "text").alias("question")))
    return evaluation.candidate_problems(asked, bench.select(text.question_hash(F.col("text")).alias("question_hash")))


@query("""WITH a AS (SELECT d.doc_id AS id, CASE d.doc_id % 5 WHEN 0 THEN 'structured' WHEN 1 THEN NULL WHEN 2 THEN 'elsewhere' ELSE 'single_hop' END AS route, quality, toxic, d.doc_id % 4 AS k FROM documents d LEFT JOIN labels USING (doc_id))
SELECT * FROM (SELECT id, CASE WHEN route IS NULL OR route = 'elsewhere' THEN 'expected_route' WHEN quality IS NULL THEN 'answerable' WHEN toxic = 1 THEN 'review' WHEN k = 0 THEN 'expected_article_ids' WHEN quality = 1 AND route <> 'structured' AND k = 1 THEN 'articles_needed' END AS problem FROM a) WHERE problem IS NOT NULL""")
def holdout_annotations(spark, sf_dir):
    """What keeps annotated items from being frozen."""
    rows, i = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), F.col("doc_id")
    route = F.when(i % 5 == 0, "structured").when(i % 5 == 1, F.lit(None)).when(i % 5 == 2, "elsewhere").otherwise("single_hop")
    ids = F.when(i % 4 == 1, F.array().cast("array<string>")).when(i % 4 != 0, F.array(i.cast("string")))
    items = rows.select(i.alias("id"), route.alias("expected_route"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("reviewed"), F.lit("someone").alias("reviewer"), ids.alias("expected_article_ids"))
    return evaluation.annotation_problems(items)


@query("""SELECT 'a-' || lpad(item_id::VARCHAR, greatest(2, length(item_id::VARCHAR))::INTEGER, '0') AS id, item_id AS numeric_id, md5(text) AS question, true AS answerable, [item_id::VARCHAR] AS expected, 'benchmark' AS category FROM benchmark
UNION ALL SELECT 'h-' || lpad(doc_id::VARCHAR, greatest(2, length(doc_id::VARCHAR))::INTEGER, '0'), NULL, md5(text), true, ['x'], 'long_tail' FROM documents WHERE lang = 'de'
UNION ALL SELECT 'u-' || lpad(doc_id::VARCHAR, greatest(2, length(doc_id::VARCHAR))::INTEGER, '0'), NULL, md5(text), false, [], 'unanswerable' FROM documents WHERE lang = 'fr'""")
def locked_items(spark, sf_dir):
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.md5("text").alias("question"), "lang")
    known = bench.select(F.col("item_id").alias("id"), F.md5("text").alias("question"), F.array(F.col("item_id").cast("string")).alias("expected"), F.lit("benchmark").alias("category"))
    return evaluation.locked_items(known, docs.filter("lang = 'de'").withColumn("expected", F.array(F.lit("x"))), docs.filter("lang = 'fr'"))


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) AS spec_no, doc_id, lang, source, doc_id % 3 = 0 AS several FROM documents),
n AS (SELECT *, NOT several AND row_number() OVER (PARTITION BY several ORDER BY spec_no) <= 10 AS tail FROM s)
SELECT 'spec-' || spec_no AS id, CASE WHEN tail THEN '{text.LONG_TAIL_PREFIX}' ELSE '' END || 'which? ' || doc_id AS question, CASE WHEN several THEN 'multi_hop' WHEN tail THEN 'long_tail_typo' ELSE 'single_hop' END AS stratum, CASE WHEN several THEN 'global_or_multi_hop' ELSE 'single_hop' END AS expected_route,
CASE WHEN several THEN [doc_id::VARCHAR, lang] ELSE [doc_id::VARCHAR] END AS expected, CASE WHEN several AND lang <> source THEN [source, lang] ELSE [source] END AS source_laws FROM n""")
def materialised_holdout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    from ..operators.windows import place

    one = F.struct(F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("law_name"))
    two = F.struct(F.col("lang").alias("article_id"), F.col("lang").alias("law_name"))
    specs = place(docs, "doc_id").select((F.col("place") + 1).alias("spec_no"), F.concat(F.lit("spec-"), F.col("place") + 1).alias("id"), F.when(F.col("doc_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one)).alias("sources"), "doc_id")
    asked = specs.select("id", F.concat(F.lit("which? "), "doc_id").alias("question"))
    return evaluation.materialised(specs.drop("doc_id"), asked, "holdout")


@query(r"""WITH a AS (SELECT p_partkey AS article_id, p_size % 7 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 4 = 0) AS fine FROM part),
e AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem)
SELECT source, target FROM e JOIN a x ON x.article_id = source AND x.fine JOIN a y ON y.article_id = target AND y.fine WHERE source <> target""")
def usable_edges(spark, sf_dir):
    """Edges between parts that no returned line used and whose text says something: every seventh size only names its date of effect."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    articles = part.select(F.col("p_partkey").alias("article_id"), F.when(F.col("p_size") % 7 == 0, "本辦法自發布日施行。").otherwise("申請人應檢附文件向主管機關提出，並於三十日內補正。").alias("content"))
    used = lines.filter("l_returnflag = 'R' and l_partkey % 4 = 0").select(F.col("l_partkey").alias("article_id"))
    edges = lines.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return evaluation.usable_sources(articles, used, edges, text.trivial(F.col("content")))[1]


@query("SELECT 0::BIGINT AS repeated_nodes, 0::BIGINT AS addable_edges, 0::BIGINT AS unknown_edges")
def disjoint_edges(spark, sf_dir):
    """Edges without a common node: none repeats a node, none could be added, all are given ones."""
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey") % 500).alias("source"), F.concat(F.lit("p"), F.col("l_partkey") % 300).alias("target")).distinct()
    taken = sampling.disjoint_edges(edges, 7)
    nodes = taken.select(F.col("source").alias("n")).unionByName(taken.select(F.col("target").alias("n")))
    repeated = nodes.groupBy("n").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_nodes"))
    free = edges.join(nodes.toDF("source"), "source", "left_anti").join(nodes.toDF("target"), "target", "left_anti").agg(F.count(F.lit(1)).alias("addable_edges"))
    unknown = taken.join(edges, ["source", "target"], "left_anti").agg(F.count(F.lit(1)).alias("unknown_edges"))
    return repeated.crossJoin(free).crossJoin(unknown)


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A' WHEN doc_id % 3 = 0 THEN 'tie' ELSE 'B' END AS shown, doc_id % 5 < 2 AS flip FROM labels)
SELECT CASE WHEN flip AND shown = 'A' THEN 'B' WHEN flip AND shown = 'B' THEN 'A' ELSE shown END AS winner, count(*) AS n FROM r GROUP BY 1""")
def blind_verdicts(spark, sf_dir):
    """Verdicts on pairs of which some were shown in reverse, as if none had been."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(i % 2 == 0, "A").when(i % 3 == 0, "tie").otherwise("B").alias("shown"), (i % 5 < 2).alias("flip"))
    return rows.select(sampling.unflipped(F.col("shown"), F.col("flip")).alias("winner")).groupBy("winner").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MEASURED} SELECT count(*) FILTER (rule_decision <> 'answer') AS activations, count(*) FILTER (NOT evidence_complete) AS needs_correction, count(*) AS items, 1.0::DOUBLE AS route_accuracy FROM me""")
def prospective_summary(spark, sf_dir):
    rows = measured(spark, sf_dir)
    return prospective.route_accuracy(rows).crossJoin(rows.agg(F.count_if("rule_activates").alias("activations")))

