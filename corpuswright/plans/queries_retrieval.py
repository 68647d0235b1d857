"""Queries over ranked retrieval: documents stand for articles, benchmark for questions, embeddings for a dense index.

Searches take as queries every vector whose id is divisible by 100, against all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokenize
from ..operators import citations, evaluation, gate, metrics, postings, retrieval, segmentation, segments, trace, vectorindex, windows
from . import index_build
from .catalogue import query, table
from .shared import fixed, new_path, together

_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_LISTS = f"lists AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)"
_ASKED = "SELECT item_id AS query_id, text FROM benchmark"


def _bm25(asked: str = _ASKED, tokens: str = _TOKENS) -> str:
    """bm: the best twenty of each query by BM25."""
    return rf"""
post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM lists),
tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM post GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
tot AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM lists),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens.format("text")}) AS term FROM ({asked})) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term), tot GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20)"""


def _dense(asked: str = _ASKED) -> str:
    """de: the best twenty of each query by the cosine of hashed vectors."""
    hashed = lambda name, key, rows: f"""
{name}v AS (SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS i, sum(1 - 2 * (CAST('0x' || substr(h, 9, 8) AS BIGINT) % 2)) AS x FROM (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest(t) AS w FROM {rows})) GROUP BY 1, 2),
{name}n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}v GROUP BY 1 HAVING sum(x * x) > 0),"""  # noqa: E731
    return hashed("d", "doc_id", "lists") + hashed("q", "query_id", f"(SELECT query_id, {_TOKENS.format('text')} AS t FROM ({asked}))") + """
dp AS (SELECT query_id, doc_id, sum(a.x * b.x) AS p FROM dv a JOIN qv b USING (i) GROUP BY 1, 2),
dc AS (SELECT qn.query_id, dn.doc_id, round(coalesce(p, 0) / (dn.n * qn.n), 6) AS score FROM qn CROSS JOIN dn LEFT JOIN dp ON dp.query_id = qn.query_id AND dp.doc_id = dn.doc_id),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dc QUALIFY rank <= 20)"""


_FUSED = """
al AS (SELECT query_id, doc_id, rank, 0 AS list FROM bm UNION ALL SELECT query_id, doc_id, rank, 1 FROM de),
ru AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS exact, min((list, rank)) AS first, list_sort(list_distinct(list(list))) AS lists FROM al GROUP BY 1, 2),
fu AS (SELECT query_id, doc_id, round(exact, 9) AS rrf_score, lists, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first) AS fused_rank FROM ru)"""
_RERANKED = rf"""
asked AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("text")}) AS a FROM benchmark),
ov AS (SELECT query_id, doc_id, fused_rank, coalesce(len(list_filter(a, lambda x: list_contains(t, x))) / nullif(len(a), 0)::DOUBLE, 0) * 4 - 2 AS raw FROM fu JOIN lists USING (doc_id) JOIN asked USING (query_id) WHERE fused_rank <= 20),
re AS (SELECT query_id, doc_id, fused_rank, round(CASE WHEN raw >= 0 THEN 1 / (1 + exp(-raw)) ELSE exp(raw) / (1 + exp(raw)) END, 9) AS rerank_score FROM ov),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank FROM re QUALIFY rank <= 5)"""
_HYBRID = f"{_LISTS}, {_bm25()}, {_dense()}, {_FUSED}"
_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_VECTORS = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.v AS a, d.v AS b FROM e q JOIN e d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)"""


def _ranked(name: str, score: str) -> str:
    return f"{name} AS (SELECT query_id, doc_id, round({score}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, doc_id) AS rank FROM p QUALIFY rank <= 20)"


_DOT = "list_dot_product(a, b)"
_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
_L1 = "-list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))"
_CUT = "list_dot_product(a[1:32], b[1:32])"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and doc_id of the documents that hold a question's text."""
    return fixed(retrieval.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).withColumnRenamed("item_id", "query_id")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return all_, all_.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qvector"))


@query(f"WITH {_LISTS}, {_bm25()} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_top20(spark, sf_dir):
    return retrieval.bm25(retrieval.build_index(table(spark, sf_dir, "documents")), questions(spark, sf_dir))


#: Letters of the synthetic prose as Han characters, so that words of the domain arise.
_FROM, _TO = "aeiournthsldcm", "長期照顧服務法老人福利機構"
_HAN = "translate(lower({}), '%s', '%s')" % (_FROM, _TO)
_HAN_WORDS = "|".join(sorted(tokenize.USER_WORDS, key=len, reverse=True))
_HAN_TOKENS = r"list_filter(regexp_extract_all(lower({}), '(%s|\p{{Han}}{{1,2}}|[0-9\p{{Latin}}]+)'), lambda x: NOT (length(x) = 1 AND contains('%s', x)))" % (_HAN_WORDS, tokenize.STOPWORDS)


@query(rf"""WITH han AS (SELECT doc_id, {_HAN.format("text")} AS text FROM documents), lists AS (SELECT doc_id, {_HAN_TOKENS.format("text")} AS t FROM han),
{_bm25(f"SELECT item_id AS query_id, {_HAN.format('text')} AS text FROM benchmark", _HAN_TOKENS)} SELECT query_id, doc_id, score, rank FROM bm""")
def bm25_han(spark, sf_dir):
    """BM25 over Han text, segmented by the words of the domain."""
    han = F.translate(F.lower("text"), _FROM, _TO)
    docs, asked = table(spark, sf_dir, "documents").withColumn("text", han), questions(spark, sf_dir).withColumn("text", han)
    return retrieval.bm25(retrieval.build_index(docs), asked)


@query(f"WITH {_LISTS}, {_bm25()} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_inverted(spark, sf_dir):
    """BM25 from an inverted index that is written and opened again, by its postings' blocks."""
    path = new_path(spark)
    postings.build(table(spark, sf_dir, "documents"), path)
    return postings.search(postings.Postings(spark, [postings.Segment(path)]), questions(spark, sf_dir))


@query(f"""WITH now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'renewed text ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4),
{_LISTS.replace('FROM documents', 'FROM now')}, {_bm25()} SELECT query_id, doc_id, score, rank FROM bm""")
def incremental_bm25(spark, sf_dir):
    """BM25 from an index of two versions: all documents, then with every tenth one's text renewed and another tenth taken out, of which only the changes are written."""
    first = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    then = first.filter("chunk_id % 10 <> 4").withColumn("text", F.when(F.col("chunk_id") % 10 == 3, F.concat(F.lit("renewed text "), "text")).otherwise(F.col("text")))
    store = segments.Segments(spark, new_path(spark))
    store.build(first, "1")
    store.build(then, "2")
    return postings.search(store.index(), questions(spark, sf_dir))


_GRAMS = " UNION ALL ".join(f"SELECT substr(run, CAST(i AS BIGINT), {n}) AS word FROM (SELECT run, unnest(range(1, length(run) - {n} + 2)) AS i FROM runs WHERE length(run) >= {n})" for n in range(1, 5))


@query(rf"""WITH runs AS (SELECT unnest(regexp_extract_all({_HAN.format("text")}, '\p{{Han}}+')) AS run FROM documents),
g AS (SELECT word, count(*) AS n FROM ({_GRAMS}) GROUP BY 1),
t AS (SELECT sum(n)::HUGEINT AS total FROM g WHERE length(word) = 1),
often AS (SELECT * FROM g WHERE length(word) = 1 OR n >= 5),
cuts AS (SELECT word, n, unnest(range(1, length(word))) AS i FROM often WHERE length(word) > 1),
held AS (SELECT c.word FROM cuts c JOIN often a ON a.word = substr(c.word, 1, CAST(i AS BIGINT)) JOIN often b ON b.word = substr(c.word, CAST(i + 1 AS BIGINT)), t
         GROUP BY 1 HAVING bool_and(c.n::HUGEINT * total >= a.n::HUGEINT * b.n * 2))
SELECT word, n, round(ln(n / total::DOUBLE), 9) AS weight FROM often, t WHERE length(word) = 1 OR word IN (SELECT word FROM held)""")
def han_vocabulary(spark, sf_dir):
    """Words of Han text and their weights, as the corpus has them."""
    return segmentation.vocabulary(_han(spark, sf_dir), cohesion=2)


@query()
def han_segments(spark, sf_dir):
    """How often each word stands on the best path of any text, by the learned vocabulary and the listed words."""
    docs = _han(spark, sf_dir)
    return segmentation.word_counts(docs, segmentation.learned(docs, cohesion=2))


@query()
def bm25_segmented(spark, sf_dir):
    """BM25 over Han text in words of the best path, documents and questions alike."""
    docs, asked = _han(spark, sf_dir), questions(spark, sf_dir).withColumn("text", F.translate(F.lower("text"), _FROM, _TO))
    return retrieval.bm25(retrieval.build_index(docs, tokens=segmentation.learned(docs, cohesion=2).tokens), asked)


def _han(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.translate(F.lower("text"), _FROM, _TO))


@query(f"WITH {_VECTORS}, {_ranked('r', _COS)} SELECT * FROM r")
def dense_top20(spark, sf_dir):
    return retrieval.dense(*vectors(spark, sf_dir), skip_self=True)


@query(f"WITH {_VECTORS}, {_ranked('r', _COS)} SELECT * FROM r")
def vector_index_top20(spark, sf_dir):
    """The exact search of a vector index that is written and opened again."""
    corpus, asked = vectors(spark, sf_dir)
    path = new_path(spark)
    vectorindex.build(corpus, path)
    return vectorindex.search(vectorindex.VectorIndex(spark, path), asked, skip_self=True)


@query()
def vector_probe_recall(spark, sf_dir):
    """How much of each query's exact hits the probing search finds."""
    corpus, asked = vectors(spark, sf_dir)
    index = vectorindex.build(corpus, new_path(spark))
    found = vectorindex.search(index, asked, probes=index.probes, skip_self=True)
    return vectorindex.recall_of(found, retrieval.dense(corpus, asked, skip_self=True))


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)},
al AS (SELECT query_id, doc_id, rank, 0 AS list FROM x UNION ALL SELECT query_id, doc_id, rank, 1 FROM y),
ru AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS exact, min((list, rank)) AS first, list_sort(list_distinct(list(list))) AS lists FROM al GROUP BY 1, 2)
SELECT query_id, doc_id, round(exact, 9) AS rrf_score, lists, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first) AS fused_rank FROM ru""")
def rrf_hybrid(spark, sf_dir):
    corpus, asked = vectors(spark, sf_dir)
    x, y = retrieval.dense(corpus, asked, "dot", skip_self=True), retrieval.dense(corpus, asked, "l1", skip_self=True)
    return retrieval.rrf(x.withColumn("list", F.lit(0)).unionByName(y.withColumn("list", F.lit(1))))


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)}, {_ranked('z', _CUT)},
al AS (SELECT *, 0 AS list FROM x UNION ALL SELECT *, 1 FROM y UNION ALL SELECT *, 2 FROM z),
ru AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS exact, min((list, rank)) AS first FROM al GROUP BY 1, 2),
be AS (SELECT query_id, doc_id, max(score) AS dense_score, arg_max(rank, (score, -list)) AS dense_rank FROM al WHERE list IN (0, 2) GROUP BY 1, 2)
SELECT query_id, doc_id, round(exact, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first) AS fused_rank, dense_score, dense_rank
FROM ru LEFT JOIN be USING (query_id, doc_id)""")
def rrf_multi_query(spark, sf_dir):
    corpus, asked = vectors(spark, sf_dir)
    lists = [retrieval.dense(corpus, asked, f, dim, skip_self=True).withColumn("list", F.lit(i)) for i, (f, dim) in enumerate((("dot", None), ("l1", None), ("dot", 32)))]
    every = lists[0].unionByName(lists[1]).unionByName(lists[2])
    best = retrieval.best_per_source(every.filter("list in (0, 2)"), "dense")
    return retrieval.rrf(every).drop("lists").join(best, ["query_id", "doc_id"], "left")


@query(f"WITH {_HYBRID}, {_RERANKED} SELECT query_id, doc_id, rerank_score, rank, fused_rank FROM fi")
def rerank_top5(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    return retrieval.rerank(retrieval.hybrid(docs, asked), docs, asked).select("query_id", "doc_id", "rerank_score", "rank", "fused_rank")


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)},
a AS (SELECT query_id, list_sort(list(doc_id)) AS bm25_ids FROM x GROUP BY 1), b AS (SELECT query_id, list_sort(list(doc_id)) AS dense_ids FROM y GROUP BY 1),
m AS (SELECT query_id, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM x WHERE rank <= 5 GROUP BY 1),
o AS (SELECT *, list_sort(list_filter(bm25_ids, lambda v: list_contains(dense_ids, v))) AS overlap_ids FROM a JOIN b USING (query_id) JOIN m USING (query_id))
SELECT query_id, bm25_ids, dense_ids, overlap_ids, len(overlap_ids) AS overlap_count, round(len(overlap_ids) / (len(bm25_ids) + len(dense_ids) - len(overlap_ids))::DOUBLE, 6) AS overlap_jaccard, round(margin, 6) AS top1_top2_margin FROM o""")
def retrieval_diagnostics(spark, sf_dir):
    corpus, asked = vectors(spark, sf_dir)
    x, y = retrieval.dense(corpus, asked, "dot", skip_self=True), retrieval.dense(corpus, asked, "l1", skip_self=True)
    return retrieval.diagnostics(x, y, x.filter("rank <= 5"), "score")



@query(f"""WITH {_HYBRID}, {_RERANKED}, {_GOLD},
h AS (SELECT q.query_id, min(rank) FILTER (fi.doc_id IS NOT NULL) AS hit_rank FROM (SELECT DISTINCT query_id FROM gold) q LEFT JOIN (SELECT fi.* FROM fi JOIN gold USING (query_id, doc_id)) fi USING (query_id) GROUP BY 1)
SELECT count(*) AS queries, avg((hit_rank IS NOT NULL)::INT::DOUBLE) AS recall, round(avg(coalesce(1.0 / hit_rank, 0)), 9) AS mrr FROM h""")
def recall_mrr(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    truth, fused = together(lambda: gold(spark, sf_dir), lambda: retrieval.hybrid(docs, asked))
    final = retrieval.rerank(fused, docs, asked)
    return _recall(final.select("query_id", "doc_id", "rank"), truth)


def _recall(final: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hits = final.join(truth, ["query_id", "doc_id"], "left_semi").groupBy(*by, "query_id").agg(F.min("rank").alias("hit_rank"))
    asked = truth.select("query_id").distinct()
    if by:
        asked = asked.crossJoin(final.select(*by).distinct())
    joined = asked.join(hits, [*by, "query_id"], "left")
    return metrics.recall_mrr(joined, by).withColumn("mrr", F.round("mrr", 9))


@query(f"""WITH {_HYBRID}, {_RERANKED}, {_GOLD},
al2 AS (SELECT 'lexical' AS config, query_id, doc_id, rank FROM bm WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM de WHERE rank <= 5
 UNION ALL SELECT 'fused', query_id, doc_id, fused_rank FROM fu WHERE fused_rank <= 5 UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM fi),
h AS (SELECT config, q.query_id, min(rank) AS hit_rank FROM (SELECT DISTINCT query_id FROM gold) q CROSS JOIN (SELECT DISTINCT config FROM al2) LEFT JOIN (SELECT al2.* FROM al2 JOIN gold USING (query_id, doc_id)) x USING (config, query_id) GROUP BY 1, 2)
SELECT config, count(*) AS queries, avg((hit_rank IS NOT NULL)::INT::DOUBLE) AS recall, round(avg(coalesce(1.0 / hit_rank, 0)), 9) AS mrr FROM h GROUP BY 1""")
def config_matrix(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    truth, found = together(lambda: gold(spark, sf_dir), lambda: retrieval.retrieve(retrieval.Retriever.of(docs), asked))
    final = retrieval.rerank(found.fused, docs, asked)
    lists = [("lexical", found.lexical), ("dense", found.dense), ("fused", found.fused.withColumnRenamed("fused_rank", "rank")), ("reranked", final)]
    every = None
    for name, rows in lists:
        part = rows.filter("rank <= 5").select(F.lit(name).alias("config"), "query_id", "doc_id", "rank")
        every = part if every is None else every.unionByName(part)
    return _recall(every, truth, ("config",))


_EDGES = "edges AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem)"


@query("""WITH edges AS (SELECT l_orderkey AS source, l_partkey AS target, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2),
hits AS (SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5),
st AS (SELECT query_id, target, min((rank, ord, source)) AS b FROM hits JOIN edges ON item = source JOIN part ON p_partkey = target
       WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = hits.query_id AND h.item = edges.target) GROUP BY 1, 2)
SELECT query_id, target, b[3] AS via, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], target) AS place FROM st QUALIFY place <= 5""")
def graph_expand(spark, sf_dir):
    lines, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    edges = lines.groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.min("l_linenumber").alias("ord"))
    ranked = retrieval.ranked(orders.select("o_custkey", "o_orderkey", "o_totalprice"), 5, "o_custkey", "o_orderkey", "o_totalprice")
    hits = ranked.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), "rank")
    return citations.expand(hits, edges, part.select(F.col("p_partkey").alias("target")))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT 's' || source FROM edges UNION SELECT 't' || target FROM edges)) AS connected_nodes, (SELECT count(*) FROM edges) AS edges")
def graph_stats(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_partkey")).alias("source"), F.concat(F.lit("t"), F.col("l_suppkey")).alias("target")).distinct()
    return citations.graph_stats(edges)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_valid_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    nodes = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("target"))
    return citations.valid_edges(edges, nodes).select(F.col("source").alias("o_orderkey"), F.col("target").alias("o_custkey"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(documents.text, b.text))")
def anti_known(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.join(gold(spark, sf_dir), "doc_id", "left_anti").select("doc_id")


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_name, 'part ' || l_partkey) AS part_name, coalesce(s_name, 'supplier ' || l_suppkey) AS supplier_name
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def lookup_join(spark, sf_dir):
    lines, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = lines.join(part.filter("p_size > 10"), F.col("p_partkey") == F.col("l_partkey"), "left").join(supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.concat(F.lit("part "), "l_partkey")).alias("part_name"), F.coalesce("s_name", F.concat(F.lit("supplier "), "l_suppkey")).alias("supplier_name"))


@query("""SELECT event_id, user_id, last_value(event_id IGNORE NULLS) OVER w AS nearest FROM (SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS anchor FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""".replace("last_value(event_id IGNORE NULLS)", "last_value(anchor IGNORE NULLS)"))
def nearest_preceding(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return windows.nearest_preceding(events, F.col("event_type") == "signup", F.col("event_id"), "user_id", "ts", "event_id").select("event_id", "user_id", "nearest")


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)},
t AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, list_sort(list(doc_id)) AS xs FROM x GROUP BY 1),
u AS (SELECT query_id, list(doc_id) AS ys FROM y GROUP BY 1),
s AS (SELECT query_id, s1, s1 - s2 AS margin, len(list_filter(xs, lambda v: list_contains(ys, v))) AS cnt FROM t JOIN u USING (query_id)),
g AS (SELECT *, cnt / (40.0::DOUBLE - cnt) AS jac FROM s),
d AS (SELECT *, (s1 < 0.6) AS low, (cnt >= 1 OR jac >= 0.03) AS ok, coalesce(margin < 0.015, false) AS small FROM g)
SELECT query_id, round(s1, 6) AS top1, round(margin, 6) AS margin, cnt AS overlap_count,
CASE WHEN low OR NOT ok OR small OR s1 < 0.69 THEN 'refine_once' ELSE 'answer' END AS first_decision,
CASE WHEN low OR NOT ok THEN 'refuse' ELSE 'answer' END AS final_decision,
list_filter([CASE WHEN low THEN 'low_top1' WHEN s1 >= 0.69 THEN 'strong_top1' END, CASE WHEN small THEN 'small_top1_top2_margin' END, CASE WHEN NOT ok THEN 'no_lexical_semantic_overlap' END], lambda v: v IS NOT NULL) AS rules FROM d""")
def gate_decide(spark, sf_dir):
    s = _signals(spark, sf_dir)
    first, last = gate.grade(F.col, F.lit(0)), gate.grade(F.col, F.lit(1))
    return s.select("query_id", F.round("top1_rerank", 6).alias("top1"), F.round("top1_top2_margin", 6).alias("margin"), F.col("bm25_dense_overlap_count").alias("overlap_count"), first["decision"].alias("first_decision"), last["decision"].alias("final_decision"), last["rules_triggered"].alias("rules"))


def _signals(spark, sf_dir) -> DataFrame:
    corpus, asked = vectors(spark, sf_dir)
    x, y = retrieval.dense(corpus, asked, "dot", skip_self=True), retrieval.dense(corpus, asked, "l1", skip_self=True)
    top = gate.gate_signals(x.select("query_id", "rank", "score", F.col("doc_id").cast("string").alias("article_id")))
    seen = retrieval.diagnostics(x, y, x, "score").select("query_id", F.col("overlap_count").alias("bm25_dense_overlap_count"), (F.col("overlap_count") / (40 - F.col("overlap_count"))).alias("bm25_dense_overlap_jaccard"))
    none = F.lit(None).cast("double")
    return top.join(seen, "query_id").withColumns({"required_articles": F.expr("cast(array() as array<string>)"), "required_article_coverage": none, "graph_added_required_article": F.lit(False), "ambiguous_or_multi_hop": F.lit(False), "evidence_requirement_coverage": none})


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)},
t AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, list(doc_id) AS xs FROM x GROUP BY 1), u AS (SELECT query_id, list(doc_id) AS ys FROM y GROUP BY 1)
SELECT query_id, s1 AS top1_rerank, round(s1 - s2, 6) AS top1_top2_margin, len(list_filter(xs, lambda v: list_contains(ys, v))) AS overlap_count FROM t JOIN u USING (query_id)""")
def gate_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("query_id", "top1_rerank", F.round("top1_top2_margin", 6).alias("top1_top2_margin"), F.col("bm25_dense_overlap_count").alias("overlap_count"))


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)},
t AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, list(doc_id) AS xs FROM x GROUP BY 1), u AS (SELECT query_id, list(doc_id) AS ys FROM y GROUP BY 1),
s AS (SELECT query_id, s1, s1 - s2 AS margin, len(list_filter(xs, lambda v: list_contains(ys, v))) AS cnt FROM t JOIN u USING (query_id)),
d AS (SELECT *, s1 < 0.6 AS low, (cnt >= 1 OR cnt / (40.0::DOUBLE - cnt) >= 0.03) AS ok, coalesce(margin < 0.015, false) AS small FROM s),
m AS (SELECT 'current_baseline' AS mode, CASE WHEN s1 < 0.636 THEN 'refuse' ELSE 'answer' END AS decision FROM d
 UNION ALL SELECT unnest(['confidence_gate_only', 'refinement_enabled', 'full_adaptive_route']), CASE WHEN low OR NOT ok OR small OR s1 < 0.69 THEN 'refine_once' ELSE 'answer' END FROM d)
SELECT mode, decision, CASE WHEN mode LIKE 'c%' THEN decision <> 'answer' ELSE decision = 'refuse' END AS refused, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def gate_modes(spark, sf_dir):
    return gate.with_modes(_signals(spark, sf_dir)).groupBy("mode", "decision", "refused").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)},
t AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, list(doc_id) AS xs FROM x GROUP BY 1), u AS (SELECT query_id, list(doc_id) AS ys FROM y GROUP BY 1),
s AS (SELECT query_id, s1, s1 - s2 AS margin, len(list_filter(xs, lambda v: list_contains(ys, v))) AS cnt FROM t JOIN u USING (query_id))
SELECT query_id, round(1 / (1 + exp(-(0.1 + -1.5 * (s1 - 0.6) / 0.1 + -0.5 * (margin - 0.05) / 0.02 + -0.2 * (cnt - 8.0) / 4.0))), 6) AS risk FROM s""")
def ml_score(spark, sf_dir):
    rows = _signals(spark, sf_dir)
    made = rows.select("query_id", *gate.gate_features())
    weights = {"top1_rerank": -1.5, "top1_top2_margin": -0.5, "bm25_dense_overlap_count": -0.2}
    means, scales = {"top1_rerank": 0.6, "top1_top2_margin": 0.05, "bm25_dense_overlap_count": 8.0}, {"top1_rerank": 0.1, "top1_top2_margin": 0.02, "bm25_dense_overlap_count": 4.0}
    return made.select("query_id", F.round(gate.risk(0.1, weights, means, scales), 6).alias("risk"))


@query(f"""WITH {_VECTORS}, {_ranked('x', _DOT)}, {_ranked('y', _L1)},
t AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, list(doc_id) AS xs FROM x GROUP BY 1), u AS (SELECT query_id, list(doc_id) AS ys FROM y GROUP BY 1),
s AS (SELECT query_id, s1, s1 - s2 AS margin, len(list_filter(xs, lambda v: list_contains(ys, v))) AS cnt FROM t JOIN u USING (query_id))
SELECT query_id, s1 AS top1_rerank, 0.0::DOUBLE AS top1_missing, round(margin, 6) AS top1_top2_margin, 0.0::DOUBLE AS margin_missing, cnt::DOUBLE AS bm25_dense_overlap_count, round(cnt / (40.0::DOUBLE - cnt), 9) AS bm25_dense_overlap_jaccard,
1.0::DOUBLE AS required_article_coverage, 0.0::DOUBLE AS has_required_articles, 0.0::DOUBLE AS graph_added_required_article, 0.0::DOUBLE AS ambiguous_or_multi_hop, 1.0::DOUBLE AS evidence_requirement_coverage, 0.0::DOUBLE AS has_evidence_requirements FROM s""")
def ml_features(spark, sf_dir):
    made = _signals(spark, sf_dir).select("query_id", *gate.gate_features())
    return made.withColumn("top1_top2_margin", F.round("top1_top2_margin", 6)).withColumn("bm25_dense_overlap_jaccard", F.round("bm25_dense_overlap_jaccard", 9))


@query(f"""WITH {_HYBRID}, {_GOLD}, h AS (SELECT DISTINCT query_id FROM fu JOIN gold USING (query_id, doc_id) WHERE fused_rank <= 20)
SELECT count(h.query_id)::DOUBLE / nullif(count(*), 0) AS recall, count(h.query_id)::DOUBLE / nullif(count(*), 0) >= 0.9 AS passed FROM (SELECT DISTINCT query_id FROM gold) g LEFT JOIN h USING (query_id)""")
def index_regression(spark, sf_dir):
    """Recall among the fused twenty of an index over the documents, with the hashing embedder."""
    docs, truth = table(spark, sf_dir, "documents"), gold(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("parent_id"), "text")
    chunks = fixed(rows.join(retrieval.hashed_vectors(rows.select("chunk_id", "text")), "chunk_id"))
    asked = questions(spark, sf_dir).join(truth.select("query_id").distinct(), "query_id", "left_semi")
    return index_build.regression(chunks, asked, truth.select("query_id", F.col("doc_id").alias("article_id")), retrieval.hashed_vectors, 0.9)


_TWICE = "SELECT item_id * 10 + place AS query_id, text FROM (SELECT item_id, 0 AS place, trim(text) AS text FROM benchmark UNION ALL SELECT item_id, 1, trim(substr(text, 1, CAST(length(text) // 2 AS BIGINT))) FROM benchmark) WHERE text <> ''"


@query(rf"""WITH {_LISTS}, tw AS ({_TWICE}), {_bm25("SELECT * FROM tw")}, {_dense("SELECT * FROM tw")},
al AS (SELECT query_id // 10 AS query_id, doc_id, score, rank, 2 * (query_id % 10) AS list FROM bm UNION ALL SELECT query_id // 10, doc_id, score, rank, 2 * (query_id % 10) + 1 FROM de),
ru AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS exact, min((list, rank)) AS first FROM al GROUP BY 1, 2),
be AS (SELECT query_id, doc_id, max(score) FILTER (list % 2 = 0) AS bm25_score, arg_max(rank, (score, -list)) FILTER (list % 2 = 0) AS bm25_rank, max(score) FILTER (list % 2 = 1) AS dense_score, arg_max(rank, (score, -list)) FILTER (list % 2 = 1) AS dense_rank FROM al GROUP BY 1, 2)
SELECT query_id, doc_id, round(exact, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first) AS fused_rank, bm25_score, bm25_rank, dense_score, dense_rank FROM ru JOIN be USING (query_id, doc_id)""")
def multi_query_retrieval(spark, sf_dir):
    """A question and its first half as two queries, and the question again, which counts once."""
    asked = questions(spark, sf_dir)
    half = F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))")
    queries = asked.select("query_id", F.posexplode(F.array("text", half, F.concat(F.lit(" "), "text"))).alias("ord", "text"))
    found = retrieval.retrieve_multi(retrieval.Retriever.of(table(spark, sf_dir, "documents")), queries)
    return found.fused.drop("lists")


_HALF = "SELECT item_id AS query_id, trim(substr(text, 1, CAST(length(text) // 2 AS BIGINT))) AS text FROM benchmark WHERE trim(substr(text, 1, CAST(length(text) // 2 AS BIGINT))) <> ''"
_RERANKED_HALF = _RERANKED.replace("SELECT item_id AS query_id, list_distinct", "SELECT query_id, list_distinct").replace("FROM benchmark),", f"FROM ({_HALF})),")
_FUSED_BOTH = """
al AS (SELECT query_id // 10 AS query_id, doc_id, rank, 2 * (query_id % 10) AS list FROM bm UNION ALL SELECT query_id // 10, doc_id, rank, 2 * (query_id % 10) + 1 FROM de),
ru AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS exact, min((list, rank)) AS first FROM al GROUP BY 1, 2),
fu AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first) AS fused_rank FROM ru)"""


def _hits(name: str, inner: str) -> str:
    return f"SELECT '{name}' AS strategy, count(DISTINCT query_id) AS hits FROM (WITH {inner} SELECT query_id, doc_id FROM fi) JOIN gold USING (query_id, doc_id)"


@query(f"""WITH {_GOLD}, st AS (
{_hits("question", f"{_HYBRID}, {_RERANKED}")}
UNION ALL {_hits("first half", f"{_LISTS}, {_bm25(_HALF)}, {_dense(_HALF)}, {_FUSED}, {_RERANKED_HALF}")}
UNION ALL {_hits("both", f"{_LISTS}, tw AS ({_TWICE}), {_bm25('SELECT * FROM tw')}, {_dense('SELECT * FROM tw')}, {_FUSED_BOTH}, {_RERANKED}")})
SELECT strategy, hits, (SELECT count(DISTINCT query_id) FROM gold) AS queries FROM st""")
def rewrite_strategies(spark, sf_dir):
    """Questions with a document among the first five, by the queries that a strategy asks: the question, its first half, or both."""
    docs, asked, truth = table(spark, sf_dir, "documents"), questions(spark, sf_dir), gold(spark, sf_dir)
    half = F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))")
    as_queries = lambda *texts: asked.select("query_id", F.posexplode(F.array(*texts)).alias("ord", "text"))
    strategies = {"question": as_queries("text"), "first half": as_queries(half), "both": as_queries("text", half)}
    return evaluation.strategy_hits(retrieval.Retriever.of(docs), docs, asked, strategies, truth)


@query(f"""WITH {_HYBRID}, {_RERANKED}
SELECT fi.query_id, fi.rank, fi.doc_id, list_transform(fu.lists, lambda x: CASE x WHEN 0 THEN 'bm25' ELSE 'vector' END) AS sources, bm.score AS bm25_score, bm.rank AS bm25_rank, de.score AS dense_score, de.rank AS dense_rank, fu.rrf_score, fi.rerank_score
FROM fi JOIN fu ON fu.query_id = fi.query_id AND fu.doc_id = fi.doc_id LEFT JOIN bm ON bm.query_id = fi.query_id AND bm.doc_id = fi.doc_id LEFT JOIN de ON de.query_id = fi.query_id AND de.doc_id = fi.doc_id""")
def hit_records(spark, sf_dir):
    """What a trace holds of each hit: its scores and ranks in each list, fused and ranked again."""
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    found = retrieval.retrieve(retrieval.Retriever.of(docs), asked)
    each = trace.hit_records(retrieval.rerank(found.fused, docs, asked))
    return each.select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*")
