"""Queries over the corpus: chunks, hashes, versions, catalogues, text extraction and sampling. A document's source stands for its law, its language for a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, tokenize
from ..operators import catalog, chunking, citations, sampling, sentences, versions, windows
from ..sources import laws
from . import index_build
from .catalogue import query, table
from .shared import new_path, tasks_for

_WORDS = r"len(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"
_CHUNKS = rf"""
p AS (SELECT doc_id, i, para, {_WORDS.format("para")} AS n FROM (SELECT doc_id, unnest(ps) AS para, unnest(range(1, len(ps) + 1)) AS i
      FROM (SELECT doc_id, list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '') AS ps FROM documents WHERE {_WORDS.format("text")} > 100))),
r(doc_id, i, seg, acc, last_alone) AS (
  SELECT doc_id, 1::BIGINT, 1, CASE WHEN n > 98 THEN 0 ELSE n END, n > 98 FROM p WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, r.seg + CASE WHEN r.last_alone OR (r.acc + p.n > 98) THEN 1 ELSE 0 END,
         CASE WHEN r.last_alone THEN (CASE WHEN p.n > 98 THEN 0 ELSE p.n END) WHEN r.acc + p.n > 98 THEN p.n ELSE r.acc + p.n END,
         r.last_alone AND p.n > 98
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 words a chunk; the prefix has two."""
    return chunking.chunk_articles(docs(spark, sf_dir), "doc_id", "text", F.concat(F.lit("doc "), F.col("doc_id").cast("string")), tokenize.token_count, 100)


@query(f"""WITH RECURSIVE {_CHUNKS},
whole AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id::VARCHAR AS parent_id, 0 AS part, text FROM documents WHERE {_WORDS.format("text")} <= 100),
parts AS (SELECT p.doc_id, seg, 'doc ' || p.doc_id || chr(13) || chr(10) || string_agg(para, chr(13) || chr(10) ORDER BY i) AS text FROM p JOIN r USING (doc_id, i) GROUP BY 1, 2)
SELECT * FROM whole UNION ALL SELECT doc_id || '-p' || seg, doc_id::VARCHAR, seg, text FROM parts""")
def chunk_pack(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("chunk_id", "parent_id", "part", "text")


@query(f"""WITH RECURSIVE {_CHUNKS},
c AS (SELECT doc_id::VARCHAR AS parent_id, 0 AS part FROM documents WHERE {_WORDS.format("text")} <= 100 UNION ALL SELECT DISTINCT doc_id::VARCHAR, seg FROM p JOIN r USING (doc_id, i))
SELECT count(*) AS chunk_count, count(DISTINCT parent_id) AS parent_count, count(*) FILTER (part > 0) AS part_count, list_sort(list(DISTINCT parent_id) FILTER (part > 0)) AS split_parents FROM c""")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunks_of(spark, sf_dir))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    digest = text.article_content_hash(F.col("doc_id").cast("string"), F.col("lang"), F.col("text"), F.lit(""), F.col("source"))
    return d.select(F.concat_ws("-", "source", "doc_id").alias("article_id"), F.col("source").alias("pcode"), digest.alias("hash"))


_HASHED = """h AS (SELECT source || '-' || doc_id AS article_id, source AS pcode,
 sha256('{"article_no":"' || doc_id || '","chapter":' || to_json(lang) || ',"content":' || replace(to_json(text)::VARCHAR, '\\/', '/') || ',"law_modified_date":"","pcode":' || to_json(source) || '}') AS hash FROM documents)"""


@query(f"WITH {_HASHED} SELECT * FROM h")
def article_hash(spark, sf_dir):
    return hashed(spark, sf_dir)


@query(f"""WITH {_HASHED},
d AS (SELECT pcode, count(*) AS article_count, sha256('[' || string_agg('["' || article_id || '","' || hash || '"]', ',' ORDER BY article_id) || ']') AS document_hash FROM h GROUP BY 1),
t AS (SELECT sum(article_count)::BIGINT AS article_count, count(*) AS document_count, sha256('[' || string_agg('["' || pcode || '","' || document_hash || '"]', ',' ORDER BY pcode) || ']') AS corpus_hash FROM d)
SELECT *, '2024-01-01-' || left(corpus_hash, 12) AS version FROM t""")
def corpus_manifest(spark, sf_dir):
    return versions.manifest(hashed(spark, sf_dir), "2024-01-01")


_OLD = "o AS (SELECT doc_id, sha256(text) AS h FROM documents)"
_NEW = "n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT -doc_id - 1, sha256(text) FROM documents WHERE doc_id % 19 = 0)"


def two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and an edition of them in which some are new, changed or gone."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    edited = d.filter("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return d, edited.unionByName(d.filter("doc_id % 19 = 0").withColumn("doc_id", -F.col("doc_id") - 1))


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'NEW' WHEN n.doc_id IS NULL THEN 'DELETED' WHEN o.h <> n.h THEN 'CHANGED' ELSE 'UNCHANGED' END AS status
FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def version_diff(spark, sf_dir):
    a, b = two_versions(spark, sf_dir)
    digest = F.sha2("text", 256)
    return versions.diff(a.select("doc_id", digest.alias("hash")), b.select("doc_id", digest.alias("hash")), "doc_id")


@query(f"WITH {_OLD}, {_NEW} SELECT n.doc_id AS chunk_id, left(n.h, 16) AS hash FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = n.doc_id AND left(o.h, 16) = left(n.h, 16))")
def cache_pending(spark, sf_dir):
    a, b = (x.withColumnRenamed("doc_id", "chunk_id") for x in two_versions(spark, sf_dir))
    return versions.pending(b, a.select("chunk_id", text.short_hash(F.col("text")).alias("hash"))).select("chunk_id", "hash")


@query(f"""WITH w AS (SELECT doc_id, source, {_WORDS.format('text')} AS t FROM documents), l AS (SELECT source, sum(t) AS tokens FROM w GROUP BY 1),
c AS (SELECT count(*) AS n_chunks, coalesce(sum(tokens + t + 160), 0)::BIGINT AS input_tokens FROM w JOIN l USING (source) WHERE doc_id % 13 = 0)
SELECT n_chunks, input_tokens, n_chunks * 60 AS output_tokens, round((input_tokens * 0.25 + n_chunks * 60 * 1.5) / 1e6, 6) AS cost_no_cache,
 round((input_tokens * 0.95 * 0.25 * 0.25 + input_tokens * 0.05 * 0.25 + n_chunks * 60 * 1.5) / 1e6, 6) AS cost_with_implicit_cache FROM c""")
def summary_cost(spark, sf_dir):
    """What summaries of the documents that the cache lacks would cost; a source stands for a law."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law"), "text")
    cache = rows.filter("chunk_id % 13 <> 0").select("chunk_id", text.short_hash(F.col("text")).alias("hash"))
    laws_ = rows.groupBy("law").agg(F.sum(tokenize.token_count(F.col("text"))).alias("tokens"))
    out = versions.summary_cost(versions.pending(rows, cache), laws_, tokenize.token_count)
    return out.withColumns({c: F.round(c, 6) for c in ("cost_no_cache", "cost_with_implicit_cache")})


@query(f"""WITH {_OLD}, {_NEW}, j AS (SELECT o.h AS a, n.h AS b FROM o FULL JOIN n USING (doc_id))
SELECT count(*) FILTER (a = b) AS unchanged, count(*) FILTER (a IS NULL) AS new, count(*) FILTER (a <> b) AS changed, count(*) FILTER (b IS NULL) AS deleted, true AS passed FROM j""")
def update_drill(spark, sf_dir):
    """The second of two versions built from what changed, and the first made active again."""
    first, then = (x.select(F.col("doc_id").alias("chunk_id"), "text") for x in two_versions(spark, sf_dir))
    return index_build.drill(first, then, new_path(spark))


@query(f"WITH {_OLD}, {_NEW} SELECT count(*) FILTER (o.h = n.h) AS reused, count(*) FILTER (o.h IS NULL OR o.h <> n.h) AS computed FROM n LEFT JOIN o USING (doc_id)")
def vector_reuse(spark, sf_dir):
    a, b = (x.withColumnRenamed("doc_id", "chunk_id") for x in two_versions(spark, sf_dir))
    done = versions.reused(b, a.withColumn("vector", F.array(F.lit(1.0))))
    return done.agg(F.count("vector").alias("reused"), F.count_if(F.col("vector").isNull()).alias("computed"))


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def prev_row(spark, sf_dir):
    return windows.previous(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn").select("conv_id", "turn", "previous")


@query("""SELECT conv_id, turn, CASE WHEN g > 0 THEN first_value(CASE WHEN role <> 'assistant' AND role <> 'system' THEN sha256(text) END) OVER (PARTITION BY conv_id, g ORDER BY turn) END AS chapter
FROM (SELECT *, sum((role <> 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)""")
def carry_forward(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    heading = F.col("role") != "assistant"
    return windows.carried(turns, heading, F.when(F.col("role") != "system", F.sha2("text", 256)), "conv_id", "turn", name="chapter").select("conv_id", "turn", "chapter")


@query("""SELECT event_id, user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run
FROM (SELECT *, (lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 1800)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def runs_by_gap(spark, sf_dir):
    return windows.gap_runs(table(spark, sf_dir, "events"), "ts", 1800, "user_id", "ts", "event_id").select("event_id", "user_id", "run")


@query(r"SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+)\s*=\s*\"([^\"]*)\"', 1) AS names, regexp_extract_all(text, '([A-Za-z]+)\s*=\s*\"([^\"]*)\"', 2) AS texts FROM documents")
def citation_extract(spark, sf_dir):
    found = text.extract_citations(F.col("text"), r'([A-Za-z]+)\s*=\s*"([^"]*)"')
    return docs(spark, sf_dir).withColumn("c", found).select("doc_id", F.transform("c", lambda x: x["law_name"]).alias("names"), F.transform("c", lambda x: x["article_no"]).alias("texts"))


@query("""SELECT o_orderkey, unnest(CASE WHEN lo + 1 <= hi THEN range(lo + 1, hi + 1) ELSE [hi] END) AS no FROM (SELECT o_orderkey, o_orderkey % 10 AS lo, o_orderkey % 10 + o_orderkey % 4 AS hi FROM orders)""")
def range_expand(spark, sf_dir):
    low = F.col("o_orderkey") % 10
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(citations.expanded(low, low + F.col("o_orderkey") % 4)).alias("no"))


@query()
def sentence_split(spark, sf_dir):
    """Sentences of the documents; their Latin marks and vowels are made the ones that the splitter looks for."""
    body = F.translate("text", "aeiou.!?", "長照服務法。！？")
    return sentences.sentences(docs(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), body.alias("text")))


@query()
def pii_redact(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("clean", text.redact_pii(F.col("text")))
    return d.select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), *[F.regexp_count("clean", F.lit(rf"\[{n}\]")).alias(n.lower()) for n in ("EMAIL", "NATIONAL_ID", "PHONE", "ADDRESS")])


# fixed values: patterns of texts that must not be published
POLICY = {"user_path": r"[A-Za-z]:[\\/]+Users\b", "sk_key": r"\bsk-[A-Za-z0-9_-]{20,}", "google_key": r"\bAIza[0-9A-Za-z_-]{30,}", "hf_token": r"\bhf_[A-Za-z0-9]{30,}", "gh_token": r"\bghp_[A-Za-z0-9]{30,}", "trailer": r"(?i)^\s*co-authored-by\s*:"}
_POLICY = ", ".join(f"('{k}', '{v}')" for k, v in (POLICY | {"aws_key": r"AKIA[0-9A-Z]{16}", "hex_token": r"\b[0-9a-f]{40}\b"}).items())


@query(f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), r(rule, pattern) AS (VALUES {_POLICY})
SELECT doc_id, line_no, rule FROM l, r WHERE regexp_matches(line, pattern)""")
def text_policy_scan(spark, sf_dir):
    rules = POLICY | {"aws_key": r"AKIA[0-9A-Z]{16}", "hex_token": r"\b[0-9a-f]{40}\b"}
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in rules.items()]))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.explode(hits).alias("rule"))


@query("""SELECT source AS pcode, coalesce(lang, '') AS chapter, arg_min(doc_id, doc_id)::VARCHAR AS lo, arg_max(doc_id, doc_id)::VARCHAR AS hi, count(*) AS article_count, min(doc_id) AS first_ord FROM documents GROUP BY 1, 2""")
def chapter_catalog(spark, sf_dir):
    return catalog.chapters(docs(spark, sf_dir).select(F.col("source").alias("pcode"), F.col("lang").alias("chapter"), F.col("doc_id").cast("string").alias("article_no"), F.col("doc_id").alias("ord")))


@query("""WITH s AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT stratum, greatest(2, round_even(n * 50 / sum(n) OVER (), 0))::INT AS quota FROM s),
f AS (SELECT *, 50 - sum(quota) OVER () AS rest, row_number() OVER (ORDER BY quota DESC, stratum) AS r FROM q) SELECT stratum, (quota + CASE WHEN r = 1 THEN rest ELSE 0 END)::INT AS quota FROM f""")
def stratified_quota(spark, sf_dir):
    return sampling.quotas(docs(spark, sf_dir).groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("n")), 50)


@query("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50")
def round_robin(spark, sf_dir):
    return sampling.round_robin(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 50)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents GROUP BY text")
def dedup_first_wins(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return windows.first_wins(rows, "text_sha256", "doc_id")


@query("""WITH s AS (SELECT sha256(text) AS h, doc_id % 10 < 7 AS train FROM documents), u AS (SELECT h, bool_or(train) AS a, bool_or(NOT train) AS b FROM s GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS shared_texts, (SELECT count(*) FROM s) AS n_rows, count(*) AS distinct_texts FROM u""")
def split_integrity(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 10 < 7).alias("train"))
    shared = sampling.shared_ids(rows.filter("train"), rows.filter("not train"), "h").agg(F.count(F.lit(1)).alias("shared_texts"))
    return shared.crossJoin(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("distinct_texts")))


@query(r"SELECT item_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS question_hash FROM benchmark")
def question_norm_hash(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.question_hash(F.col("text")).alias("question_hash"))


@query("SELECT p_partkey, p_partkey % 9999 + 1 AS value FROM part")
def cn_numeral(spark, sf_dir):
    """Numbers written in Chinese, read back."""
    n = (F.col("p_partkey") % 9999 + 1).cast("int")
    digit = lambda x: F.substring(F.lit("零一二三四五六七八九"), x + 1, F.lit(1))
    part = lambda of, unit: F.when(F.floor(n / of) % 10 > 0, F.concat(digit((F.floor(n / of) % 10).cast("int")), F.lit(unit))).otherwise(F.when((n > of * 10) & (n % of > 0), "零").otherwise(""))
    numeral = F.concat(part(1000, "千"), part(100, "百"), part(10, "十"), part(1, ""))
    return table(spark, sf_dir, "part").select("p_partkey", text.cn_to_int(numeral).cast("long").alias("value"))


_GAP = "，" + "字" * 25


@query("""WITH a AS (SELECT p_partkey AS no, p_partkey % 3 AS law FROM part), e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
c AS (SELECT p, s, p % 3 AS law, CASE WHEN s % 2 = 0 THEN 2 ELSE p % 3 END AS target FROM e)
SELECT 'L' || c.law || '-' || p AS source, 'L' || target || '-' || s AS target, 'regex' AS provenance FROM c JOIN a ON no = s AND a.law = c.target WHERE NOT (p = s AND c.law = c.target)""")
def citation_edges(spark, sf_dir):
    """Parts as articles of three laws whose text cites suppliers' numbers, every other one in the third law by its name; edges to articles that exist."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    cites = lines.select(F.col("l_partkey").alias("no"), F.col("l_suppkey").alias("s"))
    # each part has a few suppliers
    cited = cites.groupBy("no").agg(F.array_join(F.transform(F.array_sort(F.collect_set("s")), lambda s: F.concat(F.when(s % 2 == 0, "老人福利法").otherwise(""), F.lit("第"), s.cast("string"), F.lit("條"))), _GAP).alias("content"))
    rows = part.select(F.col("p_partkey").alias("no")).join(cited, "no", "left")
    articles = rows.select(F.format_string("L%d-%d", F.col("no") % 3, F.col("no")).alias("article_id"), F.concat(F.lit("L"), F.col("no") % 3).alias("pcode"), F.col("no").cast("string").alias("article_no"), F.col("no").cast("int").alias("ord"), F.coalesce("content", F.lit("")).alias("content"))
    named = spark.createDataFrame([("L0", "甲法"), ("L1", "乙法"), ("L2", "老人福利法")], "pcode string, law_name string")
    return citations.build_graph(articles, named, citations.alias_table(named, "丙法", "丙")).select("source", "target", "provenance")


@query("""WITH a AS (SELECT p_partkey AS no, p_partkey % 3 AS law FROM part), e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
o AS (SELECT p, count(*) AS n FROM e JOIN a ON no = s GROUP BY 1)
SELECT 'L' || law AS pcode, count(*) AS articles, coalesce(sum(n), 0)::BIGINT AS edges_out, count(*) FILTER (n IS NULL AND a.no NOT IN (SELECT s FROM e)) AS isolated FROM a LEFT JOIN o ON p = no GROUP BY 1""")
def graph_metadata(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    articles = part.select(F.col("p_partkey").alias("article_id"), F.concat(F.lit("L"), F.col("p_partkey") % 3).alias("pcode"))
    edges, parts = lines.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")), tasks_for(lines)
    valid = citations.valid_edges(edges, articles.select(F.col("article_id").alias("target")), parts)
    return citations.graph_metadata(articles, valid.distinct())


def packed_laws(spark, sf_dir):
    """A hundred documents of a source as a law, with a chapter before every fifth, in a package of JSON, XML or HTML."""
    law = F.concat(F.translate("source", "-_ ", ""), F.lit("B"), F.floor(F.col("doc_id") / 100).cast("string"))
    d = docs(spark, sf_dir).select(law.alias("law"), "doc_id", F.concat(F.lit("item "), "doc_id", F.lit("\n"), F.md5("text")).alias("body"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "body"))), lambda x: F.struct(x["doc_id"].alias("no"), x["body"].alias("body"), (x["doc_id"] % 5 == 0).alias("opens")))
    packs = d.groupBy("law").agg(each.alias("a")).withColumn("kind", F.element_at(F.array(F.lit("json"), F.lit("xml"), F.lit("html")), (F.pmod(F.crc32("law"), F.lit(3)) + 1).cast("int")))
    chapter = lambda x: F.concat(F.lit("章 "), x["no"].cast("string"))
    number = lambda x: F.concat(F.lit("第 "), x["no"].cast("string"), F.lit(" 條"))
    item = lambda kind, no, content: F.struct(kind.alias("ArticleType"), no.alias("ArticleNo"), content.alias("ArticleContent"))
    listed = F.flatten(F.transform("a", lambda x: F.when(x["opens"], F.array(item(F.lit("C"), F.lit(""), chapter(x)), item(F.lit("A"), number(x), F.replace(x["body"], F.lit("\n"), F.lit("\r\n"))))).otherwise(F.array(item(F.lit("A"), number(x), F.replace(x["body"], F.lit("\n"), F.lit("\r\n")))))))
    as_json = F.to_json(F.struct(F.lit("2026/7/10 0:00").alias("UpdateDate"), F.array(F.struct(F.concat(F.lit("law "), "law").alias("LawName"), F.concat(F.lit("http://x?pcode="), "law").alias("LawURL"), F.lit("20200101").alias("LawModifiedDate"), listed.alias("LawArticles"))).alias("Laws")))
    xml = F.array_join(F.transform("a", lambda x: F.concat(F.when(x["opens"], F.concat(F.lit("<編章節> "), chapter(x), F.lit("</編章節>"))).otherwise(""), F.lit("<條文><條號>"), number(x), F.lit("</條號><條文內容><![CDATA["), x["body"], F.lit("]]></條文內容></條文>"))), "")
    as_xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><LAWS UpdateDate="2026/7/10"><法規><法規名稱>law '), "law", F.lit("</法規名稱><法規網址>http://x?pcode="), "law", F.lit("</法規網址><最新異動日期>20200101</最新異動日期><法規內容>"), xml, F.lit("</法規內容></法規></LAWS>"))
    lines = lambda x: F.concat(F.lit('<div class="line-0000">'), F.replace(x["body"], F.lit("\n"), F.lit('</div><div class="line-0004">')), F.lit("</div>"))
    page = F.array_join(F.transform("a", lambda x: F.concat(F.when(x["opens"], F.concat(F.lit('<div class="h3 char-2"> '), chapter(x), F.lit("</div>"))).otherwise(""), F.lit('<div class="row"><div class="col-no"><a href="?flno='), x["no"].cast("string"), F.lit('">'), number(x), F.lit('</a></div><div class="col-data"><div class="law-article">'), lines(x), F.lit("</div></div></div>"))), "\n")
    as_page = F.concat(F.lit("<title>law "), "law", F.lit("-全國法規資料庫</title><th>修正日期：</th><td>民國 109 年 1 月 1 日</td><div class=\"law-reg-content\">"), page, F.lit("</div>"))
    content = F.when(F.col("kind") == "json", as_json).when(F.col("kind") == "xml", as_xml).otherwise(as_page)
    return packs.select(F.col("kind").alias("format"), F.encode(content, "UTF-8").alias("content"), F.col("law").alias("pcode"), F.lit("2026-07-10").alias("update_date"))


_PACKED = """d AS (SELECT translate(source, '-_ ', '') || 'B' || (doc_id // 100) AS pcode, doc_id, 'item ' || doc_id || chr(13) || chr(10) || md5(text) AS content FROM documents),
c AS (SELECT *, max(CASE WHEN doc_id % 5 = 0 THEN doc_id END) OVER (PARTITION BY pcode ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS opened FROM d)"""


@query(f"""WITH {_PACKED} SELECT pcode, 'law ' || pcode AS law_name, '章 ' || opened AS chapter, doc_id::VARCHAR AS article_no, content, '20200101' AS law_modified_date, '2026-07-10' AS source_update_date, 'now' AS fetched_at FROM c""")
def law_packages(spark, sf_dir):
    """Articles of packages of all three formats."""
    return laws.extract_articles(laws.events(packed_laws(spark, sf_dir)), "now").select("pcode", "law_name", "chapter", "article_no", "content", "law_modified_date", "source_update_date", "fetched_at")


@query(f"""WITH {_PACKED} SELECT pcode, any_value('law ' || pcode) AS law_name, count(*) AS article_count, count(DISTINCT CASE WHEN doc_id % 5 = 0 THEN doc_id END) AS chapter_count, '20200101' AS law_modified_date FROM c GROUP BY 1""")
def law_metadata(spark, sf_dir):
    return laws.law_meta(laws.events(packed_laws(spark, sf_dir))).select("pcode", "law_name", "article_count", "chapter_count", "law_modified_date")
