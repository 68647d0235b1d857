"""Citations between articles: extraction with offsets, resolution of the law meant, the graph and its expansion."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CHAPTER_CITATION, article_no_of, extract_citations, paragraphs
from ..plans.shared import fixed
from .names import Names
from .retrieval import small
from .windows import previous

# fixed values: numerals, an article token, and what stands between the tokens of a run
NUMERAL = "[〇零一二三四五六七八九十百千0-9]+"
TOKEN = re.compile(rf"第({NUMERAL})條(?:之({NUMERAL}))?")
JOINT = re.compile(r"[、及至]{1,2}")
THROUGH, PREVIOUS, WINDOW = "至", "前條", 20
OFFSETS = "array<struct<at: int, end: int, base: string, suffix: string, joint: string>>"


def token_offsets(text: Column) -> Column:
    """Article tokens with their offsets, and the joint to the token before where they are of one run. Offsets aren't to be had from SQL's patterns, so this is an Arrow function."""

    @F.arrow_udf(OFFSETS)
    def scan(texts: pa.Array) -> pa.Array:
        ends, at, to, base, suffix, joint = [0], [], [], [], [], []
        for text in texts.to_pylist():
            end = None
            for m in TOKEN.finditer(text or ""):
                start = m.start()
                gap = text[end:start] if end is not None else ""
                joint.append(gap if JOINT.fullmatch(gap) else None)
                end = m.end()
                at.append(start)
                to.append(end)
                base.append(m[1])
                suffix.append(m[2])
            ends.append(len(at))
        fields = {"at": pa.array(at, pa.int32()), "end": pa.array(to, pa.int32()), "base": pa.array(base, pa.string()), "suffix": pa.array(suffix, pa.string()), "joint": pa.array(joint, pa.string())}
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return scan(text)


def expanded(low: Column, high: Column) -> Column:
    """Numbers from low + 1 to high; just high where the range is empty or falls."""
    return F.when(low + 1 <= high, F.sequence(low + 1, high)).otherwise(F.array(high))


def article_references(articles: DataFrame) -> DataFrame:
    """article_id, pcode, article_no, ord, content, seq, at, no: every article number cited, ranges written out."""
    kept = ["article_id", "pcode", "article_no", "ord", "content"]
    tokens = articles.select(*kept, token_offsets(F.col("content")).alias("tokens"))
    numbers = tokens.withColumn("tokens", F.transform("tokens", lambda t: F.struct(t["at"].alias("at"), t["joint"].alias("joint"), article_no_of(t["base"], t["suffix"]).alias("no"))))
    # the number before is in the same list, so that nothing is moved
    both = F.transform("tokens", lambda t, i: F.struct(t["at"].alias("at"), t["joint"].alias("joint"), t["no"].alias("no"), F.get("tokens", i - 1)["no"].alias("before")))
    named = numbers.select(*kept, F.posexplode(both).alias("seq", "t")).select(*kept, "seq", "t.*")
    low, high = F.col("before").try_cast("int"), F.col("no").try_cast("int")
    ranged = (F.col("joint") == THROUGH) & low.isNotNull() & high.isNotNull()
    numbers = F.when(ranged, expanded(low, high).cast("array<string>")).otherwise(F.array("no"))
    return named.select(*kept, "seq", "at", F.posexplode(numbers).alias("step", "no"))


def alias_table(laws: DataFrame, parent_name: str, marker: str) -> DataFrame:
    """pcode, alias, target: whom a law means by 本法, 本細則 and 本辦法. A law of the parent's family means the parent by the first."""
    name, parent = F.col("law_name"), laws.filter(F.col("law_name") == parent_name).select(F.col("pcode").alias("parent"))
    family = (name != parent_name) & (name.startswith(parent_name) | name.contains(marker))
    own = F.when(name.endswith("施行細則"), "本細則").when(name.endswith("辦法"), "本辦法")
    rows = laws.crossJoin(F.broadcast(parent)).select(
        "pcode", F.explode(F.array_compact(F.array(F.struct(F.lit("本法").alias("alias"), F.when(family, F.col("parent")).otherwise(F.col("pcode")).alias("target")), F.when(family & own.isNotNull(), F.struct(own.alias("alias"), F.col("pcode").alias("target")))))).alias("a"),
    )
    return rows.select("pcode", "a.alias", "a.target")


def resolved(refs: DataFrame, laws: DataFrame, aliases: DataFrame, most: int = 200_000) -> DataFrame:
    """refs with the target law: the full name nearest before the token within the window, the longer one at the same place, else the nearest alias, else the citing law.

    Up to `most` names go to the tasks as one automaton, which finds all of an article's names in one pass; beyond, and for
    the few aliases that a law's own pcode decides on, names are joined to the windows.
    """
    seen = F.substring(F.col("content"), F.greatest(F.col("at") - WINDOW, F.lit(0)) + 1, F.least(F.col("at"), F.lit(WINDOW)))
    ids = ["article_id", "seq", "step"]
    known = laws.select("law_name", "pcode").filter("law_name <> ''")
    if known.limit(most + 1).count() <= most:
        names = Names(refs.sparkSession, {r.law_name: r.pcode for r in known.orderBy("law_name", "pcode").collect()})
        found = refs.withColumn("seen", seen).withColumn("names", names.offsets(F.col("seen")))
        nearest = F.array_max(F.transform("names", lambda x: F.struct(x["start"].alias("start"), (x["end"] - x["start"]).alias("n"), x["code"].alias("code"))))
        keyed = found.withColumn("named", nearest["code"]).drop("names")
    else:
        windows = refs.withColumn("seen", seen)
        met = windows.select(*ids, "seen").join(known.select("law_name", F.col("pcode").alias("code")), F.expr("contains(seen, law_name)"))
        keyed = windows.join(met.groupBy(*ids).agg(F.max_by("code", F.struct(F.expr(_PLACE.format("law_name")), F.length("law_name"), "code")).alias("named")), ids, "left")
    # a law has a few aliases, which go to its references as a list
    of_law = small(aliases.groupBy("pcode").agg(F.collect_list(F.struct("alias", "target")).alias("__aliases")), most)
    nearest = F.expr(f"array_max(transform(filter(__aliases, a -> contains(seen, a.alias)), a -> struct({_PLACE.format('a.alias')} AS place, length(a.alias) AS n, a.target AS target))).target")
    out = keyed.join(of_law, "pcode", "left").withColumn("target_pcode", F.coalesce("named", nearest, "pcode"))
    return out.drop("seen", "named", "__aliases")


#: The last place of a word in the window, found from the reversed texts.
_PLACE = "length(seen) - instr(reverse(seen), reverse({0})) - length({0}) + 2"


def edges_of(articles: DataFrame, laws: DataFrame, aliases: DataFrame) -> DataFrame:
    """source, target, provenance, ord: citations by number and by 前條, without loops, the first of each pair of articles."""
    refs = resolved(article_references(articles), laws, aliases)
    cited = refs.select(F.col("article_id").alias("source"), F.concat_ws("-", "target_pcode", "no").alias("target"), F.struct(F.lit(0).alias("kind"), "seq", "step").alias("ord"))
    # without the texts, which would go through a law's one task
    marked = fixed(articles.select("article_id", "pcode", "article_no", "ord", F.coalesce(F.col("content").contains(PREVIOUS), F.lit(False)).alias("says")))
    both = cited
    if not marked.filter("says").isEmpty():
        before = previous(marked, "article_no", "pcode", "ord", name="prev").filter("says and prev is not null")
        prior = before.select(F.col("article_id").alias("source"), F.concat_ws("-", "pcode", "prev").alias("target"), F.struct(F.lit(1).alias("kind"), F.lit(0).alias("seq"), F.lit(0).alias("step")).alias("ord"))
        both = cited.unionByName(prior)
    both = both.filter("source <> target")
    return both.groupBy("source", "target").agg(F.min("ord").alias("ord")).withColumn("provenance", F.lit("regex"))


def build_graph(articles: DataFrame, laws: DataFrame, aliases: DataFrame, supplement: DataFrame | None = None) -> DataFrame:
    """Edges to articles that exist; a supplement (source, target, ord) counts for articles without any, behind the extracted ones."""
    found = edges_of(articles, laws, aliases)
    if supplement is not None:
        extra = supplement.join(found.select("source").distinct(), "source", "left_anti")
        extra = extra.select("source", "target", F.struct(F.lit(2).alias("kind"), F.col("ord").cast("int").alias("seq"), F.lit(0).alias("step")).alias("ord"), F.lit("llm").alias("provenance"))
        found = found.unionByName(extra.filter("source <> target"))
    return valid_edges(found, articles.select(F.col("article_id").alias("target")))


def valid_edges(edges: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """parts: the number of tasks that edges and nodes are dealt to, if given."""
    if parts:
        edges, nodes = edges.repartition(parts, "target"), nodes.repartition(parts, "target")
    return edges.join(nodes.distinct(), "target", "left_semi")


def expand(hits: DataFrame, edges: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """One step from ranked hits (query_id, item, rank) along edges (source, target, ord): targets that aren't hits and have a text, each by its best hit, `most` a query."""
    steps = hits.select("query_id", F.col("item").alias("source"), "rank").join(edges.select("source", "target", "ord"), "source")
    new = steps.join(hits.select("query_id", F.col("item").alias("target")), ["query_id", "target"], "left_anti").join(texts, "target", "left_semi")
    once = new.groupBy("query_id", "target").agg(F.min(F.struct("rank", "ord", "source")).alias("by"))
    w = Window.partitionBy("query_id").orderBy("by.rank", "by.ord", "target")
    return once.select("query_id", "target", F.col("by.source").alias("via"), F.row_number().over(w).alias("place")).filter(F.col("place") <= most)


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, and nodes that have one."""
    ends = edges.select(F.col("source").alias("n")).unionByName(edges.select(F.col("target").alias("n")))
    return ends.agg(F.count_distinct("n").alias("connected_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def edges_by_provenance(edges: DataFrame) -> DataFrame:
    return edges.groupBy("provenance").agg(F.count(F.lit(1)).alias("edges"))


def graph_metadata(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """pcode, articles, edges_out and isolated of each law: its articles, the edges that leave them, and articles without any edge. articles: article_id, pcode."""
    out = edges.groupBy(F.col("source").alias("article_id")).agg(F.count(F.lit(1)).alias("out"))
    ends = edges.select(F.col("target").alias("article_id")).distinct().withColumn("met", F.lit(True))
    joined = articles.select("article_id", "pcode").join(out, "article_id", "left").join(ends, "article_id", "left")
    return joined.groupBy("pcode").agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum("out"), F.lit(0)).alias("edges_out"), F.count_if(F.col("out").isNull() & F.col("met").isNull()).alias("isolated"))


def verified_paragraphs(answers: DataFrame, chapters: DataFrame) -> DataFrame:
    """answer_id, text and removed: paragraphs that cite a chapter outside of the answer's chapters are left out. chapters: answer_id, law_name, chapter."""
    allowed = chapters.select("answer_id", F.struct("law_name", F.col("chapter").alias("article_no")).alias("c"))
    whole = chapters.select("answer_id", F.struct("law_name", F.lit("全文").alias("article_no")).alias("c"))
    valid = allowed.unionByName(whole).groupBy("answer_id").agg(F.collect_set("c").alias("valid"))
    parts = answers.select("answer_id", paragraphs(F.col("text")).alias("paras")).join(valid, "answer_id", "left")
    none = F.expr("cast(array() as array<struct<law_name: string, article_no: string>>)")
    kept = F.filter("paras", lambda p: F.size(F.array_except(extract_citations(p, CHAPTER_CITATION), F.coalesce("valid", none))) == 0)
    return parts.select("answer_id", F.array_join(kept, "\n").alias("text"), (F.size("paras") - F.size(kept)).alias("removed"))
