"""An inverted index below a path: postings by term range and block of documents, and a search that reads only the blocks it needs.

Documents are numbered in blocks, where they are. A block's lists (places and counts, by term) are made in its task, so what
is dealt out by ranges of terms is a row a term and block. A row also holds the most that the term adds to any score of the
block. A search first sums these bounds; it scores each
question's most promising blocks, and of the others those alone whose bound reaches the question's worst kept score.

An index may have several segments, and documents that later segments replace or take out; see segments.py.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokenize import segmented
from ..plans.shared import fixed, spread
from .retrieval import TOP, Weights, best_of, in_blocks, opened, ranked, share, totals_of

BLOCK = 1024


def inverted(lists: DataFrame, mean: float, size: int = BLOCK) -> DataFrame:
    """A row a term and block (block, term, places, tfs, most), and one without a term a block (block, ids, dls). lists: doc_id, tokens; null tokens are none. most: the largest share at a mean length of `mean`."""
    return of_blocks(in_blocks(lists.select("doc_id", "tokens"), size), mean)


def of_blocks(blocks: DataFrame, mean: float) -> DataFrame:
    """inverted of a forward index's blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in opened(batches, "ids", "dls", "words", "ends", "places", "tfs"):
            yield _block(*block, number, mean)
            number += 1

    return blocks.mapInArrow(run, f"block long, term string, places array<int>, tfs array<int>, most double, ids {dict(blocks.dtypes)['ids']}, dls array<int>")


def _block(ids: pa.Array, dls: np.ndarray, words: pa.Array, ends: np.ndarray, places: np.ndarray, tfs: np.ndarray, number: int, mean: float) -> pa.RecordBatch:
    n, starts = len(ids), np.append(0, ends).astype(np.int32)
    lists = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(starts), pa.array(values, pa.int32())), pa.nulls(1, pa.list_(pa.int32()))])
    most = np.maximum.reduceat(share(tfs.astype(float), dls[places], mean), starts[:-1]).tolist() if len(words) else []
    alone = lambda values: pa.concat_arrays([pa.nulls(len(words), pa.list_(values.type)), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)])
    columns = {
        "block": pa.array(np.full(len(words) + 1, number), pa.int64()), "term": pa.concat_arrays([words, pa.nulls(1, words.type)]),
        "places": lists(places), "tfs": lists(tfs), "most": pa.array([*most, None], pa.float64()),
        "ids": alone(ids), "dls": alone(pa.array(dls, pa.int32())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def write(lists: DataFrame, path: str, size: int = BLOCK, parts: int | None = None) -> None:
    """Writes lists' (doc_id, tokens) postings, blocks and terms below path, and which terms each file of postings begins and ends with. parts: the number of files, a million rows each or one a shuffle partition if not given."""
    spark = lists.sparkSession
    blocks = in_blocks(lists.select("doc_id", "tokens"), size)
    mean = totals_of(blocks).first().avgdl or 1.0
    made = fixed(of_blocks(blocks, mean))
    rows = made.filter("term is not null").drop("ids", "dls")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 1_000_000))
    out = lambda df, name: df.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(f"{path}/{name}")
    out(rows.repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block"), "postings")
    out(made.filter("term is null").select("block", "ids", "dls", F.lit(mean).alias("mean")), "blocks")
    done = spark.read.parquet(f"{path}/postings")
    # the lists' lengths alone are read for the number of documents that hold a term
    out(done.groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df")).repartitionByRange("term").sortWithinPartitions("term"), "terms")
    # a file's rows are sorted, so its first and last one tell; minima of strings would sort all rows of a task again
    place = done.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "term")
    ends = F.broadcast(place.groupBy("file").agg(F.max("at").alias("end")))
    edges = place.join(ends, "file").filter("at = 0 or at = end")
    out(edges.groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1), "files")


@dataclass
class Segment:
    """What is written below a path. gone: doc_id of the documents that later segments take out of this one."""

    path: str
    gone: DataFrame | None = None


@dataclass
class Postings:
    """An index of one or more segments. less: term and df of what has gone, n_gone and length_gone its documents and their words."""

    spark: SparkSession
    segments: list[Segment]
    tokens: Callable[[Column], Column] = segmented
    less: DataFrame | None = None
    n_gone: int = 0
    length_gone: int = 0
    size: int = field(default=BLOCK)

    def table(self, name: str) -> DataFrame:
        """A table of all segments, with the segment's number."""
        every = [self.spark.read.parquet(f"{s.path}/{name}").withColumn("segment", F.lit(k)) for k, s in enumerate(self.segments)]
        return functools.reduce(DataFrame.unionByName, every)

    @property
    def kind(self) -> str:
        """The type of doc_id."""
        return dict(self.table("blocks").dtypes)["ids"].removeprefix("array<").removesuffix(">")

    @functools.cached_property
    def n_blocks(self) -> int:
        return self.table("blocks").count()

    @functools.cached_property
    def means(self) -> list[float]:
        """The mean length that each segment's bounds were made with."""
        found = {r.segment: r.mean for r in self.table("blocks").select("segment", "mean").distinct().collect()}
        return [found.get(k, 1.0) for k in range(len(self.segments))]

    @functools.cached_property
    def totals(self) -> tuple[float, float]:
        """The number of documents and their mean length."""
        lengths = F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x)
        n, words = self.table("blocks").agg(F.coalesce(F.sum(F.size("dls")), F.lit(0)), F.coalesce(F.sum(lengths), F.lit(0))).first()
        n, words = n - self.n_gone, words - self.length_gone
        return float(n), words / n if n else 0.0

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term and df of the wanted terms (a column term) that any document holds."""
        found = self.table("terms").select("term", "df")
        if self.less is not None:
            found = found.unionByName(self.less.select("term", (-F.col("df")).alias("df")))
        return found.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def files_of(self, terms: DataFrame) -> list[list[str]]:
        """Of each segment, the files of postings that may hold a wanted term: a name for each, of as many as the terms' ranges touch."""
        wanted = terms.select("term").distinct()
        met = self.table("files").join(wanted, (F.col("first") <= F.col("term")) & (F.col("term") <= F.col("last")), "left_semi")
        out: list[list[str]] = [[] for _ in self.segments]
        for r in met.select("segment", "file").collect():
            out[r.segment].append(r.file)
        return out

    def lists_of(self, terms: DataFrame) -> DataFrame:
        """The rows of postings of the wanted terms, from the files that hold them."""
        kind = self.spark.read.parquet(f"{self.segments[0].path}/postings").schema
        every = [self.spark.read.schema(kind).parquet(*files).withColumn("segment", F.lit(k)) for k, files in enumerate(self.files_of(terms)) if files]
        if not every:
            return self.spark.createDataFrame([], kind).withColumn("segment", F.lit(0))
        return functools.reduce(DataFrame.unionByName, every).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[Column], Column] = segmented, size: int = BLOCK, parts: int | None = None) -> Postings:
    """Writes an index of docs and opens it. Rows that repeat an id are documents each; null texts are documents without words."""
    write(spread(docs).select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens")), path, size, parts)
    return Postings(docs.sparkSession, [Segment(path)], tokens, size=size)


def search(index: Postings, questions: DataFrame, id_col: str = "query_id", text_col: str = "text", top: int = TOP, ahead: int = 16, most_bytes: int = 32 << 20, seen: list | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the best documents with a term in common, as retrieval.bm25 has them, by their BM25.

    Questions are weighed and sent in blocks of about most_bytes. `ahead` blocks of documents a question are scored first, the
    ones with the highest bounds, which are all where there are no more; what these leave below the question's worst kept score isn't read. seen, if given, gets
    the numbers of (question, block) pairs that hold a term and that were scored.
    """
    spark = index.spark
    asked = questions.select(F.col(id_col).alias("query_id"), F.explode(index.tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = fixed(asked)
    n, mean = index.totals
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = fixed(asked.join(index.frequencies(asked), "term").select("query_id", "term", (F.col("qtf") * idf).alias("w")))
    size = weighed.agg(F.coalesce(F.sum(F.length("term") + 80), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // most_bytes)), None
    for i in range(blocks):
        part = weighed if blocks == 1 else weighed.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        if part.isEmpty():
            continue
        found = fixed(_searched(index, spark, part, mean or 1.0, top, ahead, seen))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id {dict(weighed.dtypes)['query_id']}, doc_id {index.kind}, score double, rank int")


def _searched(index: Postings, spark: SparkSession, weighed: DataFrame, mean: float, top: int, ahead: int, seen: list | None) -> DataFrame:
    rows = index.lists_of(weighed)
    sent = spark.sparkContext.broadcast(Weights([(r.query_id, r.term, r.w) for r in weighed.collect()]))  # a block of questions
    if index.n_blocks <= ahead:
        return _scored(index, rows, None, sent, mean, top)
    # a share grows with the mean length, in proportion at most
    grown = functools.reduce(lambda c, x: c.when(F.col("segment") == x[0], F.lit(max(1.0, mean / x[1]))), enumerate(index.means), F)
    bounds = rows.select("segment", "block", "term", (F.col("most") * grown).alias("most")).join(F.broadcast(weighed), "term").groupBy("query_id", "segment", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
    bounds = fixed(bounds.withColumn("place", F.row_number().over(order)))
    first = fixed(_scored(index, rows, bounds.filter(F.col("place") <= ahead), sent, mean, top))
    worst = first.filter(F.col("rank") == top).select("query_id", F.col("score").alias("worst"))
    # scores are rounded to six places
    rest = bounds.filter(F.col("place") > ahead).join(worst, "query_id", "left").filter("worst is null or bound >= worst - 0.000001")
    rest = fixed(rest.select("query_id", "segment", "block"))
    if seen is not None:
        seen.append((bounds.count(), bounds.filter(F.col("place") <= ahead).count() + rest.count()))
    if rest.isEmpty():
        return first
    return ranked(first.drop("rank").unionByName(_scored(index, rows, rest, sent, mean, top).drop("rank")), top)


def _scored(index: Postings, rows: DataFrame, pairs: DataFrame | None, sent, mean: float, top: int) -> DataFrame:
    """The best of each question over the (query_id, segment, block) pairs, or over all. A block's lists meet in one task: at most its documents for each of the questions' terms."""
    blocks, lists = index.table("blocks"), rows.select("segment", "block", "term", "places", "tfs")
    kinds = {"query_id": "string" if isinstance(sent.value.ids[0], str) else "long", "doc_id": index.kind}
    if pairs is None:
        blocks = blocks.withColumn("queries", F.lit(None).cast(f"array<{kinds['query_id']}>"))
    else:
        wanted = pairs.groupBy("segment", "block").agg(F.collect_list("query_id").alias("queries"))
        blocks = blocks.join(wanted, ["segment", "block"])
        lists = lists.join(wanted.select("segment", "block"), ["segment", "block"], "left_semi")
    gone = [s.gone.select("doc_id", F.lit(k).alias("segment")) for k, s in enumerate(index.segments) if s.gone is not None]
    if gone:
        dead = blocks.select("segment", "block", F.posexplode("ids").alias("at", "doc_id")).join(functools.reduce(DataFrame.unionByName, gone), ["doc_id", "segment"], "left_semi")
        blocks = blocks.join(dead.groupBy("segment", "block").agg(F.collect_list("at").alias("dead")), ["segment", "block"], "left")
    else:
        blocks = blocks.withColumn("dead", F.lit(None).cast("array<int>"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, head = sent.value, right.slice(0, 1)
        names, dls, dead = head["ids"][0].values, head["dls"][0].values.to_numpy().astype(float), head["dead"][0].as_py() or []
        queries = head["queries"][0].as_py()
        rows = None
        if queries is not None:
            place = {q: k for k, q in enumerate(queries)}
            rows = np.array([place.get(q, -1) for q in asked.ids])
        held = np.zeros((len(asked.ids if queries is None else queries), len(dls)))
        for term, places, tfs in zip(left["term"].to_pylist(), left["places"].combine_chunks(), left["tfs"].combine_chunks()):
            docs = places.values.to_numpy()
            asked.add(held, term, docs, share(tfs.values.to_numpy().astype(float), dls[docs], mean), rows)
        held[:, dead] = 0
        return pa.Table.from_batches([best_of(np.round(held, 6), asked.ids if queries is None else queries, names, top, lambda got: got > 0)])

    met = lists.groupBy("segment", "block").cogroup(blocks.groupBy("segment", "block"))
    return ranked(met.applyInArrow(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"), top)

