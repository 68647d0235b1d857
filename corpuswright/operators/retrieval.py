"""Hybrid ranked retrieval over batches of questions: BM25, dense similarity, rank fusion, reranking and diagnostics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sigmoid
from ..functions.tokenize import segmented
from ..plans.shared import fixed, lean, spread, together

TOP, POOL, FINAL, RRF_K = 20, 20, 5, 60
K1, B = 1.5, 0.75
Embedder = Callable[[DataFrame], DataFrame]


@dataclass
class Index:
    """The forward index: a row a block of documents (ids, dls, words, ends, places, tfs), written once, and the corpus's size and mean length as one row. lists: doc_id, tokens (in no order) and dl of each document, taken from the blocks."""

    lists: DataFrame
    totals: DataFrame
    tokens: Callable[[Column], Column]
    blocks: DataFrame


#: Documents and words that a block holds at most; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_WORDS = 1024, 1 << 19


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[Column], Column] = segmented) -> Index:
    lists = spread(docs).select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))
    blocks = in_blocks(lists)
    return Index(blocks.mapInArrow(_unblocked, f"doc_id {dict(lists.dtypes)['doc_id']}, tokens array<string>, dl int"), totals_of(blocks), tokens, blocks)


def _unblocked(batches) -> Iterator[pa.RecordBatch]:
    for ids, dls, words, ends, places, tfs in opened(batches, "ids", "dls", "words", "ends", "places", "tfs"):
        said = np.repeat(np.repeat(np.arange(len(words)), np.diff(ends, prepend=0)), tfs)
        order = np.argsort(np.repeat(places, tfs), kind="stable")
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(dls)), pa.int32()), words.take(pa.array(said[order], pa.int64())))
        yield pa.RecordBatch.from_arrays([ids, tokens, pa.array(dls, pa.int32())], ["doc_id", "tokens", "dl"])


def in_blocks(lists: DataFrame, docs: int = BLOCK_DOCS) -> DataFrame:
    """lists (doc_id, tokens) as blocks, written once."""
    lean(lists.sparkSession)
    kind = dict(lists.dtypes)["doc_id"]
    return fixed(lists.mapInArrow(partial(_blocks, docs=docs), f"ids array<{kind}>, dls array<int>, words array<string>, ends array<int>, places array<int>, tfs array<int>"))


def totals_of(blocks: DataFrame) -> DataFrame:
    n, length = F.sum(F.size("ids")), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x))
    return blocks.agg(F.coalesce(n, F.lit(0)).cast("double").alias("n"), F.try_divide(length.cast("double"), n.cast("double")).alias("avgdl"))


def _blocks(batches, docs: int = BLOCK_DOCS) -> Iterator[pa.RecordBatch]:
    """Blocks of lists (doc_id, tokens): each word once, and where its documents' places and counts end. Rows that don't fill a block wait for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        held = [*rest, *([] if batch is None else [batch])]
        if not held:
            return
        whole, at = pa.concat_batches(held), 0
        sizes = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy()))
        while at < whole.num_rows:
            end = min(at + docs, whole.num_rows, max(at + 1, int(np.searchsorted(sizes, sizes[at] + BLOCK_WORDS, "right")) - 1))
            if end == whole.num_rows and batch is not None:
                break
            part, at = whole.slice(at, end - at), end
            rows, words, names = numbered(part.column(1))
            n = part.num_rows
            cells, tfs = np.unique(words.astype(np.int64) * n + rows, return_counts=True)
            ends = np.searchsorted(cells // n, np.arange(len(names)), "right")
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            ints = lambda values: one(pa.array(values, pa.int32()))
            columns = {"ids": one(part.column(0)), "dls": ints(np.bincount(rows, minlength=n)), "words": one(names), "ends": ints(ends), "places": ints(cells % n), "tfs": ints(tfs)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        rest = [whole.slice(at)]


def opened(batches, *names: str) -> Iterator[tuple]:
    """The named columns of each block: words and ids as Arrow's arrays, numbers as numpy's."""
    for batch in batches:
        for i in range(batch.num_rows):
            found = [batch.column(name)[i].values for name in names]
            yield tuple(x if name in ("words", "ids") else x.to_numpy() for name, x in zip(names, found))


def small(rows: DataFrame, most: int) -> DataFrame:
    """rows marked for broadcast if there are at most `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def bm25(index: Index, questions: DataFrame, id_col: str = "query_id", text_col: str = "text", top: int = TOP, most_bytes: int = 32 << 20) -> DataFrame:
    """query_id, doc_id, score, rank: the best documents with a term in common. idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Documents stay where they are. Questions are broadcast in blocks of about most_bytes. Their terms are counted over the
    documents' blocks, of which words and ends alone are read; then a task takes each of these terms that a block holds, adds its
    part to the scores of the questions that have it, and keeps its best `top` of each question.
    """
    asked = questions.select(F.col(id_col).alias("query_id"), F.explode(index.tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = fixed(asked)
    total = index.totals.first()
    size = asked.agg(F.coalesce(F.sum(F.length("term") + 80), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most_bytes))
    sc, doc_kind = index.blocks.sparkSession.sparkContext, dict(index.blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    out = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = block.collect()  # about most_bytes
        terms = sorted({r.term for r in rows})
        counts = index.blocks.select("words", "ends").mapInArrow(_counted(sc.broadcast(terms)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        idf = {terms[r.term]: float(np.log(1 + (total.n - r.df + 0.5) / (r.df + 0.5))) for r in counts.collect()}  # no more than rows
        sent = sc.broadcast(Weights([(q, t, qtf * idf[t]) for q, t, qtf in rows if t in idf]))
        part = ranked(index.blocks.mapInArrow(_scored(sent, total, top), f"query_id {dict(asked.dtypes)['query_id']}, doc_id {doc_kind}, score double"), top)
        out = part if out is None else out.unionByName(part)
    return out


def _counted(sent):
    """The number of a term in the list that was sent, and of the task's documents that hold it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.string())
        found = np.zeros(len(wanted), np.int64)
        for words, ends in opened(batches, "words", "ends"):
            at = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy()
            found[at[at >= 0]] += np.diff(ends, prepend=0)[at >= 0]  # a block has a word once
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(found[held])], ["term", "df"])

    return run


def share(tf, dl, mean: float):
    """What a term's count adds to a score, without the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


class Weights:
    """A block of questions as tasks get it: the questions, and for each term the places and weights of those that have it."""

    def __init__(self, rows: list[tuple]):
        """rows: query_id, term and weight."""
        self.ids = sorted({q for q, _, _ in rows})
        place, found = {q: k for k, q in enumerate(self.ids)}, {}
        for query, term, weight in sorted(rows):
            found.setdefault(term, []).append((place[query], weight))
        self.terms = {t: (np.array([p for p, _ in x]), np.array([w for _, w in x])) for t, x in found.items()}

    def add(self, held: np.ndarray, term: str, docs: np.ndarray, parts: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Adds a term's parts at its documents to the scores (a row a question) of the questions that have the term. rows: each question's row, or -1 without one."""
        at, weights = self.terms[term]
        if rows is not None:
            at = rows[at]
            weights, at = weights[at >= 0], at[at >= 0]
        for r, w in zip(at.tolist(), weights.tolist()):
            held[r, docs] += w * parts


def _scored(sent, total, top: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        mean, ids, wanted = total.avgdl or 1, asked.ids, pa.array(list(asked.terms), pa.string())
        step = max(64, 2_000_000 // max(1, len(ids)))
        for names, dls, words, ends, places, tfs in opened(batches, "ids", "dls", "words", "ends", "places", "tfs"):
            if not ids:
                continue
            known = np.flatnonzero(pc.is_in(words, value_set=wanted).to_numpy(zero_copy_only=False))  # no question has the other words
            sizes = np.diff(ends, prepend=0)[known]
            which = np.repeat(np.arange(len(known)), sizes)
            cells = np.arange(len(which)) + (ends[known] - np.cumsum(sizes))[which]
            docs = places[cells]
            parts, known = share(tfs[cells].astype(float), dls[docs].astype(float), mean), words.take(pa.array(known)).to_pylist()
            for at in range(0, len(names), step):
                here = (docs >= at) & (docs < at + step)
                mine, its, held = docs[here] - at, parts[here], np.zeros((len(ids), min(step, len(names) - at)))
                edges = np.searchsorted(which[here], np.arange(len(known)), "right")
                for word, a, b in zip(known, [0, *edges], edges):
                    asked.add(held, word, mine[a:b], its[a:b])
                yield best_of(np.round(held, 6), ids, names.slice(at, step), top, lambda got: got > 0)

    return run


def numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists of strings: the row and the word's number of each string, and the words by number."""
    if not len(lists):
        return np.zeros(0, int), np.zeros(0, int), pa.array([], pa.string())
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
    flat = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), sizes), flat.indices.to_numpy(), flat.dictionary


def coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As numbered, with the words as a list."""
    rows, words, names = numbered(lists)
    return rows, words, names.to_pylist()


def best_of(scores: np.ndarray, queries: list, docs: pa.Array, top: int, fine) -> pa.RecordBatch:
    """query_id, doc_id and score of the `top` best documents of each query (a row of scores) that are fine; ties go to the smaller id."""
    names, found = docs.to_pylist(), []
    for query, got in zip(queries, scores):
        at = np.flatnonzero(fine(got))
        if len(at) > top:
            at = at[got[at] >= np.partition(got[at], len(at) - top)[len(at) - top]]
        found += [(query, d, float(-s)) for s, d in sorted((-got[j], names[j]) for j in at.tolist())[:top]]
    kinds = (_kind(queries), docs.type, pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["query_id", "doc_id", "score"])


def ranked(scored: DataFrame, top: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The best `top` of each query with a rank from 1; ties go to the smaller id. Spark limits each group before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    """In doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def truncated(v: Column, dim: int) -> Column:
    """The first dim places, of unit length again."""
    cut = F.slice(v, 1, dim)
    return F.transform(cut, lambda x: x.cast("double") / F.sqrt(dot(cut, cut)))


def lengths_of(corpus: np.ndarray) -> np.ndarray:
    return np.sqrt((corpus * corpus).sum(axis=1))


def similarities(corpus: np.ndarray, query: np.ndarray, score: str, lengths: np.ndarray | None = None) -> np.ndarray:
    """lengths: of the corpus' vectors, if they are known."""
    if score == "l1":
        return -np.abs(corpus - query).sum(axis=1)
    found = corpus @ query
    if score == "dot":
        return found
    sizes = (lengths_of(corpus) if lengths is None else lengths) * np.sqrt((query * query).sum())
    return np.divide(found, sizes, out=np.full(len(found), np.nan), where=sizes > 0)


def dense(corpus: DataFrame, queries: DataFrame, score: str = "cosine", dim: int | None = None, top: int = TOP, skip_self: bool = False, most_bytes: int = 32 << 20) -> DataFrame:
    """query_id, doc_id, score, rank by exact comparison of every query with every document. corpus: doc_id, vector; queries: query_id, qvector.

    score: cosine, dot or l1 (negative distance), over the first dim places if given. A pair without a score (a null vector,
    a cosine with a vector of zeros) is no hit. skip_self leaves out the document with the query's id, for searches of a
    corpus in itself. Queries are broadcast in blocks of at most most_bytes, whatever their number; the corpus is never
    moved: a task compares a batch with a block by matrix products and keeps its best `top` of each query, ties at the
    border included as far as their ids decide.
    """
    queries = queries.filter("qvector is not null").select("query_id", F.col("qvector").cast("array<double>"))
    size = queries.agg(F.coalesce(F.sum(F.size("qvector") * 8 + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most_bytes))
    kinds = {**dict(queries.dtypes), **dict(corpus.dtypes)}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
    corpus, out = corpus.filter("vector is not null").select("doc_id", F.col("vector").cast("array<double>")), None
    for i in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = block.collect()  # below most_bytes, or about that
        sent = corpus.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [np.array(r[1][:dim]) for r in rows]))
        part = ranked(corpus.mapInArrow(_nearest(sent, score, dim, top, skip_self), schema), top)
        out = part if out is None else out.unionByName(part)
    return out


#: Scores that a task holds at once.
CELLS = 1 << 19


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows. A null component is no number."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1)


def _nearest(sent, score: str, dim: int | None, top: int, skip_self: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if not vectors or not batch.num_rows:
                    continue
                matrix = matrix_of(batch.column(1))[:, :dim]
                lengths = lengths_of(matrix)
                place = {d: k for k, d in enumerate(batch.column(0).to_pylist())} if skip_self else {}
                for first in range(0, len(ids), CELLS // 4096):  # scores of a few queries at a time
                    asked = ids[first : first + CELLS // 4096]
                    got = np.round(np.array([similarities(matrix, v, score, lengths) for v in vectors[first : first + len(asked)]]), 6) + 0.0
                    for i, query in enumerate(asked):
                        if query in place:
                            got[i, place[query]] = np.nan
                    yield best_of(got, asked, batch.column(0), top, lambda x: ~np.isnan(x))

    return run


def _kind(ids: list) -> pa.DataType:
    return pa.string() if ids and isinstance(ids[0], str) else pa.int64()


class _Hashed:
    """Hashed places and signs of a task's words, kept up to a bound."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}  # twice the place, and one more for a minus

    def _place(self, word: str) -> int:
        h = hashlib.md5(word.encode()).digest()
        if len(self.known) >= 400_000:
            self.known.clear()
        self.known[word] = out = int.from_bytes(h[:4]) % self.dim * 2 + h[7] % 2
        return out

    def vectors(self, ids: pa.Array, names: pa.Array, words: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """chunk_id and vector of rows that hold the named words (by number) so many times."""
        n, dim, get = len(ids), self.dim, self.known.get
        hashed = np.array([h if (h := get(w)) is not None else self._place(w) for w in names.to_pylist()], int)
        places, signs = hashed // 2, 1.0 - 2 * (hashed % 2)
        flat = np.bincount(rows * dim + places[words], signs[words] * counts, n * dim) if len(words) else np.zeros(n * dim)
        out = flat.reshape(-1, dim)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out = np.divide(out, length, out=out, where=length > 0)
        made = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(out.reshape(-1)))
        return pa.RecordBatch.from_arrays([ids, made], ["chunk_id", "vector"])


def with_vectors(rows: DataFrame, dim: int = 64, tokens: Callable[[Column], Column] = segmented) -> DataFrame:
    """rows (text and others) with their hashed vector, made where they are."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed(dim)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                *kept, lists = batch.columns
                rows_, words, names = numbered(lists)
                made = hashed.vectors(kept[0], names, words, rows_, np.ones(len(words))).column(1)
                yield pa.RecordBatch.from_arrays([*kept, made], [*batch.schema.names[:-1], "vector"])

    return rows.withColumn("__tokens", tokens(F.coalesce("text", F.lit("")))).mapInArrow(run, ", ".join(f"`{n}` {kind}" for n, kind in [*rows.dtypes, ("vector", "array<double>")]))


def indexed_vectors(index: Index, dim: int = 64) -> DataFrame:
    """hashed_vectors of an index's documents, from its blocks: a word is hashed once a block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed(dim)
        for ids, words, ends, places, tfs in opened(batches, "ids", "words", "ends", "places", "tfs"):
            yield hashed.vectors(ids, words, np.repeat(np.arange(len(words)), np.diff(ends, prepend=0)), places.astype(np.int64), tfs)

    kind = dict(index.blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return index.blocks.select("ids", "words", "ends", "places", "tfs").mapInArrow(run, f"chunk_id {kind}, vector array<double>")


def hashed_vectors(rows: DataFrame, dim: int = 64, tokens: Callable[[Column], Column] = segmented) -> DataFrame:
    """chunk_id and vector: the default embedder in place of a model, signed counts of words hashed by MD5 to `dim` places, of unit length; zeros without words. rows: chunk_id, text, or tokens where they are made already.

    As a model would, it runs on Arrow batches, a row at a time and without a shuffle.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed(dim)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows_, words, names = numbered(batch.column(1))
                yield hashed.vectors(batch.column(0), names, words, rows_, np.ones(len(words)))

    picked = rows.select("chunk_id", "tokens" if "tokens" in rows.columns else tokens(F.col("text")).alias("tokens"))
    return picked.mapInArrow(run, f"chunk_id {dict(rows.dtypes)['chunk_id']}, vector array<double>")


def embedded(rows: DataFrame, embed: Embedder, id_col: str, name: str) -> DataFrame:
    """id_col and the embedder's vector of text, as `name`."""
    return embed(rows.select(F.col(id_col).alias("chunk_id"), "text")).toDF(id_col, name)


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fusion of ranked lists (query_id, list, doc_id, rank; list is its number). score, sources and fused_rank; ties go to the first by list and rank.

    Reciprocal ranks are summed as decimals and rounded, so that no order of summing changes a tie.
    """
    share = (F.lit(1).cast("decimal(10,0)") / (F.col("rank") + k).cast("decimal(10,0)")).cast("decimal(30,20)")
    first = F.min(F.struct("list", "rank"))
    fused = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(share).cast("double"), 12).alias("exact"), first.alias("first"), F.array_sort(F.collect_set("list")).alias("lists"))
    w = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.col("first.list"), F.col("first.rank"))
    return fused.select("query_id", "doc_id", F.round("exact", 9).alias("rrf_score"), "lists", F.row_number().over(w).alias("fused_rank"))


def best_per_source(lists: DataFrame, source: str) -> DataFrame:
    """A document's highest score in one kind of list, with the rank it had there; of equal scores the first list's."""
    best = F.max_by("rank", F.struct("score", -F.col("list")))
    return lists.groupBy("query_id", "doc_id").agg(F.max("score").alias(f"{source}_score"), best.alias(f"{source}_rank"))


def overlap_score(question: Column, text: Column) -> Column:
    """The default scorer in place of a model: the share of a question's distinct words that a text holds, as a logit."""
    pair = F.array(F.struct(F.array_distinct(segmented(question)).alias("asked"), segmented(text).alias("words")))
    share = F.transform(pair, lambda p: F.try_divide(F.size(F.array_intersect(p["asked"], p["words"])).cast("double"), F.size(p["asked"]).cast("double")))
    return F.coalesce(share[0], F.lit(0.0)) * 4 - 2


def rerank(fused: DataFrame, texts: DataFrame, questions: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, pool: int = POOL, top: int = FINAL) -> DataFrame:
    """The pool's documents by the scorer's logistic score. Texts join here, behind the pool's limit."""
    cut = small(fused.filter(F.col("fused_rank") <= pool), 100_000)  # so that texts stay where they are
    full = cut.join(texts.select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    # in a column of its own, as the logistic function names it several times
    scored = full.withColumn("__raw", scorer(F.col("question"), F.col("doc_text"))).withColumn("rerank_score", F.round(sigmoid(F.col("__raw")), 9)).drop("__raw")
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("question")


def diagnostics(lexical: DataFrame, dense_hits: DataFrame, final: DataFrame, score: str = "rerank_score") -> DataFrame:
    """Per query: candidate ids of both kinds, their overlap and its Jaccard share (0 without candidates), and the margin between the best two."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias(name))
    top2 = final.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("s2"))
    both = ids(lexical, "x").join(ids(dense_hits, "y"), "query_id", "full_outer").join(top2, "query_id", "left")
    none = F.expr("cast(array() as array<bigint>)")
    x, y = F.coalesce(F.col("x").cast("array<bigint>"), none), F.coalesce(F.col("y").cast("array<bigint>"), none)
    same = F.array_sort(F.array_intersect(x, y))
    whole = F.size(F.array_union(x, y))
    jaccard = F.when(whole == 0, 0.0).otherwise(F.size(same) / whole)
    return both.select("query_id", x.alias("bm25_ids"), y.alias("dense_ids"), same.alias("overlap_ids"), F.size(same).cast("long").alias("overlap_count"), F.round(jaccard, 6).alias("overlap_jaccard"), F.round(F.col("s1") - F.col("s2"), 6).alias("top1_top2_margin"))


@dataclass
class Retriever:
    """An index and vectors over the same documents (doc_id, text), with what embeds questions: the documents' embedder, or one of their own."""

    docs: DataFrame
    index: Index
    vectors: DataFrame
    embed: Embedder
    embed_question: Embedder | None = None

    @staticmethod
    def of(docs: DataFrame, embed: Embedder = hashed_vectors, tokens: Callable[[Column], Column] = segmented, embed_question: Embedder | None = None) -> Retriever:
        docs = docs.select("doc_id", "text")
        index = build_index(docs, tokens=tokens)
        if embed is hashed_vectors:  # it reads the words that the index has, and questions have the same words
            asks = embed if tokens is segmented else partial(hashed_vectors, tokens=tokens)
            return Retriever(docs, index, fixed(indexed_vectors(index).toDF("doc_id", "vector")), asks, embed_question)
        vectors = embedded(docs, embed, "doc_id", "vector")
        return Retriever(docs, index, fixed(vectors), embed, embed_question)


@dataclass
class Found:
    """lists (query_id, list, doc_id, score, rank) of both kinds, even numbers lexical and odd ones dense, and their fusion."""

    lists: DataFrame
    fused: DataFrame

    @property
    def lexical(self) -> DataFrame:
        return self.lists.filter("list % 2 = 0")

    @property
    def dense(self) -> DataFrame:
        return self.lists.filter("list % 2 = 1")


def variants(queries: DataFrame) -> DataFrame:
    """query_id, place (from 0) and text of a question's queries: stripped, empty ones left out, repeats left out behind the first. queries: query_id, ord, text."""
    bare = queries.select("query_id", "ord", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text")).filter("text <> ''")
    once = bare.groupBy("query_id", "text").agg(F.min("ord").alias("ord"))
    return once.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("ord")) - 1).alias("place"), "text")


def retrieve_multi(retriever: Retriever, queries: DataFrame, top: int = TOP) -> Found:
    """Lexical and dense lists of each of a question's queries, all fused by reciprocal rank. queries: query_id, ord, text.

    A document keeps its best score of each kind, with the rank it had there. What is kept is a few rows a question. A text is
    searched once, whichever questions ask it.
    """
    asked = fixed(variants(queries).withColumn("asked", F.xxhash64("text")))
    texts = asked.select("asked", "text").dropDuplicates(["asked"])
    vectors = embedded(texts, retriever.embed_question or retriever.embed, "asked", "qvector").withColumnRenamed("asked", "query_id")
    lexical, near = together(
        lambda: fixed(bm25(retriever.index, texts.select(F.col("asked").alias("query_id"), "text"), top=top)),
        lambda: fixed(dense(retriever.vectors, vectors, top=top)),
    )
    named = lambda rows, odd: rows.withColumnRenamed("query_id", "asked").join(asked.select("asked", "query_id", "place"), "asked").select("query_id", (F.col("place") * 2 + odd).alias("list"), "doc_id", "score", "rank")
    lists = named(lexical, 0).unionByName(named(near, 1))
    fused = rrf(lists)
    for kind, odd in (("bm25", 0), ("dense", 1)):
        fused = fused.join(best_per_source(lists.filter(f"list % 2 = {odd}"), kind), ["query_id", "doc_id"], "left")
    return Found(lists, fixed(fused))


def retrieve(retriever: Retriever, questions: DataFrame, top: int = TOP) -> Found:
    """One query a question. questions: query_id, text."""
    return retrieve_multi(retriever, questions.select("query_id", F.lit(0).alias("ord"), "text"), top)


def hybrid(docs: DataFrame, questions: DataFrame, embed: Embedder = hashed_vectors, top: int = TOP) -> DataFrame:
    """The fused list of BM25's and the dense list."""
    return retrieve(Retriever.of(docs, embed), questions, top).fused


#: White space, of whose bytes no other character of UTF-8 has any.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Anchors:
    """Items by the bytes from their second word on, up to 32: keys by their number of bytes, and each key's items."""

    def __init__(self, items: list[tuple[str, str]]):
        """items: id and text, of three words or more."""
        self.items, found = [(i, t.encode()) for i, t in items], {}
        for k, (_, data) in enumerate(self.items):
            raw = np.frombuffer(data, np.uint8)
            rest = data[int(_starts(raw)[0]) :]
            size = next(n for n in (32, 16, *range(8, 0, -1)) if len(rest) >= n)
            padded = np.frombuffer(rest[:size].ljust(40, b"\0"), np.uint8)
            found.setdefault(size, {}).setdefault(int(_keys(padded, np.zeros(1, int), size)[0]), []).append(k)
        self.keys = {size: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for size, x in found.items()}

    def held(self, texts: pa.Array) -> tuple[list[int], list[str]]:
        """Rows of texts and ids of the items that they contain."""
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body else np.zeros(0, np.uint8)
        data, ends, met = np.concatenate([data, np.zeros(40, np.uint8)]), ends - ends[0], set()
        starts = _starts(data)
        for size, (keys, members) in self.keys.items():
            got = _keys(data, starts, size)
            at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == got)
            rows = np.searchsorted(ends, starts[hit], "right") - 1
            met |= {(r, k) for r, a in set(zip(rows.tolist(), at[hit].tolist())) if r < len(texts) for k in members[a]}
        met, cache = sorted(met), (None, None)
        out = []
        for r, k in met:
            if cache[0] != r:
                cache = r, texts[r].as_py()
            if cache[1] is not None and self.items[k][1] in cache[1]:
                out.append((r, self.items[k][0]))
        return [r for r, _ in out], [i for _, i in out]


def _starts(data: np.ndarray) -> np.ndarray:
    """Where words begin behind white space."""
    space = _SPACE[data]
    return np.flatnonzero(space[:-1] & ~space[1:]) + 1


def _keys(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """size bytes from each place as a number, mixed where they are more than eight. data goes on for 32 bytes behind the last place."""
    at = np.minimum(at, len(data) - 40) if len(data) > 40 else at
    longs = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = longs[at]
    if size < 8:
        return out & np.uint64((1 << 8 * size) - 1)
    for k in range(8, size, 8):
        out = out * np.uint64(0x9E3779B97F4A7C15) ^ longs[at + k]
    return out


def _window(k: int):
    return lambda _, i: F.xxhash64(*[F.get("w", i + j) for j in range(k)])


def _holding(sent):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows, items = sent.value.held(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), batch.column(0).take(pa.array(rows, pa.int64()))], ["item_id", "doc_id"])

    return run


def containing(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", width: int = 4, most: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """(item_id, doc_id) where the document's text contains the item's, letter by letter. docs: doc_id, text; items: item_id, text.

    An item's second word begins behind white space in any text that contains it. The bytes from there on are met by those
    from each word of the documents on, and what meets is checked; items are broadcast in blocks of about most_bytes. More than
    `most` items are not sent to the texts: an item's words but the first and last are words of any text that contains it, so the
    first `width` of them are hashed and met by the hashed windows of the documents, with ids alone. Items of fewer than three
    words are compared directly, broadcast in blocks of a thousand. An empty item is in every text, a null in none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col("text").alias("body"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col("text").alias("part")).filter("part is not null").withColumn("words", F.split("part", r"\s+"))
    long, found = asked.filter(F.size("words") >= 3), None
    n, size = long.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("part") + 200), F.lit(0))).first()
    if n > most:  # ids alone meet the items, and texts join behind the match
        long = long.withColumn("k", F.least(F.size("words") - 2, F.lit(width)))
        # a null beyond the end leaves a hash as it is
        inner = F.xxhash64(*[F.when(F.lit(j) < F.col("k"), F.get("words", F.lit(j + 1))) for j in range(width)])
        long = long.select("item_id", "part", "k", inner.alias("h"))
        widths = sorted(r.k for r in long.select("k").distinct().collect())  # of 1 to `width`
        hashed = F.array_distinct(F.concat(*[F.transform("w", _window(k)) for k in widths]))
        pairs = rows.withColumn("w", F.split("body", r"\s+")).select("doc_id", F.explode(hashed).alias("h")).join(long.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
        met = pairs.join(long.select("item_id", "part"), "item_id").join(rows, "doc_id")
        found = met.filter(F.col("body").contains(F.col("part"))).select("item_id", "doc_id").distinct()
    elif n:
        kinds, blocks = {**dict(asked.dtypes), **dict(rows.dtypes)}, -(-size // most_bytes)
        for i in range(blocks):
            mine = (long if blocks == 1 else long.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == i)).select(F.col("item_id").cast("string"), "part")
            sent = rows.sparkSession.sparkContext.broadcast(_Anchors([tuple(r) for r in mine.collect()]))  # about most_bytes
            pairs = rows.mapInArrow(_holding(sent), f"item_id string, doc_id {kinds['doc_id']}").select(F.col("item_id").cast(kinds["item_id"]).alias("item_id"), "doc_id")
            found = pairs if found is None else found.unionByName(pairs)
    short = asked.filter(F.size("words") < 3).select("item_id", "part")
    blocks = -(-short.count() // 1000)
    for i in range(blocks):
        mine = short if blocks == 1 else short.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == i)
        pairs = rows.join(F.broadcast(mine), F.col("body").contains(F.col("part"))).select("item_id", "doc_id")
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else rows.limit(0).select(F.lit(None).cast(dict(items.dtypes)[item_id]).alias("item_id"), "doc_id")


def recall_regression(fused: DataFrame, gold: DataFrame, at: int = 20, least: float = 0.9) -> DataFrame:
    """Share of queries with a gold document among the first `at`, and whether it passes."""
    hit = fused.filter(F.col("fused_rank") <= at).join(gold, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return gold.select("query_id").distinct().join(hit, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")).withColumn("passed", F.col("recall") >= least)
