"""Cross-entropy difference: how much more a text looks like the target documents than like the corpus.

Target and background are bigram models over one vocabulary, all words of the corpus. The counts are exact: every word and
every (previous word, word) that occurs is counted, so that a model grows with the corpus.
The models are matched: same order, vocabulary and smoothing, and background counts are scaled to the target's mass, so that
the smoothing weighs the same in both. P(w|v) = (c(v,w) + mu P(w)) / (c(v) + mu) with P(w) = (c(w) + 1) / (N + V).

Documents are read in batches. A task sends a batch's distinct words and bigrams with their counts to slots by hash; a slot
adds up what all batches sent and answers each batch with the totals of its keys; the batch, which has kept its sequence of
word numbers, scores its documents. A key travels once a batch however often it occurs, so that frequent ones weigh no more
than others, and no table is gathered in one place. Keys are 64-bit hashes with 16 bits of a second hash beside them, which
tell apart what shares a key.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, staged, texts_of
from .neardup import groups

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_U = np.uint64
UNKNOWN = b" "  # no word has a blank
#: Words of a batch, about. More make fewer keys and need more memory (some 100 bytes a word).
BATCH = 2_000_000
_SENT = "slot int, batch string, keys binary, checks binary, every binary, hits binary, docs long, targets long, answer boolean"
_FOUND = "batch string, slot int, a binary, b binary, c binary, d binary, ids array<long>, words long, every long, hits long, docs long, targets long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


@dataclass
class Models:
    """What is counted: docs (doc_id, text, hit), with the sorted ids of the target where hit doesn't tell."""

    docs: DataFrame
    target: object  # a broadcast or None
    words: set[bytes] | None  # None: all
    mu: float
    most_tasks: int
    of: tuple  # the table and columns that docs was made of


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def pack(a: np.ndarray) -> bytes:
    """An array by planes of bytes, compressed."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return struct.pack("<q", len(a)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n, kind = struct.unpack("<q", data[:8])[0], np.dtype(kind)
    raw = pa.decompress(data[8:], n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * _U(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (odd; those of bigrams are even) and second hashes."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return both[:, 0] | _U(1), both[:, 1].astype(np.uint16)


#: The mark before a document's first word; no word is empty.
_START = hashes([b""])


def bigrams(first: np.ndarray, second: np.ndarray, now: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and checks of each word of the sequence with the one before, and the numbers of the words before; START's comes after all."""
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(first)
    first, second = np.concatenate([first, _START[0]]), np.concatenate([second, _START[1]]).astype(np.uint64)
    return mixed(first[before], first[now]) & ~_U(1), (mixed(second[before], second[now]) >> _U(48)).astype(np.uint16), before


def sorting(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and check, and where in it the runs of one thing begin."""
    order = np.argsort(keys)
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # a key of two things
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))


def added(counts: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(counts[order], begin) if len(begin) else np.zeros(0, np.int64)


class Batch:
    """Documents' ids, whether they are targets, and words by number."""

    def __init__(self):
        self.ids, self.hit, self.parts, self.index, self.size = [], [], [], _Numbers(), 0

    def add(self, id_: int | None, hit: bool, words: list[bytes]) -> None:
        self.ids.append(id_)
        self.hit.append(hit)
        self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def sequence(self, name: str) -> tuple:
        """What scores the documents when the answers come: words' keys and second hashes by number, numbers, lengths."""
        first, second = hashes(list(self.index))
        lengths = np.array([len(x) for x in self.parts], np.int64)
        return name, -1, pack(first), pack(second), pack(np.concatenate(self.parts)), pack(lengths), self.ids, *[None] * 5

    def rows(self, name: str, slots: int, count: bool, answer: bool) -> Iterator[tuple]:
        """A row for each slot: its distinct keys in order and their counts. Without count the keys are only asked for."""
        lengths = np.array([len(x) for x in self.parts], np.int64)
        now, hit, size = np.concatenate(self.parts), np.array(self.hit, bool), len(self.index)
        first, second = hashes(list(self.index))
        keys, checks, _ = bigrams(first, second, now, lengths)
        hits = np.repeat(hit, lengths).astype(np.int64)
        order, begin = sorting(keys, checks)
        two = keys[order][begin], checks[order][begin], np.diff(np.append(begin, len(keys))), added(hits, order, begin)
        one = first, second, np.bincount(now, minlength=size), np.bincount(now, hits, minlength=size).astype(np.int64)
        sent = [np.concatenate(x) for x in zip(two, one)]
        order, _ = sorting(sent[0], sent[1])
        sent = [x[order] for x in sent]
        if not count:
            sent[2], sent[3] = sent[2] * 0, sent[3] * 0
        edges = np.searchsorted(slot_of(sent[0], slots), np.arange(slots + 1))
        for slot in range(slots):
            k, c, e, h = (x[edges[slot] : edges[slot + 1]] for x in sent)
            docs = (len(hit), int(hit.sum())) if count and slot == 0 else (0, 0)
            yield slot, name, pack(np.diff(k, prepend=_U(0))), pack(c), pack(e.astype(np.uint32)), pack(h.astype(np.uint32)), *docs, answer


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """Slots are ranges of keys."""
    return (((keys >> _U(32)) * _U(slots)) >> _U(32)).astype(np.int64)


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], schema=pa.schema(fields))


def by_batch(docs: DataFrame, m: Models, label: str, schema: str, rows) -> DataFrame:
    """rows(batch, name) of each batch of docs (doc_id, text, hit). Batches are the same in each pass over docs."""
    spark, target = docs.sparkSession, m.target
    known = spark.sparkContext.broadcast(m.words) if m.words is not None else None
    n = docs.rdd.getNumPartitions()
    docs = docs.coalesce(m.most_tasks) if n > m.most_tasks else docs
    docs = docs.select("doc_id", "text", "hit", F.spark_partition_id().alias("part"))  # a task's own number differs in a union

    def run(batches):
        number, now = 0, Batch()
        for batch in slices(batches, 500):
            part = batch.column(3)[0].as_py()
            if target is not None:
                wanted = target.value
                where = [i is not None and (k := int(np.searchsorted(wanted, i))) < len(wanted) and wanted[k] == i for i in batch.column(0).to_pylist()]
            else:
                where = batch.column(2).to_pylist()
            for id_, hit, text in zip(batch.column(0).to_pylist(), where, texts_of(batch)):
                words = split(text)
                if known is not None:
                    words = [w if w in known.value else UNKNOWN for w in words]
                now.add(id_, bool(hit), words)
                if now.size >= BATCH:
                    yield from out(rows(now, f"{label}-{part}-{number}"))
                    number, now = number + 1, Batch()
        if now.ids:
            yield from out(rows(now, f"{label}-{part}-{number}"))

    def out(made):
        while some := list(islice(made, 32)):
            yield arrow(some, schema)

    return docs.mapInArrow(run, schema)


def answered(messages: DataFrame, slots: int) -> DataFrame:
    """A row for each batch that asks and each slot: the totals of its keys, in all and in target documents, and the slot's sums."""

    def run(batches):
        for rows in groups(slices(batches, 64), 1):
            parts = [np.cumsum(unpack(r[2], np.uint64), dtype=np.uint64) for r in rows]
            keys, checks = np.concatenate(parts), np.concatenate([unpack(r[3], np.uint16) for r in rows])
            order, begin = sorting(keys, checks)
            sums = [added(np.concatenate([unpack(r[k], np.uint32) for r in rows]).astype(np.int64), order, begin) for k in (4, 5)]
            word = (keys[order][begin] & _U(1)).astype(bool) & (sums[0] > 0)
            corpus = int(word.sum()), int(sums[0][word].sum()), int(sums[1][word].sum()), sum(r[6] for r in rows), sum(r[7] for r in rows)
            whole = np.empty((2, len(keys)), np.int64)
            whole[:, order] = np.repeat(sums, np.diff(np.append(begin, len(keys))), axis=1)
            at = 0
            for row, part in zip(rows, parts):
                if row[8]:
                    totals = (pack(x[at : at + len(part)].copy()) for x in whole)
                    yield arrow([(row[1], row[0], *totals, None, None, None, *corpus)], _FOUND)
                at += len(part)

    return messages.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "batch").mapInArrow(run, _FOUND)


def vocabulary(texts: DataFrame, most_words: int) -> dict[bytes, int]:
    """Ids from 2 for the most_words most frequent words of all texts by exact count, equal ones by word. Only the level of frequency that doesn't fit as a whole is sorted."""

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                counts.update(split(text))
                if len(counts) > 400_000:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    summed = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    leveled = staged(summed.withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    # a row for each level, at most about a thousand
    sizes, least, total = leveled.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), None, 0
    border = None
    for level, words in sorted(sizes, reverse=True):
        if total + words > most_words:
            border = level
            break
        total, least = total + words, level
    kept = leveled.filter(F.col("level") >= least).select("n", "word").collect() if least is not None else []
    if border is not None:
        kept += leveled.filter(F.col("level") == border).orderBy(F.desc("n"), "word").limit(most_words - total).select("n", "word").collect()
    return {w: i + 2 for i, (_, w) in enumerate(sorted((-r.n, bytes(r.word)) for r in kept))}


def learn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int | None = None, bits: int | None = None, mu: float = 50.0, most_tasks: int = 2048, most_ids: int = 4_000_000) -> Models:
    """Models of the documents whose id is in target (column doc_id) and of all documents; counted when a table is scored.

    most_words: keep so many words and take the others as one unknown word; all are kept without it. bits has no effect, as
    bigrams are told apart. Up to most_ids target ids (8 bytes each) are broadcast; more are joined, which moves the texts once.
    """
    rows = id_and_text(docs, id_col, text_col)
    words = set(vocabulary(rows.select("text"), most_words)) if most_words is not None else None
    ids = staged(target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "target")
    sent_ids = None
    if ids.count() <= most_ids:
        sent_ids = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in ids.toLocalIterator()], np.int64)))
        marked = rows.withColumn("hit", F.lit(False))
    else:
        marked = staged(rows.join(ids.withColumn("hit", F.lit(True)), "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "marked")
    return Models(marked, sent_ids, words, mu, most_tasks, (docs, id_col, text_col))


def losses(first: np.ndarray, second: np.ndarray, now: np.ndarray, lengths: np.ndarray, totals: list[np.ndarray], corpus: tuple, mu: float) -> list[np.ndarray]:
    """The target's and the background's mean loss (nats a word) of each document that has words.

    first, second: hashes of the words by number; totals: counts in all and in target documents of the batch's keys in order;
    corpus: vocabulary, words in all and in target documents, documents, target documents.
    """
    size, whole, mass, n_docs, n_targets = corpus
    keys, checks, before = bigrams(first, second, now, lengths)
    order, begin = sorting(keys, checks)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
    sent, _ = sorting(np.concatenate([keys[order][begin], first]), np.concatenate([checks[order][begin], second]))
    where = np.empty(len(sent), np.int64)
    where[sent] = np.arange(len(sent))
    place, ones = where[: len(begin)][place], where[len(begin) :]
    out = []
    for k, scale, begun in ((1, 1.0, n_targets), (0, mass / max(1, whole), n_docs)):
        one = np.append(totals[k][ones], begun).astype(np.float64)
        p = totals[k][place] * scale + mu * ((one[now] * scale + 1.0) / (mass + size))
        p /= one[before] * scale + mu
        out.append(-np.add.reduceat(np.log(p), (np.cumsum(lengths) - lengths)[lengths > 0]) / lengths[lengths > 0])
    return out


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, target_loss, background_loss, score (their difference; lower is more like the target).

    A null text or one without words has 0 tokens and null losses and score. Without target documents both models are flat
    and scores 0. Repeated rows are scored each; an empty table gives an empty result; other columns of docs are ignored.
    """
    same, words = models.of[0] is docs and models.of[1:] == (id_col, text_col), models.words
    slots, mu = max(16, 4 * models.docs.rdd.getNumPartitions()), models.mu
    messages = by_batch(models.docs, models, "l", _SENT, lambda b, name: b.rows(name, slots, True, same))
    asked, label = (models.docs, "l") if same else (id_and_text(docs, id_col, text_col).withColumn("hit", F.lit(False)), "s")
    if not same:
        messages = messages.unionByName(by_batch(asked, models, label, _SENT, lambda b, name: b.rows(name, slots, False, True)))
    sequences = by_batch(asked, models, label, _FOUND, lambda b, name: iter([b.sequence(name)]))

    def run(batches):
        for rows in groups(slices(batches, 64), 1):
            _, _, first, second, now, lengths, ids = rows[0][:7]
            lengths = unpack(lengths, np.int64)
            sums = [sum(r[k] for r in rows[1:]) for k in range(7, 12)]
            corpus = ((sums[0] if words is None else len(words)) + 2, *sums[1:])
            null, found = lengths == 0, [np.zeros(0)] * 2
            if not null.all():
                totals = [np.concatenate([unpack(r[k], np.int64) for r in rows[1:]]) for k in (2, 3)]
                found = losses(unpack(first, np.uint64), unpack(second, np.uint16), unpack(now, np.int32), lengths, totals, corpus, mu)
            columns = []
            for x in (*found, found[0] - found[1]):
                full = np.zeros(len(lengths))
                full[~null] = x
                columns.append(pa.array(full, mask=null))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    dealt = answered(messages, slots).unionByName(sequences).repartition(slots, "batch").sortWithinPartitions("batch", "slot")
    return dealt.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
