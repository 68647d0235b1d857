"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is lower-cased and every ASCII character that isn't a letter becomes a space. Its features are the byte 2-, 3- and
4-grams that have no space inside, hashed to buckets. A text's vector is the mean of its buckets' embeddings; a linear
softmax over it gives the language. As mean and softmax weights are linear, a trained model folds into one table (bucket ->
a logit for each language), so a prediction is one gather and one mean over the whole text. Confidence is calibrated by a
temperature, and the rejection threshold by the share of held-back training fragments that it may reject.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, texts_of

_ASCII = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x langs, float32
    bias: np.ndarray
    temperature: float
    threshold: float


def has_letter(text: str) -> bool:
    """A letter of any script; numerals such as ½, ② or Ⅷ are none."""
    return any(map(str.isalpha, text))


def features(data: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram, buckets and whether the n-gram at that place counts."""
    x = data.astype(np.uint32)
    space = data == 32
    out = []
    h = x[:-1] * _SALTS[0] + x[1:] * _SALTS[1]
    fine = ~(space[:-1] & space[1:])
    out.append((_mixed(h, bits), fine))
    h = h[:-1] + x[2:] * _SALTS[2]
    inner = ~space[1:-1]
    out.append((_mixed(h ^ np.uint32(0x5BD1E995), bits), inner))
    h = h[:-1] + x[3:] * _SALTS[3]
    out.append((_mixed(h ^ np.uint32(0x1B873593), bits), inner[:-1] & ~space[2:-1]))
    return out


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)


def prepared(text: str) -> bytes:
    return b"  " + text.lower().encode("utf-8", "surrogatepass").translate(_ASCII) + b"  "


def bags(texts: list[str], bits: int) -> list[np.ndarray]:
    out = []
    for text in texts:
        found = features(np.frombuffer(prepared(text), np.uint8), bits)
        out.append(np.concatenate([b[ok] for b, ok in found]).astype(np.int64))
    return out


def logits(texts: list[str], table: np.ndarray, bias: np.ndarray, bits: int, block: int = 1 << 18) -> np.ndarray:
    """Mean logits of each whole text, in blocks of about `block` bytes, so that memory doesn't follow a text's length."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))

    def add(parts: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        starts = np.cumsum([0, *(len(p) for _, p in parts)])[:-1]
        rows = [i for i, _ in parts]
        for buckets, ok in features(data, bits):
            got = table[buckets]
            got[~ok] = 0
            np.add.at(sums, rows, np.add.reduceat(got, np.minimum(starts, len(got) - 1), axis=0, dtype=np.float64))
            np.add.at(counts, rows, np.add.reduceat(ok, np.minimum(starts, len(ok) - 1), dtype=np.int64))

    parts, size = [], 0
    for i, text in enumerate(texts):
        data = prepared(text)
        for a in range(0, len(data) - 3, block):  # pieces overlap by an n-gram's length less one, so that each n-gram counts once or nearly so
            piece = data[a : a + block + 3]
            parts.append((i, piece))
            size += len(piece)
            if size >= block:
                add(parts)
                parts, size = [], 0
    if parts:
        add(parts)
    return sums / np.maximum(counts, 1)[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], bits: int = 16, dim: int = 16, epochs: int = 6, rate: float = 0.4, batch: int = 32, false_reject: float = 0.001, seed: int = 7) -> Model:
    """Every fifth fragment is held back to calibrate."""
    names = sorted(set(langs))
    y_all = np.array([names.index(x) for x in langs])
    r = np.random.default_rng(seed)
    order = r.permutation(len(texts))
    held, learn = order[::5], np.delete(order, np.s_[::5])
    if len(learn) == 0:
        learn = held
    all_bags = bags(texts, bits)
    emb = r.uniform(-0.5 / dim, 0.5 / dim, (1 << bits, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, step = epochs * max(1, len(learn) // batch), 0
    for _ in range(epochs):
        for at in range(0, len(learn), batch):
            rows = learn[(perm := r.permutation(len(learn)))[:batch]] if at == 0 else learn[perm[at : at + batch]]
            lr = rate * max(0.05, 1 - step / steps)
            step += 1
            ids = np.concatenate([all_bags[i] for i in rows])
            sizes = np.array([len(all_bags[i]) for i in rows])
            n = np.maximum(sizes, 1)
            owner = np.repeat(np.arange(len(rows)), sizes)
            hidden = np.zeros((len(rows), dim), np.float32)
            if len(ids):
                full = sizes > 0
                hidden[full] = np.add.reduceat(emb[ids], (np.cumsum(sizes) - sizes)[full], axis=0)
            hidden /= n[:, None]
            p = softmax(hidden @ w + bias)
            p[np.arange(len(rows)), y_all[rows]] -= 1
            back = (p @ w.T / n[:, None]).astype(np.float32)
            w -= lr * hidden.T @ p / len(rows) * 8
            bias -= lr * p.mean(axis=0)
            np.add.at(emb.reshape(-1), (ids[:, None] * dim + np.arange(dim)).reshape(-1), (-lr * 8 * back)[owner].reshape(-1))
    table = (emb @ w).astype(np.float32)
    check = held if len(held) else learn
    z = logits([texts[i] for i in check], table, bias, bits)
    y = y_all[check]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 10, 60), key=loss))
    sure = softmax(z / temperature).max(axis=1)
    return Model(names, table, bias, temperature, float(min(0.5, np.quantile(sure, false_reject, method="lower"))))


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    """Language, calibrated confidence and whether the text is rejected: no letter, or less sure than the threshold."""
    if not model.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    bits = int(model.table.shape[0]).bit_length() - 1
    p = softmax(logits(texts, model.table, model.bias, bits) / model.temperature)
    best = p.argmax(axis=1)
    letters = [has_letter(t) for t in texts]
    langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
    scores = [float(min(1.0, p[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters))]
    return langs, scores, [not ok or s < model.threshold for ok, s in zip(letters, scores)]


def fragments(text: str, seed: int) -> list[str]:
    """Four pieces of a text, from a word or two to 150 words: predictions then hold for short texts as well."""
    words = text.split()
    r = np.random.default_rng(seed)
    out = []
    for low, high in ((1, 4), (4, 12), (12, 40), (40, 150)):
        n = int(r.integers(low, high))
        a = int(r.integers(0, max(1, len(words) - n + 1)))
        out.append(" ".join(words[a : a + n]))
    return [x for x in out if has_letter(x)]


def training_fragments(labelled: DataFrame, per_lang: int) -> list[tuple[str, str]]:
    """(lang, fragment) of about per_lang documents of each language, the ones with the smallest hash of id and text."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_lang / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(1_000_003)) / 1_000_003.0
    chosen = labelled.filter(drawn < share[F.col("lang")]) if max(counts.values()) > per_lang else labelled

    def cut(batches):
        for batch in slices(batches):
            rows = [(lang, x) for i, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))) for x in fragments(text, abs(i or 0))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], ["lang", "fragment"])

    return sorted((r.lang, r.fragment) for r in chosen.mapInArrow(cut, "lang string, fragment string").collect())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500, **settings) -> Model:
    """A model of the rows with text and label. per_lang bounds the documents that it is fitted on, a language; without any such row it has no language.

    Repeated rows are drawn alike, ties between languages go to the first by name, and other columns are ignored.
    """
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    rows = training_fragments(labelled, per_lang)
    if not rows:
        return Model([], np.zeros((2, 0), np.float32), np.zeros(0), 1.0, 0.5)
    return train([x for _, x in rows], [x for x, _ in rows], **settings)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from: those with an id that aren't held out."""
    return docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, rejected.

    A null text or one without a letter is `und` with score 0 and rejected; ties go to the language first by name; without
    a learned language all are `und`. An empty table gives an empty result; other columns of docs are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            langs, scores, rejected = predict(sent.value, list(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, whatever their names; a map beside the row, so that no join follows.

    A null or empty text, or one without a letter, is rejected, and so is every text if the model has no language. Repeated
    rows and rows without an id are judged each by their own text, of any length; an empty table gives an empty one.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            rejected = predict(sent.value, [x or "" for x in batch.column(at).to_pylist()])[2]
            yield batch.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
