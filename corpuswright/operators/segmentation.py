"""Words of Han text: a vocabulary learned from the corpus, and the best path through the graph of all words of a text.

Character sequences of up to four are counted over all texts; those that occur often, and more often than their parts would
by chance, are words, weighed by the logarithm of their share. Listed words of the domain are kept whole: a path is judged
first by the characters that listed words cover, then by its weights. The words go to the tasks as a trie.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenize import STOPWORDS, USER_WORDS
from ..plans.shared import fixed

#: Java's and Python's name for Han characters in a pattern; Python's re has none, so their blocks are given.
_HAN = r"⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎\U00016fe2\U00016fe3\U00016ff0\U00016ff1\U00020000-\U0003347f"
_RUNS = re.compile(rf"[{_HAN}]+|[^\W_{_HAN}]+")
_FIRST = re.compile(rf"[{_HAN}]")
LONGEST = 4


def ngram_counts(texts: Column, source: DataFrame, longest: int = LONGEST, starts: int = 8) -> DataFrame:
    """word and count of every sequence of up to `longest` Han characters inside a run of them.

    Runs are cut into pieces of `starts` characters, each with the few that follow it, so that each sequence begins in one
    piece. Pieces are counted before they are dealt out, and only different ones are taken apart.
    """
    cut = F.lit(rf"(?=(\p{{IsHan}}{{1,{starts + longest - 1}}}))\p{{IsHan}}{{1,{starts}}}")
    pieces = source.select(F.explode(F.regexp_extract_all(texts, cut, 1)).alias("piece")).filter("piece <> ''")
    pieces = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("times"))
    begins = lambda n: F.least(F.lit(starts), F.length("piece") - (n - 1))
    grams = lambda n: F.when(begins(n) >= 1, F.transform(F.sequence(F.lit(1), begins(n)), lambda i: F.col("piece").substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return pieces.select(F.explode(F.concat(*[grams(n) for n in range(1, longest + 1)])).alias("word"), "times").groupBy("word").agg(F.sum("times").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", least: int = 5, cohesion: int = 10, most_words: int = 500_000, longest: int = LONGEST) -> DataFrame:
    """word, n and weight: all single characters, and longer sequences that occur `least` times or more and, however they are cut in two, `cohesion` times as often as their parts would meet by chance.

    Null and empty texts count nothing. The most frequent most_words are kept, ties by word; this bounds what a segmenter
    sends to the tasks, and what it leaves out is split into shorter words.
    """
    counts = ngram_counts(F.col(text_col), docs, longest)
    often = fixed(counts.filter((F.length("word") == 1) | (F.col("n") >= least)))  # read five times below
    total = often.filter(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # each way to cut a longer word, met with the counts of its two parts, which are at least as frequent and so kept too
    cuts = often.filter(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, at)").alias("left"), F.expr("substring(word, at + 1)").alias("right"))
    part = lambda side: often.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    met = cuts.join(part("left"), "left").join(part("right"), "right").crossJoin(F.broadcast(total))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    held = exact("n") * exact("total") >= exact("n_left") * exact("n_right") * cohesion
    words = met.groupBy("word").agg(F.bool_and(held).alias("held")).filter("held").select("word")
    kept = often.filter(F.length("word") == 1).unionByName(often.join(words, "word", "left_semi"))
    weighed = kept.crossJoin(F.broadcast(total)).select("word", "n", F.round(F.log(F.col("n") / F.col("total")), 9).alias("weight"))
    return weighed.orderBy(F.desc("n"), "word").limit(most_words)


class Trie:
    """Words with weights, found from any place of a text in one walk."""

    END = ""

    def __init__(self, words: Sequence[tuple[str, float]], listed: Sequence[str] = (), unknown: float | None = None):
        self.root: dict = {}
        self.unknown = unknown if unknown is not None else min((w for _, w in words), default=-1.0) - 1.0
        for word, weight in words:
            self._put(word, (0, weight))
        for word in listed:  # of listed words that cover the same, fewer are better
            self._put(word, (len(word), -1.0))

    def _put(self, word: str, value: tuple[int, float]) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[self.END] = value

    def path(self, text: str) -> list[str]:
        """The words of the best path: most characters in listed words, then the largest sum of weights, then the longer word first. A character that no word begins with is one of its own."""
        n = len(text)
        covered, score, step = [0] * (n + 1), [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            best = (covered[i + 1], self.unknown + score[i + 1])
            node, j = self.root, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                found = node.get(self.END)
                if found is not None:
                    now = (found[0] + covered[j], found[1] + score[j])
                    if now >= best:
                        best, step[i] = now, j - i
            covered[i], score[i] = best
        out, i = [], 0
        while i < n:
            out.append(text[i : i + step[i]])
            i += step[i]
        return out


class Runs(dict):
    """The words of runs by the trie, without stop words of one character; runs of other letters and digits are words. Short runs are kept, 250,000 at most."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, run: str) -> list[str]:
        words = self.trie.path(run) if _FIRST.match(run) else [run]
        words = [w for w in words if len(w) > 1 or w not in STOPWORDS]
        if len(run) <= 64:
            if len(self) >= 250_000:
                self.clear()
            self[run] = words
        return words


def han_tokens(trie: Trie, text: str, known: Runs | None = None) -> list[str]:
    """A text's words in order, in lower case: Han runs by the trie, other runs of letters and digits whole; stop words of one character are left out."""
    known = Runs(trie) if known is None else known
    return [w for run in _RUNS.findall(text.lower()) for w in known[run]]


def _listed(texts: pa.Array, known: Runs) -> pa.Array:
    """The words of each text, null for null."""
    ends, flat, runs = [0], [], _RUNS.findall
    for text in texts.to_pylist():
        if text is not None:
            for run in runs(text.lower()):
                flat += known[run]
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()), mask=texts.is_null())


_tries: dict[str, Runs] = {}


class Segmenter:
    """A column function from texts to words, for an index and its questions alike."""

    def __init__(self, spark: SparkSession, words: Sequence[tuple[str, float]], listed: Sequence[str] = USER_WORDS):
        self.words, self.listed = list(words), list(listed)
        self._sent = spark.sparkContext.broadcast((uuid.uuid4().hex, self.words, self.listed))

    @staticmethod
    def of(vocabulary: DataFrame, listed: Sequence[str] = USER_WORDS) -> Segmenter:
        """From a vocabulary (word, weight), which bounds what is sent."""
        rows = vocabulary.select("word", "weight").orderBy("word").collect()
        return Segmenter(vocabulary.sparkSession, [(r.word, r.weight) for r in rows], listed)

    @property
    def tokens(self) -> Callable[[Column], Column]:
        sent = self._sent

        @F.arrow_udf("array<string>")
        def segment(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            name, words, listed = sent.value
            if name not in _tries:  # a worker holds one
                _tries.clear()
                _tries[name] = Runs(Trie(words, listed))
            for texts in parts:
                # a few texts at a time, as Python's strings are many times as large
                yield pa.concat_arrays([_listed(texts.slice(at, 256), _tries[name]) for at in range(0, max(1, len(texts)), 256)])

        return lambda c: segment(c)


def learned(docs: DataFrame, text_col: str = "text", **options) -> Segmenter:
    return Segmenter.of(vocabulary(docs, text_col, **options))


def word_counts(docs: DataFrame, segmenter: Segmenter, text_col: str = "text") -> DataFrame:
    """word and n over all texts."""
    return docs.select(F.explode(segmenter.tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

