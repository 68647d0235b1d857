"""Quality by weak supervision: rules vote for or against a text or abstain, and how far to trust each is learned without labels.

A map computes the statistics and the votes of each text. The votes' patterns, of which there are at most 3 to the number of
rules whatever the corpus, are counted over all documents. Expectation-maximisation on these counts estimates the share of
good texts and, for each rule, how often it votes either way or abstains on good and on bad texts. A text is kept if its
pattern's posterior probability of being good reaches the threshold, instead of having to pass every rule.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, staged, texts_of

# fixed values: the characters that count as symbols, ASCII white space, and what may close a line
SYMBOLS, SPACE, ENDS = "#*$%&|<>", " \t\n\x0b\x0c\r", ".!?…。！？:;\"'”’»)"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Votes by a statistic: good inside [low, high], bad outside [least, most], else it abstains; it abstains on texts of fewer than `words` words."""

    name: str
    low: float
    high: float
    least: float
    most: float
    words: int = 1


#: shares are a word, a line, a letter or, for repeated lines, a character
RULES = (
    Rule("words_in_text", 50, 1e9, 10, 1e9, 0),
    Rule("chars_a_word", 3.5, 8, 2.5, 12),
    Rule("symbols_a_word", 0, 0.02, 0, 0.1),
    Rule("words_with_symbols", 0, 0.05, 0, 0.2),
    Rule("bangs_a_word", 0, 0.05, 0, 0.3),
    Rule("upper_letters", 0, 0.15, 0, 0.4),
    Rule("words_with_letters", 0.9, 1, 0.7, 1),
    Rule("repeated_words", 0, 0.05, 0, 0.2, 10),
    Rule("repeated_lines", 0, 0.1, 0, 0.3, 10),
    Rule("closed_lines", 0.8, 1, 0.3, 1, 10),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes]) -> int:
    """Words inside any window of five that occurs twice or more."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words])
    if len(number) == len(words):
        return 0
    n = len(words) - WINDOW + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed + at[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows would be mixed alike
        return 0
    # two windows are joined to one number each time, which tells apart what it stands for
    pair = _named(at[:-1], at[1:])
    four = _named(pair[:-2], pair[2:])
    five = _named(four[:n], at[WINDOW - 1 :])
    twice = np.flatnonzero(np.bincount(five)[five] > 1)
    edge = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + WINDOW, minlength=len(words) + 1)
    return int((np.cumsum(edge) > 0).sum())


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs only."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


_LETTER, _UPPER, _SPACE, _SYMBOL = 1, 2, 4, 8


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point is, as bits."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = _LETTER | (_UPPER if x.isupper() else 0)
    out[[ord(c) for c in SPACE]] |= _SPACE
    out[[ord(c) for c in SYMBOLS]] |= _SYMBOL
    return out


def counted(text: str) -> tuple[tuple[int, ...], dict[str, float]]:
    """The counts of COUNTS, and the rules' statistics."""
    words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space, as bytes are split
    n = len(words)
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = (kinds & _SPACE) > 0
    starts = np.flatnonzero(~space & np.concatenate([[True], space])[: len(space)])
    in_words = np.bitwise_or.reduceat(kinds, starts) if n else kinds  # what each word holds
    of = lambda bit, where: int(np.count_nonzero(where & bit))
    chars, symbols, rep = len(text) - int(space.sum()), of(_SYMBOL, kinds), repeated(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    once = set(lines)
    dup, again = len(lines) - len(once), 1 - sum(map(len, once)) / max(1, sum(map(len, lines))) if lines else 0
    closed = sum(x.rstrip(SPACE)[-1] in ENDS for x in lines)
    each, line = max(1, n), max(1, len(lines))
    stats = {
        "words_in_text": n, "chars_a_word": chars / each, "symbols_a_word": symbols / each, "words_with_symbols": of(_SYMBOL, in_words) / each if n else 0,
        "bangs_a_word": text.count("!") / each, "upper_letters": of(_UPPER, kinds) / max(1, of(_LETTER, kinds)), "words_with_letters": of(_LETTER, in_words) / each if n else 0,
        "repeated_words": rep / each, "repeated_lines": again, "closed_lines": closed / line,
    }
    return (n, chars, symbols, dup, rep), stats


def vote(rule: Rule, stats: dict[str, float]) -> int:
    """1 for good, -1 for bad, 0 for no opinion."""
    x = stats[rule.name]
    if stats["words_in_text"] < rule.words:
        return 0
    return 1 if rule.low <= x <= rule.high else -1 if not rule.least <= x <= rule.most else 0


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts and the votes, as a number in base three whose lowest place is the first rule's vote plus one, of every text; null counts as empty."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [counted(t) for t in texts_of(batch, step=32)]
        votes = [sum((vote(r, stats) + 1) * 3**k for k, r in enumerate(rules)) for _, stats in found]
        yield {"doc_id": batch.column(0), **{c: [x[k] for x, _ in found] for k, c in enumerate(COUNTS)}, "votes": votes}

    return map_arrow(id_and_text(docs), f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, votes long", rows)


@dataclass
class Model:
    """share of good texts; against: for good texts and for bad ones, how often each rule votes against a text if it votes."""

    share: float
    against: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of being good for rows of votes. An abstention says nothing."""
        down, up = (patterns < 0).astype(float), (patterns > 0).astype(float)
        good, bad = (np.log(p) + down @ np.log(a) + up @ np.log1p(-a) for p, a in zip((self.share, 1 - self.share), self.against))
        return np.exp(good - np.logaddexp(good, bad))


def digits(votes: np.ndarray, rules: int) -> np.ndarray:
    return np.array([[v // 3**k % 3 - 1 for k in range(rules)] for v in votes.tolist()], int).reshape(-1, rules)


def estimate(patterns: np.ndarray, counts: np.ndarray, share: float = 0.9, on_good: float = 0.002, on_bad: float = 0.15, prior: float = 20.0, rounds: int = 500, near: float = 1e-9) -> Model:
    """Expectation-maximisation over patterns and how often each occurs.

    It starts from rules that seldom vote against a good text, and of which any one votes against some bad ones only, as a text
    is bad in one way or another and not in all. These rates stay as a prior worth `prior` votes of each rule in each class, so
    no rate becomes 0 or 1. It ends after `rounds`, or when nothing moves by more than `near`.
    """
    first = np.array([[on_good], [on_bad]]) * np.ones(patterns.shape[1])
    model = Model(share, first)
    down, voted = patterns < 0, patterns != 0
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([good, 1 - good]) * counts
        against = (weight @ down + prior * first) / (weight @ voted + prior)
        moved = Model(float((weight[0].sum() + prior * share) / (counts.sum() + prior)), against)
        done = max(np.abs(moved.against - model.against).max(initial=0), abs(moved.share - model.share)) <= near
        model = moved
        if done:
            break
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, fit: Callable[[np.ndarray, np.ndarray], Model] = estimate) -> DataFrame:
    """doc_id, the counts, base_failed, kept and posterior (of being good) of every row of docs.

    Words are runs without ASCII white space, of the whole text; null counts as empty and has none. n_symbols counts SYMBOLS,
    n_dup_lines the lines with a word that equal an earlier line, n_repeat_words the words in windows of five words that
    occur twice or more. Texts of fewer than ten words, or with more than a fifth of their words repeated, are base_failed
    and not kept. Rows that repeat, and rows without an id, are judged each; equal texts get equal verdicts. An empty table
    gives an empty result; other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    found = staged(measured(docs, rules), "measured")
    patterns = found.groupBy("votes").count().orderBy("votes").toArrow()  # at most 3 ** len(rules)
    votes, counts = patterns["votes"].to_numpy(), patterns["count"].to_numpy().astype(float)
    each = digits(votes, len(rules))
    table = pa.table({"votes": pa.array(votes, pa.int64()), "posterior": pa.array(np.round(fit(each, counts).posterior(each), 9), pa.float64())})
    known = F.broadcast(spark.createDataFrame(table))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = found.join(known, "votes").withColumn("base_failed", failed)
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior", "votes")
