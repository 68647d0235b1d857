import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuswright.llm import quality

ODD = [None, "", " \t\n", "one", "a b c d e a b c d e", "x " * 30, "x " * 5, "a b c\x1cd\x85e", "#*$%&|<> <<>>", "l\nl\n\n \n \nl\r\nl", "日本語 日本語 " * 9, "🙂 é́ ß", "A B C D E F A B C D E G " * 2]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_words int, kept string, votes int")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit, seen, dup = Counter(spans), set(), set(), 0
    for i, s in enumerate(spans):
        if often[s] > 1:
            hit.update(range(i, i + 5))
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def slow_posteriors(votes):
    """Expectation-maximisation text by text, with plain numbers."""
    share, rates = 0.9, {True: [0.002] * len(votes[0]), False: [0.15] * len(votes[0])}

    def good_share(v):
        chance = {True: share, False: 1 - share}
        for c in chance:
            for x, p in zip(v, rates[c]):
                chance[c] *= p if x < 0 else 1 - p if x > 0 else 1
        return chance[True] / (chance[True] + chance[False])

    for _ in range(500):
        w = [good_share(v) for v in votes]
        moved = {}
        for c, first in ((True, 0.002), (False, 0.15)):
            mass = w if c else [1 - x for x in w]
            moved[c] = [(sum(m for m, v in zip(mass, votes) if v[r] < 0) + 20 * first) / (sum(m for m, v in zip(mass, votes) if v[r]) + 20) for r in range(len(votes[0]))]
        to = (sum(w) + 20 * 0.9) / (len(votes) + 20)
        done = max(abs(to - share), *(abs(a - b) for c in rates for a, b in zip(rates[c], moved[c]))) <= 1e-9
        share, rates = to, moved
        if done:
            break
    return [good_share(v) for v in votes]


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(3, 8))) for _ in range(n)).capitalize() + "."


def corpus(r):
    good = [prose(r, r.randrange(30, 200)) + "\n" + prose(r, 20) for _ in range(150)]
    shout = [re.sub(" ", "!! ", prose(r, 60).upper()) for _ in range(12)]
    signs = [re.sub(" ", lambda m: r.choice(["### ", "$$$ ", "&&& "]), prose(r, 60)) for _ in range(12)]
    lists = [" | ".join(prose(r, 1) for _ in range(40)) for _ in range(12)]
    return [(i, t) for i, t in enumerate(good)] + [(1000 + i, t) for i, t in enumerate(shout + signs + lists)]


def test_counts_equal_brute_force():
    r = random.Random(6)
    pool = ["a", "b", "A#", "$$", "\n", "\n", "é", "\t", "日本", "x|y", " ", "\x1f"]
    for text in ODD + ["".join(r.choice(pool) + r.choice(" \n" + " " * 3) for _ in range(r.randrange(120))) for _ in range(600)]:
        assert quality.counted(text or "")[0] == brute(text), text
    long = "alpha beta gamma delta eps " * 40_000
    assert quality.counted(long)[0] == (200_000, sum(map(len, long.split())), 0, 0, 200_000)


def test_query_equals_brute_force(spark):
    rows = corpus(random.Random(7)) + [(2000 + i, t) for i, t in enumerate(ODD)] + [(5, "again again"), (5, "again again"), (None, prose(random.Random(1), 80))]
    got = quality.judge(docs_of(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes"]
    votes = [[quality.vote(rule, quality.counted(t or "")[1]) for rule in quality.RULES] for _, t in rows]
    want = []
    for (i, t), p in zip(rows, slow_posteriors(votes)):
        counts = brute(t)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want.append((-1 if i is None else i, *counts, failed, not failed and p >= 0.5, round(p, 6)))
    have = [(-1 if g.doc_id is None else g.doc_id, *(g[c] for c in quality.COUNTS), g.base_failed, g.kept, round(g.posterior, 6)) for g in got.collect()]
    assert [x[:-1] for x in sorted(have)] == [x[:-1] for x in sorted(want)]
    assert np.allclose([x[-1] for x in sorted(have)], [x[-1] for x in sorted(want)], atol=2e-6)


def test_junk_goes_and_prose_stays(spark):
    got = {g.doc_id: g.kept for g in quality.judge(docs_of(spark, corpus(random.Random(8)))).collect()}
    assert all(kept == (i < 1000) for i, kept in got.items())


def test_the_planted_rates_are_found():
    r = np.random.default_rng(9)
    good, against = r.random(60_000) < 0.8, np.array([[0.01, 0.02, 0.01, 0.03, 0.02], [0.6, 0.5, 0.7, 0.4, 0.5]])
    votes = np.where(r.random((len(good), 5)) < 0.2, 0, np.where(r.random((len(good), 5)) < against[(~good).astype(int)], -1, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.share - 0.8) < 0.02 and np.abs(model.against - against).max() < 0.03


def test_unanimous_empty_and_silent(spark):
    assert quality.judge(docs_of(spark, [])).collect() == []
    assert quality.estimate(np.zeros((1, 3), int), np.array([5.0])).posterior(np.zeros((1, 3), int))[0] > 0.5
    text = prose(random.Random(2), 90)
    assert all(g.kept for g in quality.judge(docs_of(spark, [(i, text) for i in range(50)])).collect())


def test_public_labels_agree(spark):
    """Labels take no part in the method; on the public tables good texts stay and most of the others go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    met = quality.judge(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share"))
    share = {x.quality: x.share for x in met.collect()}
    assert share[1] > 0.98 and share[0] < 0.2
