import itertools
import math
import random

import pytest

from corpuswright.functions.tokenize import STOPWORDS, USER_WORDS
from corpuswright.operators import retrieval, segmentation
from corpuswright.operators.segmentation import Segmenter, Trie


def brute_path(text, words, listed, unknown):
    """Of all ways to cut a text, the one with most characters in listed words, then the largest weight, then the longest first words."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, now = [], text[0]
        for c, cut in zip(text[1:], cuts):
            if cut:
                parts.append(now)
                now = c
            else:
                now += c
        parts.append(now)
        if any(p not in words and p not in listed and len(p) > 1 for p in parts):
            continue
        weight = 0.0
        for p in reversed(parts):
            weight = (-1.0 if p in listed else words.get(p, unknown)) + weight
        got = (sum(len(p) for p in parts if p in listed), weight, [len(p) for p in parts])
        if best is None or got > best[0]:
            best = (got, parts)
    return best[1]


def test_best_path_against_all_cuts():
    r = random.Random(1)
    for _ in range(60):
        words = {"".join(r.choices("甲乙丙丁", k=r.randrange(1, 4))): -r.choice([1.0, 2.5, 3.0, 4.25]) for _ in range(r.randrange(1, 14))}
        listed = {"".join(r.choices("甲乙丙", k=r.randrange(2, 5))) for _ in range(r.randrange(3))}
        trie = Trie(sorted(words.items()), sorted(listed), unknown=-9.0)
        for _ in range(20):
            text = "".join(r.choices("甲乙丙丁戊", k=r.randrange(1, 10)))
            assert trie.path(text) == brute_path(text, words, listed, -9.0), (text, words, listed)
    assert Trie([]).path("") == [] and Trie([]).path("天地") == ["天", "地"]


def test_listed_words_stay_whole(spark):
    seg = Segmenter(spark, [("家", -1.0), ("庭", -1.0), ("家庭", -0.1), ("照顧", -0.1), ("申請", -2.0), ("可", -3.0)])
    rows = spark.createDataFrame([("家庭照顧者可申請喘息服務與長照需要等級評估ABC12",), (None,), ("",), ("一X二",), ("the 長照", )], "t string")
    got = [r[0] for r in rows.select(seg.tokens(rows.t)).collect()]
    assert {"家庭照顧者", "喘息服務", "長照需要等級", "申請", "abc12"} <= set(got[0]) and "與" not in got[0]
    assert got[1:] == [None, [], ["一", "x", "二"], ["the", "長照"]]
    alone = spark.createDataFrame([(w,) for w in USER_WORDS], "t string")
    assert [r[0] for r in alone.select(seg.tokens(alone.t)).collect()] == [[w] for w in USER_WORDS]
    trie = Trie([(c, -0.5) for c in {c for w in USER_WORDS for c in w}], USER_WORDS)
    assert all(trie.path(w) == [w] for w in USER_WORDS)


def brute_vocabulary(texts, least, cohesion, longest=4):
    import re

    counts = {}
    for t in texts:
        for run in re.findall(r"[一-鿿]+", t or ""):
            for n in range(1, longest + 1):
                for i in range(len(run) - n + 1):
                    counts[run[i : i + n]] = counts.get(run[i : i + n], 0) + 1
    total = sum(n for w, n in counts.items() if len(w) == 1)
    fine = lambda w: len(w) == 1 or (counts[w] >= least and all(counts[w] * total >= cohesion * counts[w[:k]] * counts[w[k:]] for k in range(1, len(w))))
    return {w: (n, round(math.log(n / total), 9)) for w, n in counts.items() if fine(w)}


@pytest.mark.parametrize(("least", "cohesion"), [(1, 1), (3, 2), (5, 10)])
def test_vocabulary_against_brute_force(spark, least, cohesion):
    r = random.Random(least)
    vocabulary = ["天地", "人", "山水", "日月星", "火"]
    texts = ["".join(r.choices([*vocabulary, "，", " x", "木"], k=r.randrange(30))) for _ in range(80)] + [None, "", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {w.word: (w.n, w.weight) for w in segmentation.vocabulary(rows, least=least, cohesion=cohesion).collect()}
    want = brute_vocabulary(texts, least, cohesion)
    assert got.keys() == want.keys() and all(got[w][0] == want[w][0] and abs(got[w][1] - want[w][1]) < 2e-9 for w in want)
    assert segmentation.vocabulary(rows.limit(0)).count() == 0


def test_learned_words_are_found(spark):
    r = random.Random(5)
    words = ["天地", "山水", "日月星", "風雨", "人"]
    texts = ["".join(r.choices(words, k=40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seg = segmentation.learned(docs, cohesion=5)
    got = docs.select("doc_id", seg.tokens(docs.text).alias("t")).collect()
    same = sum(w in words for x in got for w in x.t) / sum(len(x.t) for x in got)
    assert same > 0.95 and all("".join(x.t) == texts[x.doc_id] for x in got)


def test_index_and_questions_use_it(spark):
    docs = spark.createDataFrame([(1, "家庭照顧者可申請補助"), (2, "家庭的照顧者"), (3, "喘息服務的申請")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "家庭照顧者"), (8, "喘息服務")], "query_id long, text string")
    seg = segmentation.learned(docs, least=1)
    found = retrieval.bm25(retrieval.build_index(docs, tokens=seg.tokens), asked)
    assert {(x.query_id, x.doc_id) for x in found.collect()} == {(7, 1), (8, 3)}
    both = retrieval.retrieve(retrieval.Retriever.of(docs, tokens=seg.tokens), asked)
    assert {(x.query_id, x.doc_id) for x in both.lexical.collect()} == {(7, 1), (8, 3)}
    assert {x.doc_id for x in both.dense.filter("query_id = 8 and rank = 1").collect()} == {3}
    assert "的" in STOPWORDS


def test_texts_are_read_once_for_a_vocabulary(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        seen.add(1)
        return t

    rows = spark.createDataFrame([("天地山水" * 5,), ("天地",), ("山水火",)] * 4, "text string")
    got = {w.word: w.n for w in segmentation.vocabulary(rows.select(text("text").alias("text")), cohesion=1).collect()}
    assert seen.value == 12 and got["天地"] == 24 and got["天地山水"] == 20


@pytest.mark.parametrize("starts", [1, 2, 8])
def test_sequences_of_long_runs(spark, starts):
    from collections import Counter

    r = random.Random(starts)
    runs = ["".join(r.choices("天地山水\U00020001", k=k)) for k in (1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 16, 19, 40)]
    want = Counter(x[i : i + n] for x in runs for n in range(1, 5) for i in range(len(x) - n + 1))
    rows = spark.createDataFrame([("a".join(runs),), (None,), ("",), ("abc",)], "text string")
    assert {w.word: w.n for w in segmentation.ngram_counts(rows.text, rows, starts=starts).collect()} == want


def test_batches_of_many_texts(spark):
    seg = Segmenter(spark, [("天地", -0.1)])
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else "天地" * (i % 50) + f" x{i}" for i in range(1500)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    want = [None if t is None else ["天地"] * (i % 50) * (t != "") + ([f"x{i}"] if t else []) for i, t in enumerate(texts)]
    assert [r.w for r in got.select("i", seg.tokens(got.t).alias("w")).orderBy("i").collect()] == want
