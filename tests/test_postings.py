import math
import os
import random
from collections import Counter

import pytest

from corpuswright.operators import postings, retrieval


def words_of(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, asked, top=20):
    """BM25 of every document for every question, by its definition."""
    lists = [(d, words_of(t)) for d, t in docs]
    n, mean = len(lists), sum(len(w) for _, w in lists) / max(1, len(lists)) or 1
    df = Counter(w for _, ws in lists for w in set(ws))
    out = []
    for q, text in asked:
        want, found = Counter(words_of(text)), []
        for d, ws in lists:
            tf = Counter(ws)
            score = sum(k * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w, k in want.items() if tf[w])
            if round(score, 6) > 0:
                found.append((-round(score, 6), d))
        out += [(q, d, -s, k) for k, (s, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(found):
    return sorted((x.query_id, x.doc_id, x.score, x["rank"]) for x in found.collect())


def same(found, want):
    got = rows_of(found)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


@pytest.mark.parametrize(("size", "ahead"), [(7, 2), (1000, 4)])
def test_equals_the_definition(spark, tmp_path, size, ahead):
    r = random.Random(size + ahead)
    pool = [f"w{int(r.paretovariate(0.7)) % 90}" for _ in range(400)]
    docs = [(i, " ".join(r.choices(pool, k=r.randrange(40)))) for i in range(230)] + [(900, None), (901, ""), (902, "W1 w1, w1"), (902, "w1")]
    asked = [(1, "w1 w2 w3"), (2, "w5 w5 w17"), (3, "none at all"), (4, None), (5, ""), (6, " ".join(f"w{i}" for i in range(90)))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    index = postings.build(table, str(tmp_path / "i"), size=size, parts=6)
    same(postings.search(index, spark.createDataFrame(asked, "query_id long, text string"), ahead=ahead, top=5), brute(docs, asked, 5))


def test_equals_the_forward_index_in_blocks_of_questions(spark, tmp_path):
    r = random.Random(3)
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(f"t{int(r.paretovariate(0.8))}" for _ in range(30))) for i in range(300)], "doc_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(f"t{int(r.paretovariate(0.8))}" for _ in range(6))) for i in range(25)], "query_id string, text string")
    index = postings.build(docs.repartition(3), str(tmp_path / "i"), size=20)
    want = rows_of(retrieval.bm25(retrieval.build_index(docs), asked))
    assert rows_of(postings.search(index, asked, ahead=2)) == want == rows_of(postings.search(index, asked, ahead=2, most_bytes=500))


def test_it_is_read_again_from_its_files(spark, tmp_path):
    docs = [(i, f"common word{i}") for i in range(50)]
    postings.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    index = postings.Postings(spark, [postings.Segment(str(tmp_path / "i"))])
    asked = [(1, "word7 common")]
    same(postings.search(index, spark.createDataFrame(asked, "query_id long, text string")), brute(docs, asked))


def test_blocks_that_cannot_reach_the_best_are_not_scored(spark, tmp_path):
    # in a few blocks the word is frequent, elsewhere it occurs once in a long text
    docs = [(i, "rare rare rare rare" if i < 40 else "rare " + "filler " * (30 + i % 5)) for i in range(2000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = postings.build(table, str(tmp_path / "i"), size=50)
    asked, seen = [(1, "rare")], []
    same(postings.search(index, spark.createDataFrame(asked, "query_id long, text string"), ahead=1, seen=seen), brute(docs, asked))
    (held, scored), = seen
    assert held >= 40 and scored == 1


def test_fewer_bytes_are_read_than_of_the_forward_list(spark, tmp_path):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(60))) for i in range(1500)], "doc_id long, text string")
    path = str(tmp_path / "i")
    index = postings.build(docs, path, parts=32)
    asked = spark.createDataFrame([(1, "abcd hgfe"), (2, "aaaa bbbb")], "query_id long, text string").withColumnRenamed("text", "term")
    terms = spark.createDataFrame([(w,) for w in "abcd hgfe aaaa bbbb".split()], "term string")
    read = sum(os.path.getsize(f.removeprefix("file://").replace("file:", "")) for f in index.files_of(terms)[0])
    lists = retrieval.build_index(docs).lists
    whole = sum(os.path.getsize(f.removeprefix("file://").replace("file:", "")) for f in lists.inputFiles())
    assert len(index.files_of(terms)[0]) <= 4 and read < whole / 4 and asked.count() == 2


def test_an_empty_corpus_and_no_questions(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    index = postings.build(none, str(tmp_path / "e"))
    assert postings.search(index, asked).collect() == []
    index = postings.build(some, str(tmp_path / "s"))
    assert postings.search(index, asked.limit(0)).collect() == [] and len(postings.search(index, asked).collect()) == 1
