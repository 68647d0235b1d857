import random

import numpy as np
import pyarrow as pa
import pytest

from corpuswright.operators import retrieval, sentences, vectorindex
from corpuswright.functions import tokenize


def test_a_task_holds_few_scores_at_once(spark, monkeypatch):
    """However many queries there are, a task's matrix of scores is bounded."""
    r = np.random.default_rng(3)
    matrix, largest = r.normal(size=(4096, 4)), []
    kept = retrieval.best_of
    monkeypatch.setattr(retrieval, "best_of", lambda got, *rest: (largest.append(got.size), kept(got, *rest))[1])

    class Sent:
        value = (list(range(1000)), list(r.normal(size=(1000, 4))))

    batch = pa.RecordBatch.from_arrays([pa.array(range(4096)), pa.array(matrix.tolist())], ["doc_id", "vector"])
    rows = pa.Table.from_batches(list(retrieval._nearest(Sent, "cosine", None, 3, True)([batch]))).to_pylist()
    assert max(largest) <= retrieval.CELLS and len(rows) == 3000
    best = {}
    for x in rows:
        best.setdefault(x["query_id"], []).append(x["doc_id"])
    for q in range(0, 1000, 97):
        got = np.round(retrieval.similarities(matrix, Sent.value[1][q], "cosine"), 6)
        got[q] = -9
        assert best[q] == sorted(range(4096), key=lambda d: (-got[d], d))[:3]


def test_index_search_of_many_queries(spark, tmp_path):
    r = random.Random(2)
    corpus = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(600)], "doc_id long, vector array<double>")
    asked = corpus.toDF("query_id", "qvector")
    index = vectorindex.build(corpus, str(tmp_path / "index"), cells=3)
    key = lambda rows: sorted((x.query_id, x.rank, x.doc_id, x.score) for x in rows.collect())
    assert key(vectorindex.search(index, asked, top=4, skip_self=True)) == key(retrieval.dense(corpus, asked, top=4, skip_self=True))


@pytest.mark.parametrize("words", [tokenize.USER_WORDS, ["長照", "長照機構", "照"], ["機構"], []])
def test_listed_words_as_one_tree(spark, words):
    import re

    r = random.Random(len(words))
    pool = [*tokenize.USER_WORDS, "長", "照", "的", "之", "機", "與", "x", "A1", " ", "，"]
    texts = ["".join(r.choices(pool, k=r.randrange(14))) for _ in range(200)]
    flat = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    plain = re.compile((flat + "|" if flat else "") + r"[一-鿿]{1,2}|[a-z0-9]+")
    want = [[w for w in plain.findall(t.lower()) if len(w) > 1 or w not in tokenize.STOPWORDS] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [x.w for x in rows.select("i", tokenize.cjk_tokens(rows.t, words).alias("w")).orderBy("i").collect()] == want
    if len(words) > 9:  # a place where none begins costs one look
        assert tokenize.longest_of(words).count("|") < len(words) and tokenize.longest_of(words).startswith("(?=[")


def test_sentences_in_batches_of_many_texts(spark):
    texts = [None if i % 5 == 0 else f"第{i}條服務之申請應予核准。" * (i % 4) for i in range(700)]
    rows = spark.createDataFrame(list(enumerate(texts)), "answer_id long, text string").coalesce(1)
    got = sentences.sentences(rows).groupBy("answer_id").count().collect()
    assert {x.answer_id: x["count"] for x in got} == {i: i % 4 for i in range(700) if i % 5 and i % 4}
