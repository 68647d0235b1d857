import math
import random
from collections import Counter

import numpy as np
import pytest

from corpuswright.llm import lmscore


def rows_of():
    r = random.Random(3)
    good, bad = "alpha Beta gamma delta é".split(), "alpha buy now cheap é".split()
    rows = [(i, " ".join(r.choices(good if i % 3 else bad, k=r.randrange(1, 25)))) for i in range(90)]
    return rows + [(200, None), (201, " "), (202, "never seen"), (5, "alpha alpha"), (None, "alpha beta")]


def brute(rows, target, most_words, mu):
    words = [[w.lower() if w.isascii() else w for w in (t or "").split()] for _, t in rows]
    counts = Counter(w for x in words for w in x)
    level = {w: math.floor(16 * math.log2(n)) for w, n in counts.items()}
    vocab = {w for w in counts if sum(x >= level[w] for x in level.values()) <= most_words}
    seqs = [["<s>", *(w if w in vocab else "<unk>" for w in x)] for x in words]
    size = len(vocab) + 2
    tables = []
    for keep in ([i in target for i, _ in rows], [True] * len(rows)):
        one, two = Counter(), Counter()
        for s, k in zip(seqs, keep):
            if k:
                one.update(s)
                two.update(zip(s, s[1:]))
        tables.append((one, two, sum(one.values()) - one["<s>"]))
    mass = tables[0][2]
    out = []
    for (i, _), s in zip(rows, seqs):
        if len(s) == 1:
            out.append((i, 0, None, None))
            continue
        loss = []
        for (one, two, n), scale in zip(tables, (1.0, mass / max(1, tables[1][2]))):
            p = [(two[v, w] * scale + mu * (one[w] * scale + 1) / (mass + size)) / (one[v] * scale + mu) for v, w in zip(s, s[1:])]
            loss.append(-sum(map(math.log, p)) / len(p))
        out.append((i, len(s) - 1, *loss))
    return out


@pytest.mark.parametrize("most_ids", [1000, 3])
def test_against_brute_force(spark, most_ids):
    rows, target = rows_of(), {i for i in range(90) if i % 3 and i < 60}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hit string").repartition(4)
    labels = spark.createDataFrame([(i,) for i in sorted(target)] * 2 + [(None,), (7777,)], "doc_id long")
    models = lmscore.learn(docs, labels, most_words=6, bits=22, mu=5.0, most_ids=most_ids, most_tasks=2)
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lmscore.score(docs, models).collect()), key=repr)
    want = sorted(brute(rows, target, 6, 5.0), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        if w[2] is not None:
            assert np.allclose(g[2:], (w[2], w[3], w[2] - w[3]), atol=1e-5)
    by = {g[0]: g[4] for g in got}
    assert np.mean([by[i] for i in range(60, 90) if i % 3]) < np.mean([by[i] for i in range(60, 90) if not i % 3])


def test_empty_and_no_target(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.score(empty, lmscore.learn(empty, empty, bits=12)).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    got = lmscore.score(docs, lmscore.learn(docs, empty, bits=12)).collect()
    assert len(got) == 2 and all(abs(r.score) < 1e-9 for r in got)


def test_counts_grow_with_the_corpus(spark):
    """More words than a fixed vocabulary held, in the documents learned from and in others."""
    words = [f"w{i}" for i in range(70_000)]
    rows = [(i, " ".join(words[i * 700 : i * 700 + 700] + ["rare", words[i]])) for i in range(100)] + [(100, "alpha beta"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    others = spark.createDataFrame([(1, "w3 w4 rare never w69999"), (None, "beta alpha")], "doc_id long, text string")
    target = {i for i in range(0, 100, 3)}
    models = lmscore.learn(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"), mu=5.0)
    (one, two, n), size = tables_of(rows, target), 70_001 + 2 + 2

    def loss(text, k, scale):
        words = text.split()
        p = [(two[k][v, w] * scale + 5 * (one[k][w] * scale + 1) / (n[0] + size)) / (one[k][v] * scale + 5) for v, w in zip(["<s>", *words], words)]
        return -sum(map(math.log, p)) / len(p)

    for table, texts in ((docs, dict(rows)), (others, {1: "w3 w4 rare never w69999", None: "beta alpha"})):
        got = lmscore.score(table, models).collect()
        assert len(got) == len(texts)
        for r in got:
            if text := texts[r.doc_id]:
                assert np.allclose((r.target_loss, r.background_loss), (loss(text, 0, 1.0), loss(text, 1, n[0] / n[1])), atol=1e-9)


def tables_of(rows, target):
    one, two, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for i, t in rows:
        words = (t or "").split()
        for k in (0, 1) if i in target else (1,):
            one[k].update(["<s>", *words])
            two[k].update(zip(["<s>", *words], words))
            n[k] += len(words)
    return one, two, n


def test_things_that_share_a_key_are_told_apart():
    a = lmscore.Batch()
    for i, t in enumerate(("a b a", "", "b c")):
        a.add(i, i == 2, t.encode().split())
    keys = np.concatenate([np.cumsum(lmscore.unpack(r[2], np.uint64), dtype=np.uint64) for r in a.rows("x", 4, True, True)])
    assert len(keys) == len(set(keys.tolist())) == 3 + 5 and (keys[1:] > keys[:-1]).all()
    order, begin = lmscore.sorting(np.array([7, 7, 3, 7], np.uint64), np.array([2, 1, 5, 2], np.uint16))
    assert begin.tolist() == [0, 1, 2] and lmscore.added(np.array([1, 10, 100, 1000]), order, begin).tolist() == [100, 10, 1001]


def test_a_vocabulary_is_filled_from_the_border_level(spark):
    docs = spark.createDataFrame([("d c b a é",), ("a e",), ("z " * 40,), ("y " * 41,)], "text string")
    assert lmscore.vocabulary(docs, 5) == {b"y": 2, b"z": 3, b"a": 4, b"b": 5, b"c": 6}
    assert lmscore.vocabulary(docs, 1) == {b"y": 2} and len(lmscore.vocabulary(docs, 99)) == 8
    assert lmscore.vocabulary(spark.createDataFrame([("b a c",)], "text string"), 2) == {b"a": 2, b"b": 3}
