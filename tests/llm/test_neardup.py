import random
import re

import numpy as np
import pytest

from corpuswright.llm import neardup
from corpuswright.llm.graph import components


def brute(rows, percent=75):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))
        out.append((d, len(sets[i]), c, c == d))
    return out


def corpus(seed, n=300):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgé", k=r.randrange(2, 6)))
    passage = [word() for _ in range(40)]
    base, rows = [[word() for _ in range(r.randrange(6, 150))] for _ in range(25)], []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        rows.append((i, r.choice([" ", "\n", "  "]).join(w).upper() if r.random() < 0.1 else " ".join(w)))
    chain = [word() for _ in range(60)]
    for i in range(20):  # each step keeps its neighbour close, the ends share nothing
        rows.append((1000 + i, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE two"), (2005, "one"), (2006, "one two"), (2006, "one two"), (None, "one two"), (3, "x " * 3)]


def test_superminhash_equals_the_sequential_form():
    sets = [np.unique(neardup.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(77 + n))) for n in (1, 2, 7, 60, 900)]
    sig = neardup.signatures(sets, m=32, block=50)
    for s, got in zip(sets, sig):
        h = [2**64 - 1] * 32
        for e in s.tolist():
            p = list(range(32))
            for j in range(32):
                x = int(neardup.mix(np.array([(e + j * neardup._GOLDEN + 1) % 2**64], np.uint64))[0])
                k = j + ((x >> 32) * (32 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], j << 32 | x & 0xFFFFFFFF)
        assert got.tolist() == h


def test_estimates():
    r = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(20):
            pool = neardup.mix(r.integers(0, 2**63, 400, dtype=np.uint64))
            same = int(200 * share)
            a, b = pool[:200], np.concatenate([pool[:same], pool[200 : 400 - same]])
            s = neardup.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - same / (400 - same))
        assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.15


@pytest.mark.parametrize("most_nodes", [1024, 4])
def test_against_brute_force(spark, most_nodes):
    """Whole buckets and blocks, or grids of them; with one very long text."""
    for seed in (1, 2) if most_nodes > 4 else (3,):
        rows = corpus(seed)
        long = [f"w{k % 9973}" for k in range(60_000)]
        rows += [(3000, " ".join(long)), (3001, " ".join(long[:-50]))]
        docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n_shingles int, kept string").repartition(5)
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, most_nodes=most_nodes).collect()]
        want = [(d, n, c, True if d is None else k) for d, n, c, k in brute(rows)]
        assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("most_nodes", [1024, 4])
def test_large_mixed_bucket(spark, most_nodes):
    """Members that are far from their bucket's first node still find each other."""
    r = random.Random(5)
    w = lambda: f"w{r.randrange(10**6)}"
    common = [w() for _ in range(60)]
    rows = []
    for g in range(12):
        tail = [w() for _ in range(28)]
        for k in range(6):
            t = list(tail)
            t[(5 * k) % 28] = w()
            rows.append((g * 10 + k, " ".join(common + t)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most_nodes=most_nodes).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == sorted(brute(rows))


def test_stage_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f", 9), (2, "a b c d e f", 8), (None, "a b c d e f", 7)], "doc_id long, text string, kept int")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.kept for r in kept.collect()) == [7, 9]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1] or x in got}


def test_dropping_where_ids_repeat(spark):
    r = random.Random(9)
    text = lambda: " ".join("".join(r.choices("abcdefg", k=6)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t + " more"
    rows = [(1, a), (2, near(a)), (2, b), (3, c), (3, near(c)), (4, d), (4, d), (4, e), (5, ""), (5, None), (None, a), (6, near(d))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = sorted(x.k for x in neardup.drop_near_duplicates(docs).collect())
    assert [k for k in got if k not in (3, 4, 5, 6)] == [0, 2, 7, 8, 9, 10]
    assert len({3, 4} & set(got)) == 1 and len({5, 6} & set(got)) == 1 and len(got) == 8


def test_many_copies_of_one_text(spark):
    """A third of all rows in one set, and as many with no set at all."""
    rows = [(i, "the same text for all of these rows and no other") for i in range(50_000)] + [(60_000 + i, None) for i in range(30_000)] + [(100_000 + i, f"a text of its own number{i} and more words {i} here") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = neardup.near_duplicates(docs).groupBy("component_id").count().orderBy("component_id").collect()
    assert (got[0].component_id, got[0]["count"]) == (0, 50_000) and len(got) == 1 + 30_000 + 2000


def test_only_texts_of_candidates_are_dealt_out(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(400)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i] + " end") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(i, i, neardup.set_key(neardup.shingle_set(texts[i]))) for i in range(10)], "node long, doc_id long, set_id binary")
    found = neardup.node_texts(docs, wanted)
    assert {(x.node, x.text) for x in found.collect()} == {(i, texts[i]) for i in range(10)}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = neardup.node_texts(docs, wanted)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("SortMergeJoin") < plan.index("LeftSemi")  # the rows are filtered below the exchange
        assert len(neardup.near_duplicates(docs).filter("not kept").collect()) == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
