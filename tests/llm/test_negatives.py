import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import negatives


def rows_of(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, score int, key string")


def brute(rows):
    fine = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    own = [(i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in fine]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (aid, av, alab) in enumerate(own):
        if aid is None or aid % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, lab) for b, (i, v, lab) in enumerate(own) if b != a]
        for ps, pid, _ in sorted((x for x in scored if x[2] == alab), key=order)[:5]:
            fit = [x for x in scored if x[2] != alab and 30 * ps <= 100 * x[0] <= 90 * ps]
            out += [(aid, pid, k, nid, ps, ns) for k, (ns, nid, _) in enumerate(sorted(fit, key=order)[:10], 1)]
    return out


def same(got, want):
    key = lambda r: tuple(-1e18 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def unit(r, n=6, ties=False):
    v = [r.choice([-0.5, 0.25, 0.5]) if ties else r.gauss(0, 1) for _ in range(n)]
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("ties", [False, True])
def test_equals_brute_force(spark, monkeypatch, ties):
    monkeypatch.setattr(negatives, "SLICE", 37)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    r = random.Random(4)
    rows = [(i, unit(r, ties=ties), r.randrange(3)) for i in range(450)]
    rows += [(100, unit(r), 1), (200, rows[200][1], rows[200][2]), (300, rows[300][1], 2), (None, unit(r), 1), (None, unit(r), 0)]
    rows += [(500, None, 1), (600, unit(r), None), (501, [1.0, None] * 3, 1), (700, [math.nan] * 6, 1), (502, [math.inf] + [0.0] * 5, 0), (800, [], 1), (503, [], 2)]
    same(negatives.mine(rows_of(spark, rows).repartition(4)).collect(), brute(rows))


def test_blocks_of_anchors_change_nothing(spark):
    r = random.Random(5)
    rows = [(i * 10, unit(r), r.randrange(2)) for i in range(200)]
    table = negatives.usable(rows_of(spark, rows))
    whole, cut = (negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, block_bytes=b) for b in (1 << 20, 300))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) != []


def test_scores_are_exact_at_any_size():
    for top in (3.0, 3e4, 3e8, 3e14):
        r = np.random.default_rng(1)
        a, b = np.floor(r.uniform(-top, top, (3, 8))), np.floor(r.uniform(-top, top, (5, 8)))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert negatives.scores(b, a).tolist() == want
    order = negatives.full_sort(np.array([2**70, 5, 2**70, -1], object), np.array([1, 0, 0, 2]))
    assert order.tolist() == [2, 0, 1, 3]


def test_short_lists_end_in_zeros():
    lists = pa.array([[0.5], [], [1.0, -0.001]], pa.list_(pa.float64()))
    assert negatives.integers(lists).tolist() == [[128, 0], [0, 0], [256, -1]]
    assert negatives.integers(lists.slice(2), 1).tolist() == [[256]]


def test_one_vector_may_be_very_common(spark):
    rows = [(i, [0.5, 0.25] if i % 3 else [0.25, 0.5 + i / 1e4], i % 2) for i in range(3000)]
    got = negatives.mine(rows_of(spark, rows)).collect()
    some = {(a, p) for a, p in {(g.anchor_id, g.positive_id) for g in got} if a in (100, 2900)}
    want = [x for x in brute(rows) if x[0] in (100, 2900)]
    assert some == {(x[0], x[1]) for x in want}
    same([g for g in got if g.anchor_id in (100, 2900)], want)


def test_tables_without_anchors_positives_or_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 2)], [(100, [-1.0], 1), (101, [1.0], 1), (102, [0.5], 2)]):
        assert negatives.mine(rows_of(spark, rows)).collect() == brute(rows) == []
