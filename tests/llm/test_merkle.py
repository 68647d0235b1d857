import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, at int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes, size=16):
    """The root, and for each node the siblings of each level, left and right."""
    paths, under, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, over = [], []
        for a in range(0, len(level), size):
            run = level[a : a + size]
            for k, _ in enumerate(run):
                for leaf in under[a + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            over.append([i for k in range(len(run)) for i in under[a + k]])
        level, under = up, over
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in names}
    trees = {s: climb([leaf_of(r) for r in ordered[s]]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(ordered[s], trees[s][1]):
            whole = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            at = leaf_of((*r[:4], lower(r[4]))) if tampered else leaf_of(r)
            for left, right in whole:
                at = h(left, at, right)
            out.append((r[0], leaf_of(r), trees[s][0], root, h(*(a + b for a, b in whole)), at, at == root))
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


ODD = [
    (0, "b", "en", 3, "Abc"), (1, "b", None, 3, "Abc"), (2, None, "en", None, None), (3, None, "fr", 0, ""), (None, "b", "en", 1, "Q"), (None, None, None, None, None),
    (7, "é", "de", 5, "Ünï ☃ Z"), (7, "é", "de", 5, "Ünï ☃ Z"), (7, "é", "de", 6, "other"), (-9, "", "en", 1, "X"), (11, "-", "en", 1, "Y"), (12, "z", "en", 1, "LONG Text " * 50_000),
]


@pytest.mark.parametrize("sizes", [{}, {"big": 257}, {"big": 256, "mid": 17, "one": 1, "two": 2, "even": 16}])
def test_equals_a_tree_built_in_place(spark, sizes):
    r = random.Random(3)
    rows = ODD + [(i, name, r.choice(["en", None]), r.randrange(9), "".join(r.choices("abcXYZ ", k=8))) for name, n in sizes.items() for i in r.sample(range(10_000), n)]
    same(merkle.manifest(docs_of(spark, rows).repartition(5)).collect(), brute(rows))


def test_many_groups_make_a_tree_of_their_own(spark):
    rows = [(i, f"s{i % 300}", "en", i, f"Text {i}") for i in range(450)]
    same(merkle.manifest(docs_of(spark, rows)).collect(), brute(rows))


def test_one_row_one_group_and_none(spark):
    for rows in ([(5, "s", "en", 1, "T")], [(5, None, None, None, None)], [(i, "s", "en", 1, "T") for i in range(40)], [(4, "s", "en", 1, "Same")] * 35):
        same(merkle.manifest(docs_of(spark, rows)).collect(), brute(rows))
    assert merkle.manifest(docs_of(spark, [])).collect() == []


def test_a_group_is_numbered_over_several_ranges(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("grp"), F.lit(1).alias("k"), F.col("id").alias("v"))
    got = merkle.numbered(rows.repartition(4), ["k"], "test").select("at", "n").toPandas()
    assert sorted(got["at"]) == list(range(20_000)) and set(got["n"]) == {20_000}
    plan = merkle.numbered(rows.repartition(4), ["v"], "test").orderBy("at").select("v").toPandas()
    assert list(plan["v"]) == list(range(20_000))


def test_no_exchange_holds_a_text(spark):
    docs = docs_of(spark, ODD)
    plan = merkle.manifest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan  # leaves are hashed while the rows are scanned, into a table of hashes
