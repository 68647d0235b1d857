import glob

import numpy as np
import pytest

from corpuswright.operators import retrieval, vectorindex


def table_of(spark, vectors, names=("doc_id", "vector"), kind="long"):
    return spark.createDataFrame([(i if kind == "long" else f"v{i:04}", None if v is None else [float(x) for x in v]) for i, v in vectors], f"{names[0]} {kind}, {names[1]} array<double>")


def rows_of(found):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect())


def clustered(r, n, dim=8, centres=12, spread=0.15):
    c = r.normal(size=(centres, dim))
    return c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_exact_search_equals_the_comparison_with_all(spark, tmp_path, spread):
    r = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(clustered(r, 500, spread=spread))]
    rows += [(900, None), (901, [0.0] * 8), (902, rows[5][1]), (903, 7 * rows[5][1]), (904, [float("nan")] + [1.0] * 7)]
    corpus = table_of(spark, rows).repartition(4)
    asked = table_of(spark, [(i, v) for i, v in rows if i % 50 == 0 and v is not None] + [(5000, [0.0] * 8), (5001, None)], ("query_id", "qvector"))
    index, seen = vectorindex.build(corpus, str(tmp_path / "v")), []
    plain = corpus.filter("doc_id <> 904")
    skip = spread < 1
    want = rows_of(retrieval.dense(plain, asked.filter("query_id < 5000"), skip_self=skip))
    assert rows_of(vectorindex.search(index, asked, skip_self=skip, seen=seen)) == want
    assert rows_of(vectorindex.search(index, asked, skip_self=skip, most_bytes=700, ahead=1)) == want
    pairs, read = seen[0]
    assert read < pairs / 2 if spread < 1 else read <= pairs


def test_probing_reaches_its_recall(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = list(enumerate(clustered(r, 3000, dim=16, centres=60, spread=0.5)))
    corpus = table_of(spark, rows, kind="string")
    asked = table_of(spark, rows[::40], ("query_id", "qvector"), "string")
    index = vectorindex.build(corpus, str(tmp_path / "v"), sample=2000)
    exact, seen = vectorindex.search(index, asked), []
    found = vectorindex.search(index, asked, probes=index.probes, seen=seen)
    recall = vectorindex.recall_of(found, exact).collect()
    assert recall[0].mean_recall >= 0.9 and len(recall) == len(rows[::40]) and 0 <= min(x.recall for x in recall)
    assert seen[0][1] < seen[0][0] / 2


def test_a_common_vector_and_small_tables(spark, tmp_path):
    rows = [(i, [1.0, 0.0]) for i in range(800)] + [(1000 + i, [np.cos(i), np.sin(i)]) for i in range(100)]
    corpus = table_of(spark, rows)
    asked = table_of(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], ("query_id", "qvector"))
    index = vectorindex.build(corpus, str(tmp_path / "a"))
    assert rows_of(vectorindex.search(index, asked)) == rows_of(retrieval.dense(corpus, asked))
    one = vectorindex.build(table_of(spark, [(3, [0.5, 0.5])]), str(tmp_path / "b"))
    assert [x[:2] for x in rows_of(vectorindex.search(one, asked))] == [(0, 3), (1, 3)]
    none = vectorindex.build(table_of(spark, []), str(tmp_path / "c"))
    assert rows_of(vectorindex.search(none, asked)) == [] == rows_of(vectorindex.search(one, asked.limit(0)))


def test_cells_are_folders_and_others_are_not_read(spark, tmp_path):
    r = np.random.default_rng(3)
    index = vectorindex.build(table_of(spark, list(enumerate(clustered(r, 400)))), str(tmp_path / "v"))
    assert len(glob.glob(str(tmp_path / "v/cells/cell=*"))) > 5
    plan = vectorindex._read(index, [1], np.ones((1, 8)), np.arange(len(index.head["cell"]))[None] == 2, "query_id long, doc_id long, score double", 5, False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in text or "cell#" in text.split("PartitionFilters")[1][:60]
