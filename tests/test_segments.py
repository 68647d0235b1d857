import glob
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuswright.operators import postings, retrieval
from corpuswright.operators.segments import Segments
from corpuswright.plans.shared import fixed


def rows_of(found):
    return sorted((x.query_id, x.doc_id, x.score, x["rank"]) for x in found.collect())


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_versions_of_a_changing_corpus(spark, tmp_path):
    r = random.Random(1)
    text = lambda: " ".join(f"t{int(r.paretovariate(0.8)) % 40}" for _ in range(r.randrange(12)))
    now = {i: text() for i in range(120)} | {200: None}
    asked = spark.createDataFrame([(q, " ".join(f"t{k}" for k in r.sample(range(40), 4))) for q in range(8)], "query_id long, text string")
    store, wanted, kept = Segments(spark, str(tmp_path)), {}, {}
    for version in ("v1", "v2", "v3"):
        rows = spark.createDataFrame(list(now.items()), "chunk_id long, text string").repartition(3)
        before = files_of(tmp_path / "segments")
        head = store.build(rows, version)
        after = files_of(tmp_path / "segments")
        assert {f: after[f] for f in before} == before  # what stays isn't written again
        assert head["written"] + head["reused"] == len(now)
        fresh = retrieval.bm25(retrieval.build_index(rows, "chunk_id"), asked)
        wanted[version], kept[version] = rows_of(fresh), dict(now)
        assert rows_of(postings.search(store.index(), asked)) == wanted[version]
        assert {x.chunk_id: x.text for x in store.chunks().collect()} == now
        for i in r.sample(sorted(now), 9):
            now[i] = text() + " changed"
        for i in r.sample(sorted(now), 7):
            del now[i]
        now |= {1000 + r.randrange(10_000): text() for _ in range(6)}
    assert len(store.manifest()["segments"]) == 3 and store.manifest()["written"] < 30
    # earlier versions are read from the segments that they had
    assert rows_of(postings.search(store.index("v1"), asked)) == wanted["v1"]
    assert store.rollback()["version"] == "v2" and {x.chunk_id: x.text for x in store.chunks().collect()} == kept["v2"]
    assert rows_of(postings.search(store.index(), asked)) == wanted["v2"]
    store.build(spark.createDataFrame([], "chunk_id long, text string"), "v3")  # is there already
    packed = store.compact("v4")
    assert len(packed["segments"]) == 1 and rows_of(postings.search(store.index(), asked)) == wanted["v3"]
    assert {x.chunk_id: x.text for x in store.chunks().collect()} == kept["v3"]


def test_vectors_are_made_for_changed_texts_only(spark, tmp_path):
    made = []

    def embed(rows):
        made.append(sorted(x.chunk_id for x in rows.collect()))
        return retrieval.hashed_vectors(rows)

    store = Segments(spark, str(tmp_path), embed)
    build = lambda rows, version: store.build(spark.createDataFrame(rows, "chunk_id string, text string"), version)
    build([("a", "x y"), ("b", "y"), ("c", "z")], "1")
    first = {x.chunk_id: x.vector for x in store.chunks().collect()}
    assert build([("a", "x y"), ("b", "other"), ("d", "new")], "2") | {"segments": 0} == {"version": "2", "previous": "1", "segments": 0, "written": 2, "reused": 1, "taken_out": 2}
    assert made == [["a", "b", "c"], ["b", "d"]]
    again = {x.chunk_id: x.vector for x in store.chunks().collect()}
    assert again["a"] == first["a"] and again["b"] != first["b"] and set(again) == {"a", "b", "d"}
    same = build([("a", "x y"), ("b", "other"), ("d", "new")], "3")
    assert (same["written"], same["reused"], len(same["segments"])) == (0, 3, 2) and len(made) == 2
    with pytest.raises(LookupError):
        store.manifest("9")


def test_vectors_are_made_beside_the_texts(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha", "x"), (2, None, "y"), (3, "gamma", "z")], "chunk_id long, text string, hash string")
    got = retrieval.with_vectors(rows)
    assert got.columns == ["chunk_id", "text", "hash", "vector"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {r.chunk_id: r.vector for r in retrieval.hashed_vectors(rows.fillna("", "text")).collect()}
    assert {r.chunk_id: r.vector for r in got.collect()} == want and {r.text for r in got.collect()} == {"alpha beta alpha", None, "gamma"}


def test_files_of_postings_tell_their_ends_without_sorting(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 5}") for i in range(40)], "doc_id long, text string")
    index = postings.build(docs, f"file://{tmp_path}/index", parts=3)
    ends = {tuple(r) for r in index.table("files").select("first", "last").collect()}
    held = index.spark.read.parquet(f"file://{tmp_path}/index/postings").groupBy(F.input_file_name()).agg(F.min("term").alias("a"), F.max("term").alias("b"))
    assert ends == {(r.a, r.b) for r in held.collect()}


def groups_of(files):
    """Rows of each row group of the files."""
    held = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in files]
    return [m.row_group(k).num_rows for m in held for k in range(m.num_row_groups)]


def test_row_groups_stay_small_where_rows_are_large(spark, tmp_path):
    rows = spark.range(0, 24, 1, 1).withColumn("a", F.expr("transform(sequence(1, 500000), x -> cast(rand(7) * 1000000000 as int))"))
    held = groups_of(f.replace("file:///", "/") for f in fixed(rows).inputFiles())
    assert sum(held) == 24 and max(held) <= 6


def test_texts_are_written_in_small_row_groups(spark, tmp_path):
    text = F.expr("array_join(transform(sequence(1, 1500), x -> sha2(cast(id * 1500 + x as string), 256)), '')")
    store = Segments(spark, str(tmp_path))
    store.build(spark.range(0, 600, 1, 1).select(F.col("id").alias("chunk_id"), text.alias("text")), "1")
    held = groups_of(glob.glob(f"{tmp_path}/segments/*/chunks/part-*"))
    assert sum(held) == 600 and max(held) < 400


def test_blocks_are_filled_from_several_batches(spark):
    lists = spark.range(0, 250, 1, 1).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 9 > 0 THEN array(concat('w', id % 7), 'w1', 'w1') END").alias("tokens"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        blocks = retrieval.in_blocks(lists, 64)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = sorted(blocks.collect(), key=lambda r: r.ids)
    assert [len(r.ids) for r in rows] == [64, 64, 64, 58] and [d for r in rows for d in r.ids] == list(range(250))
    assert [n for r in rows for n in r.dls] == [3 * (i % 9 > 0) for i in range(250)]


def test_few_bytes_go_to_python_at_once(spark):
    other = spark.newSession()
    rows = other.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.array(F.expr("repeat('x', 10000)")).alias("tokens"))
    retrieval.in_blocks(rows.limit(1))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])})

    held = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(held) > 24_000_000 and max(held) < 10_000_000
    another = spark.newSession()
    another.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "20m")
    retrieval.in_blocks(another.createDataFrame([(1, ["x"])], "doc_id long, tokens array<string>"))
    assert another.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "20m"
