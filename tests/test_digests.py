import hashlib
import json
import random

from pyspark.sql import functions as F

from corpuswright.operators import digests, evaluation, versions


def test_digests_equal_those_of_gathered_lists(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "ü", None]), f"k{r.randrange(10**6)}", r.choice(["x", 'q"uote', "\n", "é"])) for _ in range(500)]
    table = spark.createDataFrame(rows, "g string, k string, v string").repartition(5)
    got = {x.key: (x.n, x.digest) for x in digests.pairs(table, F.col("g"), F.col("k"), F.col("v")).collect()}
    want = {x.g: (x.n, x.d) for x in table.groupBy("g").agg(F.count(F.lit(1)).alias("n"), versions.pair_list_hash(F.col("k"), F.col("v")).alias("d")).collect()}
    assert got == want and len(got) == 4
    plain = hashlib.sha256(json.dumps(sorted([k, v] for g, k, v in rows if g == "ü"), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got["ü"][1] == plain
    assert digests.pairs(table.limit(0), F.col("g"), F.col("k"), F.col("v")).collect() == []


def test_a_key_of_a_million_rows(spark):
    rows = spark.range(1_000_000).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    got = digests.ordered(rows, F.lit("one"), [F.col("k")], F.col("v")).first()
    state = hashlib.sha256()
    for i in range(1_000_000):
        state.update((b"," if i else b"") + hashlib.sha256(str(i).encode()).hexdigest().encode())
    assert (got.n, got.digest) == (1_000_000, state.hexdigest())


def test_manifest_and_dataset_hash(spark):
    articles = spark.createDataFrame([("L-2", "L", "b"), ("L-1", "L", "a"), ("M-1", "M", "c")], "article_id string, pcode string, hash string")
    one = lambda pairs: hashlib.sha256(json.dumps(pairs, separators=(",", ":")).encode()).hexdigest()
    head = versions.manifest(articles, "2024").first()
    assert head.corpus_hash == one([["L", one([["L-1", "a"], ["L-2", "b"]])], ["M", one([["M-1", "c"]])]]) and (head.article_count, head.document_count) == (3, 2)
    assert versions.manifest(articles.limit(0), "2024").first().corpus_hash == one([])
    items = spark.createDataFrame([("b", 2), ("a", 1)], "id string, x int")
    got = evaluation.dataset_hash(items, "id", ["id", "x"]).first()
    want = items.select("id", evaluation.sha256_json({"id": F.col("id"), "x": F.col("x")}).alias("h")).orderBy("id").collect()
    assert got.item_count == 2 and got.dataset_sha256 == hashlib.sha256(",".join(x.h for x in want).encode()).hexdigest()
    assert evaluation.dataset_hash(items.limit(0), "id", ["id"]).first().item_count == 0
