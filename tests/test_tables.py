import io
import json
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import catalog, citations, sampling, versions, windows
from corpuswright.sources import laws, packages, tables


def test_carried_headings_reset(spark):
    rows = [("p", 0, "A", "before"), ("p", 1, "C", "第一章"), ("p", 2, "A", "x"), ("p", 3, "C", " "), ("p", 4, "A", "y")]
    events = spark.createDataFrame([(p, "法", "", "", "", "", o, t, f"第 {o} 條", c) for p, o, t, c in rows], laws.EVENTS)
    got = laws.extract_articles(events).orderBy("ord").collect()
    assert [(r.article_no, r.chapter) for r in got] == [("0", None), ("2", "第一章"), ("4", None)]


XML = """<?xml version="1.0"?><LAWS UpdateDate="2026/7/10 上午"><法規><法規名稱>甲法</法規名稱><法規網址>http://x?pcode=L1</法規網址><最新異動日期>20200101</最新異動日期><生效日期>20210101</生效日期><生效內容><![CDATA[note
more]]></生效內容>
<法規內容><編章節> 第 一 章 </編章節><條文><條號>第 1 條</條號><條文內容><![CDATA[一
二]]></條文內容></條文><編章節>第二章</編章節><條文><條號>第 2-1 條</條號><條文內容>三</條文內容></條文></法規內容></法規></LAWS>"""
PAGE = """<title> 甲法-全國法規資料庫</title><th>修正日期：</th><td>民國 109 年 1 月 1 日</td><div class="law-reg-content"><div class="h3 char-2"> 第一章 </div>
<div class="col-no"><i class="fa"></i><a name="x" href="?flno=1">第 1 條</a></div><div class="col-data"><div class="law-article"><div class="line-0000">一 &amp; 二</div><div class="line-0004 show">三</div></div>
</div></div></div>"""


def test_packages(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = {"UpdateDate": "2026/7/10", "Laws": [{"LawName": "乙法", "LawURL": "?pcode=L2", "LawModifiedDate": "20200101", "LawArticles": [{"ArticleType": "A", "ArticleNo": "第 1 條", "ArticleContent": "a"}]}, {"LawName": "other", "LawURL": "?pcode=Z", "LawArticles": [{"ArticleType": "A", "ArticleNo": "第 1 條", "ArticleContent": "b"}]}]}
        z.writestr("x.json", b"\xef\xbb\xbf" + json.dumps(body).encode())
    rows = [("json", out.getvalue(), None, None), ("xml", XML.encode(), None, None), ("html", PAGE.encode(), "L3", "2026-07-10")]
    found = laws.events(spark.createDataFrame(rows, "format string, content binary, pcode string, update_date string"))
    kept = laws.wanted(found, spark.createDataFrame([("L1",), ("L2",), ("L3",)], "pcode string"))
    got = [tuple(r) for r in laws.extract_articles(kept).select("pcode", "law_name", "chapter", "article_no", "content", "law_modified_date").orderBy("pcode", "ord").collect()]
    assert got == [("L1", "甲法", "第 一 章", "1", "一\r\n二", "20200101"), ("L1", "甲法", "第二章", "2-1", "三", "20200101"), ("L2", "乙法", None, "1", "a", "20200101"), ("L3", "甲法", "第一章", "1", "一 & 二\r\n三", "20200101")]
    assert {r.source_update_date for r in found.collect()} == {"2026-07-10"}
    meta = {r.pcode: r for r in laws.law_meta(kept).collect()}
    assert (meta["L1"].law_effective_date, meta["L1"].law_effective_note, meta["L1"].article_count, meta["L1"].chapter_count) == ("20210101", "note\r\nmore", 2, 2)
    assert set(laws.extract_articles(kept, "now").columns) - {"ord"} == {"law_name", "pcode", "chapter", "article_no", "content", "url", "law_modified_date", "fetched_at", "source_update_date"}
    assert {r.fetched_at for r in laws.extract_articles(kept, "now").collect()} == {"now"}
    assert laws.load_first([lambda: kept], {"L1": "甲法", "L2": None}).count() == kept.count()
    with pytest.raises(OSError, match="another name"):
        laws.load_first([lambda: kept], {"L1": "丙法"})
    with pytest.raises(OSError, match="without articles"):
        laws.load_first([lambda: kept.filter("article_type = 'C' or pcode <> 'L1'")], ["L1"])

    def broken():
        raise OSError("no network")

    assert laws.load_first([broken, lambda: kept], ["L1", "L2"]).count() == kept.count()
    mixed = kept.withColumn("source_update_date", F.when(F.col("pcode") == "L1", "2020-01-01").otherwise("2026-07-10"))
    with pytest.raises(laws.VersionMismatch):
        laws.load_first([lambda: mixed], ["L1"])
    with pytest.raises(OSError, match="missing"):
        laws.load_first([lambda: kept], ["NONE"])


LAWS = [("L1", "長期照顧服務法"), ("L2", "長期照顧服務法施行細則"), ("D1", "老人福利法")]


def edges(spark, rows):
    laws_ = spark.createDataFrame(LAWS, "pcode string, law_name string")
    articles = spark.createDataFrame([(f"{p}-{n}", p, n, i, c) for i, (p, n, c) in enumerate(rows)], "article_id string, pcode string, article_no string, ord int, content string")
    aliases = citations.alias_table(laws_, "長期照顧服務法", "長期照顧服務")
    found = citations.edges_of(articles, laws_, aliases)
    return [(e.source, e.target) for e in found.orderBy("source", "ord").collect()]


def test_citation_edges(spark):
    assert edges(spark, [("L1", "9", "依第三條至第五條、第七條及第八條之一規定")]) == [("L1-9", f"L1-{n}") for n in ("3", "4", "5", "7", "8-1")]
    assert edges(spark, [("L2", "1", "本法第三條，本細則第二條，老人福利法第四條，第一條")]) == [("L2-1", "L1-3"), ("L2-1", "L2-2"), ("L2-1", "D1-4"), ("L2-1", "D1-1")]
    assert edges(spark, [("L1", "1", "依長期照顧服務法施行細則第二條")]) == [("L1-1", "L2-2")]
    assert edges(spark, [("D1", "8", "x"), ("D1", "8-1", "y"), ("D1", "9", "前條及第八條，自第五條至第四條")]) == [("D1-9", "D1-8"), ("D1-9", "D1-5"), ("D1-9", "D1-4"), ("D1-9", "D1-8-1")]
    assert edges(spark, [("L1", "1", "長期照顧服務法" + "字" * 30 + "第二條")]) == [("L1-1", "L1-2")]


def test_expansion(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, item string, rank int")
    e = spark.createDataFrame([("b", "x", 0), ("a", "b", 1), ("a", "x", 2)] + [("b", f"y{i}", 3 + i) for i in range(9)] + [("a", "gone", 99)], "source string, target string, ord int")
    texts = spark.createDataFrame([(t,) for t in ["a", "b", "x"] + [f"y{i}" for i in range(9)]], "target string")
    got = [(r.target, r.via) for r in citations.expand(hits, e, texts).orderBy("place").collect()]
    assert got == [("x", "a"), ("y0", "b"), ("y1", "b"), ("y2", "b"), ("y3", "b")]


def test_chapter_citations(spark):
    answers = spark.createDataFrame([("a", "好[甲法 第一章總則]\r\n壞[甲法 第九章假的]\n全[甲法 全文]\n無")], "answer_id string, text string")
    chapters = spark.createDataFrame([("a", "甲法", "第一章總則")], "answer_id string, law_name string, chapter string")
    got = citations.verified_paragraphs(answers, chapters).first()
    assert got.text == "好[甲法 第一章總則]\n全[甲法 全文]\n無" and got.removed == 1


def test_versions(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(a, a.split("-")[0], h) for a, h in x], "article_id string, pcode string, hash string")
    v1, v2 = rows(("L-1", "a"), ("L-2", "b"), ("M-1", "c")), rows(("M-1", "c"), ("L-2", "B"), ("L-3", "d"))
    assert {r.article_id: r.status for r in versions.diff(v1, v2).collect()} == {"L-1": "DELETED", "L-2": "CHANGED", "L-3": "NEW", "M-1": "UNCHANGED"}
    assert versions.manifest(v1, "2024").first() == versions.manifest(v1.orderBy(F.desc("article_id")), "2024").first()
    store = versions.Store(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.load()
    first = store.publish(v1, "2024")
    assert first["changed"] and not store.publish(v1, "2024")["changed"] and store.load().count() == 3
    again = store.publish(v1, "2025")
    assert not again["changed"] and again["refreshed"]
    store.publish(v2, "2026")
    assert store.load().filter("hash = 'B'").count() == 1
    store.rollback()
    assert store.load().filter("hash = 'B'").count() == 0 and store.pointer()["version"] == again["version"]
    with pytest.raises(versions.ActivationRefused):
        versions.check_activation("ready", False)
    checks = spark.createDataFrame([("a", True), ("b", False)], "name string, passed boolean")
    assert tuple(versions.readiness(checks).first()) == (False, ["b"])


def test_reuse_and_cache(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "new"), ("c", "z")], "chunk_id string, text string")
    old = spark.createDataFrame([("a", "x", [1.0]), ("b", "old", [2.0])], "chunk_id string, text string, vector array<double>")
    assert {r.chunk_id: r.vector for r in versions.reused(chunks, old).collect()} == {"a": [1.0], "b": None, "c": None}


def test_catalogue(spark):
    articles = spark.createDataFrame([("L", "第 一 章 總則", "1", 0), ("L", "第 一 章 總則", "8-1", 1), ("L", "第二章", "2", 2), ("M", None, "1", 3), ("M", None, "2", 4)], "pcode string, chapter string, article_no string, ord int")
    laws_ = spark.createDataFrame([("L", "甲法", "20210609"), ("M", "乙法", "")], "pcode string, law_name string, law_modified_date string")
    got = {r.pcode: r.text for r in catalog.overview(articles, laws_).collect()}
    assert got["L"] == "《甲法》全文共 3 條（最近修正：民國 110 年 6 月 9 日）。\n\n章節結構：\n・第一章總則：第 1〜8-1 條（共 2 條）\n・第二章：第 2〜2 條（共 1 條）"
    assert got["M"].endswith("本法未分章，條號為第 1〜2 條。")


def test_windows(spark):
    rows = spark.createDataFrame([(i * 3,) for i in range(100)], "id long").repartition(7)
    got = windows.place(rows, "id").collect()
    assert all(r.place == r.id // 3 for r in got) and len(got) == 100
    dup = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 5, "c")], "key string, ord int, v string")
    assert {(r.key, r.v) for r in windows.first_wins(dup, "key", "ord").collect()} == {("k", "a"), ("m", "c")}


def test_windows_over_hot_keys_equal_plain_ones(spark):
    r = random.Random(6)
    rows = [("hot" if i % 3 else r.choice(["a", "b", None]), i // 2, i, r.choice([None, "x", "y"]), r.random() < 0.1) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, t long, id long, v string, h boolean").withColumn("ts", (F.col("t") * 700).cast("timestamp")).repartition(5)
    calls = [
        lambda m: windows.previous(frame, "v", "k", "t", "id", most=m), lambda m: windows.running_sum(frame, F.col("t"), "k", "t", "id", name="s", most=m),
        lambda m: windows.nearest_preceding(frame, F.col("h"), F.col("v"), "k", "t", "id", most=m), lambda m: windows.gap_runs(frame, "ts", 900, "k", "t", "id", most=m),
    ]
    for f in calls:
        one, two = (sorted(map(tuple, f(m).select("id", f(m).columns[-1]).collect())) for m in (10**9, 10))
        assert one == two and len({x[1] for x in one}) > 1
    value, seen = {}, {}
    for k, t, i, v, h in sorted(rows, key=lambda x: (x[1], x[2])):
        value[k] = v if h else value.get(k)
        seen[i] = value[k]
    got = {x.id: x.nearest for x in windows.nearest_preceding(frame, F.col("h"), F.col("v"), "k", "t", "id", most=10).collect()}
    assert got == seen


def test_sampling(spark):
    sizes = spark.createDataFrame([("a", 72), ("b", 58), ("c", 15), ("d", 38), ("e", 22)], "stratum string, n long")
    got = {r.stratum: r.quota for r in sampling.quotas(sizes, 30).collect()}
    assert sum(got.values()) == 30 and min(got.values()) >= 2
    e = spark.createDataFrame([(f"n{i % 9}", f"n{(i * 7 + 1) % 9}") for i in range(40)], "source string, target string").distinct()
    picked = [tuple(r) for r in sampling.disjoint_edges(e, 3).collect()]
    used = [n for p in picked for n in p]
    assert len(used) == len(set(used)) and all(a in used or b in used for a, b in map(tuple, e.collect()) if a != b)
    asked = spark.createDataFrame([("b", "h2", 3), ("a", "h1", 1), ("a!", "h1", 2), ("c", "h3", 4)], "question string, question_hash string, ord int")
    packet = sampling.export_packet(asked, spark.createDataFrame([("h3",)], "question_hash string"))
    assert {(r.item_id, r.question) for r in packet.collect()} == {("Q0001", "a"), ("Q0002", "b")}
    assert [r.variant for r in sampling.specifications(spark.createDataFrame([("x",), ("y",)], "k string"), "k", 5).orderBy("spec_no").collect()] == [1, 1, 2, 2, 3]


def test_json_sources(spark, tmp_path):
    corpus = {"meta": {"laws": [{"pcode": "L", "law_name": "甲法"}]}, "articles": [{"pcode": "L", "article_no": "2"}, {"pcode": "L", "article_no": "1", "chapter": None}]}
    (tmp_path / "c.json").write_text(json.dumps(corpus, indent=1))
    laws_, articles = tables.read_corpus(spark, str(tmp_path / "c.json"))
    assert laws_.first().law_name == "甲法" and [r.article_no for r in articles.orderBy("ord").collect()] == ["2", "1"]
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n\n{"k": \nnot json\n{"k": 2}\n')
    rows = tables.read_lines(spark, str(tmp_path / "l.jsonl"), "k int").collect()
    assert sum(r.malformed for r in rows) == 3 and sum(r.record.k for r in rows if not r.malformed) == 3
    (tmp_path / "r.json").write_text(json.dumps({"human_reviewed": False, "items": [{"id": "1"}]}))
    with pytest.raises(Exception, match="reviewed"):
        tables.read_reviewed(spark, str(tmp_path / "r.json"), "id string").collect()
    nested = spark.createDataFrame([('{"a": [{"question": "q1"}, {"b": {"question": "q\\"2"}}]}',)], "j string")
    assert {r.value for r in tables.json_strings(nested, "j", "question").collect()} == {"q1", 'q"2'}


def test_package_cache(spark, tmp_path, monkeypatch):
    cache = packages.PackageCache(spark, str(tmp_path / "raw"))
    with pytest.raises(OSError, match="not in the cache"):
        cache.newest(["law"])
    cache.put("2026-07-03", {"law": b"old", "order": b"o"})
    cache.put("2026-07-10", {"law": b"new"})
    got = {r.package: (r.date, bytes(r.content)) for r in cache.newest(["law", "order"]).collect()}
    assert got == {"law": ("2026-07-10", b"new"), "order": ("2026-07-03", b"o")}
    with pytest.raises(TypeError):  # the second can't be written, so the first isn't there either
        cache.put("2026-08-01", {"law": b"x", "order": None})
    assert cache.dates() == {"law": ["2026-07-03", "2026-07-10"], "order": ["2026-07-03"]}
    with pytest.raises(ValueError):
        cache.put("yesterday", {})


def test_index_lifecycle(spark, tmp_path):
    rows = lambda h: spark.createDataFrame([("L-1", "L", h)], "article_id string, pcode string, hash string")
    chunks = lambda t: spark.createDataFrame([("c", "L-1", 0, t, [1.0])], "chunk_id string, parent_id string, part int, text string, vector array<double>")
    store = versions.Indexes(spark, str(tmp_path))
    assert store.select("hashed", 64, False) is None and store.active_versions() == (versions.NO_INDEX, versions.NO_LAWS)
    chunks("legacy").write.parquet(f"{tmp_path}/indexes/hashed_64_noctx")
    assert store.select("hashed", 64, False)[0] == versions.NO_INDEX
    v1 = store.publish(rows("a"), "2025")["version"]
    one = store.write(chunks("one"), "i1", v1, "hashed", 64, False)
    store.activate(one, 1.0, True)
    store.publish(rows("b"), "2026")  # newer laws wait until an index of theirs serves
    assert store.load().first().hash == "b" and store.active_laws().first().hash == "a"
    version, found = store.select("hashed", 64, False)
    assert (version, found.first().text) == ("i1", "one") and store.active_versions() == ("i1", v1)
    assert store.select("hashed", 64, True) is None and store.select("hashed", 32, False) is None
    two = store.write(chunks("two"), "i2", store.pointer()["version"], "hashed", 64, False)
    with pytest.raises(versions.ActivationRefused):
        store.activate(two, 0.5, False)
    with pytest.raises(versions.ActivationRefused):
        store.activate(two | {"path": "indexes/none"}, 1.0, True)
    assert store.select("hashed", 64, False)[0] == "i1"
    assert store.activate(two, 1.0, True)["previous_version"] == "i1" and store.active_laws().first().hash == "b"
    (tmp_path / "index.json").write_text("{broken")
    assert store.active_versions() == (versions.UNREADABLE,) * 2 and store.select("hashed", 64, False)[0] == versions.NO_INDEX


def test_pointer_is_never_absent(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path))
    store._write_atomic("active.json", {"v": 0})
    seen, stop = set(), threading.Event()

    def look():
        while not stop.is_set():
            seen.add((tmp_path / "active.json").exists())

    watcher = threading.Thread(target=look)
    watcher.start()
    for v in range(1, 20):
        store._write_atomic("active.json", {"v": v})
    stop.set()
    watcher.join()
    assert seen == {True} and store.pointer() == {"v": 19}


def test_copy_missing(spark, tmp_path):
    for name, text in (("seed/a", "new"), ("seed/b", "new"), ("run/a", "own")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = versions.copy_missing(versions.Store(spark, str(tmp_path)), f"{tmp_path}/seed", f"{tmp_path}/run", ["a", "b", "c"])
    assert got == {"a": "preserved", "b": "copied", "c": "missing"} and (tmp_path / "run/a").read_text() == "own" and (tmp_path / "run/b").read_text() == "new"


def test_references_are_not_moved_with_their_texts(spark):
    """No shuffle carries articles' texts, nor the windows before references."""
    from corpuswright.operators import citations

    filler = "字" * 30
    articles = spark.createDataFrame([("A-1", "A", "1", 1, f"依第3條至第5條{filler}本法第7條"), ("A-2", "A", "2", 2, "依前條規定"), ("A-3", "A", "3", 3, ""), ("B-1", "B", "1", 1, None)], "article_id string, pcode string, article_no string, ord int, content string")
    laws = spark.createDataFrame([("A", "甲法"), ("B", "乙法")], "pcode string, law_name string")
    aliases = spark.createDataFrame([("A", "本法", "B"), ("A", "本細則", "A")], "pcode string, alias string, target string")
    refs = citations.article_references(articles)
    assert [(r.seq, r.no) for r in refs.filter("article_id = 'A-1'").orderBy("seq", "step").collect()] == [(0, "3"), (1, "4"), (1, "5"), (2, "7")]
    assert "Exchange" not in refs._jdf.queryExecution().executedPlan().toString()
    got = {(e.source, e.target) for e in citations.edges_of(articles, laws, aliases).collect()}
    assert got == {("A-1", "A-3"), ("A-1", "A-4"), ("A-1", "A-5"), ("A-1", "B-7"), ("A-2", "A-1")}


def test_citation_metrics_with_nulls_and_repeats(spark):
    from corpuswright.operators import metrics

    said = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (1, None), (2, 12)], "answer_id long, article_id long")
    known = spark.createDataFrame([(10,), (10,), (12,), (None,)], "article_id long")
    gold = spark.createDataFrame([(1, 11), (1, None), (2, 13), (3, 10)], "answer_id long, article_id long")
    got = {r.answer_id: (r.citations, round(r.validity, 6), round(r.correctness, 6)) for r in metrics.citation_metrics(said, known, gold).collect()}
    assert got == {1: (3, round(1 / 3, 6), round(1 / 3, 6)), 2: (1, 1.0, 0.0)}


def test_tasks_grow_with_the_rows(spark):
    from corpuswright.plans.shared import tasks_for

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark.range(10)) == least and tasks_for(spark.range(1000), each=10) == 100


def test_large_tables_are_dealt_to_more_tasks(spark, tmp_path):
    from corpuswright.plans.shared import spread

    slots = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == slots and spread(one, 10).rdd.getNumPartitions() == 100
    spark.range(1000).repartition(slots).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many, 10).rdd.getNumPartitions() == 100 and spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()
