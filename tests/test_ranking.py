import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuswright.functions.text import question_hash
from corpuswright.operators import evaluation, evidence, gate, grounding, metrics, mlgate, retrieval, routing
from corpuswright.plans import pipeline, prospective, queries_gate


def test_fusion_order_and_ties(spark):
    lists = spark.createDataFrame([("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 1, "b", 1), ("q", 1, "c", 2), ("p", 0, "x", 1), ("p", 1, "y", 1)], "query_id string, list int, doc_id string, rank int")
    got = [(r.query_id, r.doc_id) for r in retrieval.rrf(lists).orderBy("query_id", "fused_rank").collect()]
    assert got == [("p", "x"), ("p", "y"), ("q", "b"), ("q", "a"), ("q", "c")]
    assert retrieval.rrf(lists.limit(0)).collect() == []


def test_bm25_and_pipeline_of_a_small_corpus(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma delta"), (3, "epsilon")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "alpha gamma"), ("none", "zeta")], "query_id string, text string")
    got = retrieval.bm25(retrieval.build_index(docs), asked).orderBy("rank").collect()
    idf = lambda df: np.log(1 + (3 - df + 0.5) / (df + 0.5))
    tf = lambda f, dl: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / (7 / 3)))
    assert [r.doc_id for r in got] == [2, 1]
    assert got[0].score == pytest.approx(idf(2) * tf(2, 4) + idf(1) * tf(1, 4), abs=1e-6) and got[1].score == pytest.approx(idf(2) * tf(1, 2), abs=1e-6)


def test_dense_blocks_agree(spark):
    r = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(60)], "doc_id long, vector array<float>")
    asked = corpus.filter("doc_id < 7").toDF("query_id", "qvector")
    one = retrieval.dense(corpus, asked, top=4, skip_self=True).orderBy("query_id", "rank").collect()
    assert one == retrieval.dense(corpus, asked, top=4, skip_self=True, most_bytes=300).orderBy("query_id", "rank").collect() and len(one) == 28
    v = {x.doc_id: np.array(x.vector, float) for x in corpus.collect()}
    for score, f in (("cosine", lambda a, b: a @ b / (a @ a * (b @ b)) ** 0.5), ("dot", lambda a, b: a @ b), ("l1", lambda a, b: -abs(a - b).sum())):
        for dim in (None, 3):
            got = retrieval.dense(corpus, asked, score, dim, top=5).collect()
            for q in range(7):
                want = sorted((-round(float(f(x[:dim], v[q][:dim])), 6), d) for d, x in v.items())[:5]
                assert [(-x.score, x.doc_id) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q] == [(pytest.approx(s), d) for s, d in want]
    assert spark.createDataFrame([([3.0, 4.0, 9.0],)], "v array<float>").select(retrieval.truncated(F.col("v"), 2)).first()[0] == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize(("question", "route", "laws"), [
    ("你能回答什麼？", "no_retrieval", []), ("長期照顧服務法施行細則有哪些條文目錄", "structured", ["L0070043"]), ("長照法和老人福利法的差異", "global_or_multi_hop", ["D0050037", "L0070040"]),
    ("這個？", "corrective_candidate", []), ("長照機構的設立要先申請什麼再變更", "global_or_multi_hop", []), ("喘息服務可以用幾天呢", "single_hop", []), ("有哪些條文的規定內容", "single_hop", []),
])
def test_routes(spark, question, route, laws):
    got = spark.createDataFrame([(question,)], "q string").select(routing.route_question(F.col("q")).alias("r")).first().r
    assert got.route == route and sorted(got.matched_pcodes) == laws


def test_required_articles(spark):
    got = spark.createDataFrame([("長照法施行細則第 8 之 1 條與長照法第3條",)], "q string").select(routing.required_articles(F.col("q"))).first()[0]
    assert sorted(got) == ["L0070040-3", "L0070040-8-1", "L0070043-3", "L0070043-8-1"]


def signals(**k):
    base = {"top1_rerank": 0.8, "top1_top2_margin": 0.1, "bm25_dense_overlap_count": 3, "bm25_dense_overlap_jaccard": 0.2, "required_article_coverage": None, "graph_added_required_article": False, "ambiguous_or_multi_hop": False, "evidence_requirement_coverage": None}
    return tuple((base | k).values())


SCHEMA = "top1_rerank double, top1_top2_margin double, bm25_dense_overlap_count int, bm25_dense_overlap_jaccard double, required_article_coverage double, graph_added_required_article boolean, ambiguous_or_multi_hop boolean, evidence_requirement_coverage double"
CASES = [
    ({}, "answer", "answer"), ({"top1_rerank": None}, "refine_once", "refuse"), ({"top1_rerank": 0.5}, "refine_once", "refuse"), ({"top1_rerank": 0.65}, "refine_once", "answer"),
    ({"top1_top2_margin": 0.001}, "refine_once", "answer"), ({"bm25_dense_overlap_count": 0, "bm25_dense_overlap_jaccard": 0.0}, "refine_once", "refuse"), ({"required_article_coverage": 0.0}, "refine_once", "refuse"),
    ({"required_article_coverage": 0.5}, "refine_once", "answer"), ({"evidence_requirement_coverage": 0.5}, "refine_once", "refuse"), ({"ambiguous_or_multi_hop": True}, "refine_once", "answer"), ({"top1_top2_margin": None}, "answer", "answer"),
]


def test_gate_truth_table(spark):
    rows = spark.createDataFrame([signals(**c) for c, _, _ in CASES], SCHEMA).coalesce(1)
    got = rows.select(gate.grade(F.col, F.lit(0))["decision"].alias("a"), gate.grade(F.col, F.lit(1))["decision"].alias("b"), gate.grade(F.col, F.lit(1))["rules_triggered"].alias("r")).collect()
    assert [(g.a, g.b) for g in got] == [(a, b) for _, a, b in CASES]
    assert got[0].r == ["strong_top1"] and got[1].r == ["missing_reranker_score"] and "partial_explicit_article_coverage" in got[7].r


def test_coverage_is_null_without_requirements(spark):
    rows = spark.createDataFrame([([], ["a"], []), (["a", "b", "b"], ["a"], ["b"]), (["z"], ["a"], [])], "req array<string>, direct array<string>, graph array<string>").coalesce(1)
    got = rows.select(*[c.alias(k) for k, c in gate.covered_signals(F.col("req"), F.col("direct"), F.col("graph")).items()]).collect()
    assert [tuple(g) for g in got] == [(None, False), (1.0, True), (0.0, False)]
    top = spark.createDataFrame([(0, 0.9), (3, None), (3, 0.6), (3, 0.7)], "n int, s double").coalesce(1)
    assert [r[0] for r in top.select(gate.refuse_before_generation(F.col("n"), F.col("s"))).collect()] == [True, False, True, False]


def test_evidence(spark):
    rows = spark.createDataFrame([("誰可以申請？", [("A-1", "失能者得申請"), ("A-2", "x")], ["A-2", "Z-9"]), ("你好", [], [])], "question string, rows array<struct<article_id: string, text: string>>, required array<string>").coalesce(1)
    hop = F.struct(F.lit("global_or_multi_hop").alias("route"), F.lit("citation_graph").alias("handler"))
    single = F.struct(F.lit("single_hop").alias("route"), F.lit(None).cast("string").alias("handler"))
    plan = lambda r: rows.select(evidence.evidence_plan(F.col("question"), r, F.col("required"), F.col("rows")).alias("p")).collect()
    a, b = plan(hop)
    assert [(q.requirement_id, q.satisfied_article_ids) for q in a.p.requirements] == [("explicit:A-2", ["A-2"]), ("explicit:Z-9", []), ("facet:eligibility", ["A-1"]), ("facet:application", ["A-1"])]
    assert a.p.coverage == 0.75 and [q.requirement_id for q in b.p.requirements] == ["facet:unresolved_second_hop"] and b.p.coverage == 0
    a, b = plan(single)
    assert a.p.coverage == 0.5 and b.p.coverage is None and b.p.strategy == "no_additional_requirements"


def test_metrics(spark):
    rows = pd.DataFrame({"label": [True, True, False, False, True], "risk": [0.9, 0.4, 0.35, 0.1, 0.36]})
    frame = spark.createDataFrame(rows)
    best = metrics.threshold_search(frame, "label", "risk", 1.0).first()
    assert (best.threshold, best.recall, best.accuracy) == (0.36, 1.0, 1.0)
    got = metrics.binary_metrics(frame, F.col("label"), F.col("risk") >= 0.38).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.recall) == (2, 0, 1, 2, 2 / 3)
    assert metrics.binary_metrics(frame.limit(0), F.col("label"), F.col("risk") > 1).first().accuracy is None
    empty = metrics.confusion(frame.limit(0).selectExpr("'a' e", "'b' p"), "e", "p", ["a", "b"]).collect()
    assert [(r.a, r.b, r.accuracy) for r in empty] == [(0, 0, None)] * 2
    sep = metrics.score_separation(frame, F.col("label"), F.col("risk")).first()
    assert sep.separable and sep.threshold == pytest.approx(0.355)


def test_linear_gate(spark):
    r = np.random.default_rng(2)
    rows = pd.DataFrame(r.normal(size=(80, 12)), columns=list(gate.FEATURES))
    rows["label"], rows["id"] = rows["top1_rerank"] < 0, range(80)
    rows["top1_rerank"] += np.where(rows["label"], -2, 2)
    frame = spark.createDataFrame(rows)
    model = mlgate.train(frame)
    risks = mlgate.LinearGate.from_json(model.to_json()).score(frame).select("label", "risk").collect()
    assert all((x.risk > 0.8) == x.label for x in risks) and model.positive_count == int(rows["label"].sum())
    with pytest.raises(ValueError, match="40"):
        mlgate.train(frame.limit(20))
    with pytest.raises(ValueError, match="both"):
        mlgate.train(frame.filter("label").unionByName(frame.filter("label")))
    folds = mlgate.out_of_fold(frame, "id", epochs=200)
    assert folds.count() == 80 and {r.fold for r in folds.collect()} == set(range(5)) and mlgate.evaluate(folds).first().accuracy > 0.9


def test_out_of_fold_scores_all_rows(spark, tmp_path):
    """The fit is bounded, what is scored and evaluated isn't."""
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"id": range(2500), "x": r.normal(size=2500)})
    rows["label"] = rows["x"] + r.normal(size=2500) / 2 > 0
    frame = spark.createDataFrame(rows)
    for most in (300, 10_000):
        risks = mlgate.out_of_fold(frame, "id", ("x",), epochs=200, most=most)
        got = mlgate.evaluate(risks).first()
        assert got["count"] == 2500 and got.tp + got.fp + got.fn + got.tn == 2500 and got.accuracy > 0.8
    by = {x.id: x.risk for x in risks.collect()}
    for fold in range(5):
        rest, own = rows[rows["id"] % 5 != fold], rows[rows["id"] % 5 == fold]
        b, w, mean, scale = mlgate.fitted(rest[["x"]].to_numpy(), rest["label"].to_numpy(float), epochs=200)
        assert np.allclose([by[i] for i in own["id"]], 1 / (1 + np.exp(-(b + (own["x"] - mean[0]) / scale[0] * w[0]))))
    spark.range(2500).selectExpr("id AS doc_id", "id % 9000 AS n_chars", "'a' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2500).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 3 = 0 AS int) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries_gate.ml_train_eval(spark, str(tmp_path)).first()["count"] == 2500


def test_grounding(spark):
    said = spark.createDataFrame([("a", 0, 1, "甲。"), ("a", 0, 2, "乙。"), ("a", 2, 3, "丙。"), ("b", 0, 1, "丁。")], "answer_id string, para int, sentence_no int, sentence string")
    replies = spark.createDataFrame([("a", '```json\n[{"index":1,"supported":true,"context_no":1},{"index":2,"supported":true,"context_no":9},{"index":3,"supported":false},{"index":3,"supported":true,"context_no":1}]```'), ("b", "no json")], "answer_id string, reply string")
    contexts = spark.createDataFrame([("a", 1, "L §1"), ("b", 1, "L §1")], "answer_id string, context_no int, article string")
    v = grounding.reconciled(said, grounding.parsed_verdicts(replies), contexts)
    got = {r.answer_id: (r.final_text, r.removed_count) for r in grounding.applied(said.select("answer_id").distinct(), v).collect()}
    assert got == {"a": ("甲。\n丙。", 1), "b": (grounding.REFUSAL_TEXT, 1)}
    q = lambda reply: spark.createDataFrame([("問題", "前次查詢", reply)], "a string, b string, c string").select(grounding.refined_query(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert q("以下是查詢：\n- 修正後查詢：長照機構設立許可") == "長照機構設立許可" and q("這是回答。完整句子。") == "問題 前次查詢" and q(None) == "前次查詢"


def test_answer_batch(spark):
    articles = spark.createDataFrame([(1, "L-1", "甲法", "1", "長照機構 設立 許可 應向主管機關申請。"), (2, "L-2", "甲法", "2", "喘息服務 給付 額度 依規定辦理。")], "doc_id long, article_id string, law_name string, article_no string, text string")
    edges = spark.createDataFrame([("L-1", "L-2", 0)], "source string, target string, ord int")
    asked = spark.createDataFrame([("meta", "你是誰啊請問"), ("hit", "長照機構 設立 許可"), ("miss", "zzz yyy xxx")], "query_id string, text string")
    corpus = pipeline.Corpus.of(articles, edges)
    got = {r.query_id: r for r in pipeline.answer_batch(asked, corpus, mode="confidence_gate_only").collect()}
    assert got["meta"].route == "no_retrieval" and got["meta"].decision is None and got["meta"].final_text == "handled by meta_response"
    assert got["hit"].decision == "answer" and got["hit"].final_text.startswith("長照機構") and "許可" in got["hit"].final_text
    assert got["miss"].served == "refuse" and got["miss"].final_text == grounding.REFUSAL_TEXT and got["miss"].retrieval == got["miss"].retrieval[:5]
    with pytest.raises(ValueError, match="mode"):
        pipeline.answer_batch(asked, corpus, mode="else")


def test_one_refinement(spark):
    """A question that the first retrieval doesn't answer is retrieved once more with the refined query, and only then served or refused."""
    articles = spark.createDataFrame([(1, "L-1", "甲法", "1", "喘息服務 給付 額度 依規定辦理 不得超過。"), (2, "L-2", "甲法", "2", "完全 無關 內容 其他 事項。")], "doc_id long, article_id string, law_name string, article_no string, text string")
    asked = spark.createDataFrame([("q", "休息 補貼 上限 多少"), ("z", "沒有 答案 的 問題")], "query_id string, text string")
    replies = spark.createDataFrame([("q", "喘息服務 給付 額度")], "query_id string, reply string")
    corpus = pipeline.Corpus.of(articles, spark.createDataFrame([], "source string, target string, ord int"))
    # the scorer stands for a model that knows which article answers which question
    scorer = lambda question, text: F.when(question.startswith("休息") & text.startswith("喘息"), 3.0).otherwise(-1.0)
    run = lambda mode, **k: {r.query_id: r for r in pipeline.answer_batch(asked, corpus, mode=mode, scorer=scorer, **k).collect()}
    got = run("refinement_enabled", replies=replies)
    assert (got["q"].refinement_count, got["z"].refinement_count) == (1, 1) and got["z"].served == "refuse"
    assert "no_lexical_semantic_overlap" not in got["q"].rules_triggered and got["q"].served == "answer" and got["q"].final_text.startswith("喘息服務")
    before = run("confidence_gate_only", replies=replies)
    assert before["q"].decision == "refine_once" and before["q"].served == "refuse" and before["q"].refinement_count == 0
    assert "no_lexical_semantic_overlap" in before["q"].rules_triggered
    plain, shadow = run("current_baseline"), run("current_baseline", shadow=True, replies=replies)
    assert {k: (r.served, r.final_text) for k, r in plain.items()} == {k: (r.served, r.final_text) for k, r in shadow.items()}
    s = shadow["q"].shadow_adaptive
    assert s.refinement_executed and s.initial_gate.decision == "refine_once" and s.final_gate.decision == "answer" and plain["q"].shadow_adaptive is None
    rewrites = spark.createDataFrame([("q", "喘息服務 給付")], "query_id string, rewritten string")
    assert run("confidence_gate_only", rewrites=rewrites)["q"].retrieval[0] == "L-1"


def test_ids_of_questions_and_documents_are_apart(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (9, None)], "query_id long, qvector array<double>")
    assert [(r.query_id, r.doc_id, r.score) for r in retrieval.dense(corpus, asked).orderBy("rank").collect()] == [(1, 1, 1.0), (1, 2, 0.0)]
    assert [r.doc_id for r in retrieval.dense(corpus, asked, skip_self=True).collect()] == [2]
    assert retrieval.dense(corpus.limit(0), asked).count() == retrieval.dense(corpus, asked.limit(0)).count() == 0


def test_queries_of_a_question(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "other words")], "doc_id long, text string")
    queries = spark.createDataFrame([("q", 0, " alpha "), ("q", 1, "alpha"), ("q", 2, ""), ("q", 3, "gamma"), ("e", 0, " ")], "query_id string, ord int, text string")
    assert [(r.query_id, r.place, r.text) for r in retrieval.variants(queries).orderBy("place").collect()] == [("q", 0, "alpha"), ("q", 1, "gamma")]
    found = retrieval.retrieve_multi(retrieval.Retriever.of(docs), queries)
    assert {r.list for r in found.lists.collect()} == {0, 1, 2, 3} and {r.query_id for r in found.fused.collect()} == {"q"}
    best = {r.doc_id: r for r in found.fused.collect()}
    assert best[1].bm25_rank == best[2].bm25_rank == 1 and best[3].bm25_score is None and best[1].dense_score > 0.5


def test_containing(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abc"), 2))
    docs = [(i, " ".join(word() for _ in range(rng.integers(0, 40)))) for i in range(60)] + [(99, None), (98, "")]
    items = []
    for i in range(40):
        body = docs[rng.integers(0, 60)][1]
        a = rng.integers(0, max(1, len(body)))
        items.append((i, body[a : a + rng.integers(0, 40)]))
    items += [(50, None), (51, ""), (52, "zz zz zz"), (53, "a\tb c d")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, j) for i, t in items for j, b in docs if t is not None and b is not None and t in b)
    for most in (200_000, 1):
        assert sorted(map(tuple, retrieval.containing(d, q, most=most).collect())) == want
    assert retrieval.containing(d, q.limit(0)).count() == 0


def test_datasets_keep_their_rules(spark):
    known = spark.createDataFrame([("old question",)], "q string").select(question_hash(F.col("q")).alias("question_hash"))
    rows = [(i, None, f"question {i}", None, "s") for i in range(1, 6)]
    frame = lambda r: spark.createDataFrame(r, "ord int, id string, question string, source string, stratum string")
    packet = evaluation.prepare_packet(frame(rows), known, least=5).orderBy("id").collect()
    assert packet[0].id == "prod-0001" and packet[0].source == "anonymized_production"
    for bad, what in (([(6, None, " OLD  question", None, None)], "overlaps"), ([(6, None, " ", None, None)], "empty"), ([(6, None, "Question 1", None, None)], "duplicate")):
        with pytest.raises(evaluation.DatasetError, match=what):
            evaluation.prepare_packet(frame(rows + bad), known, least=5)
    with pytest.raises(evaluation.DatasetError, match="at least 100"):
        evaluation.prepare_packet(frame(rows), known)
    item = ("a", "q", "single_hop", True, True, "me", ["A-1"])
    marked = lambda *r: spark.createDataFrame(r, "id string, question string, expected_route string, answerable boolean, reviewed boolean, reviewer string, expected_article_ids array<string>")
    head = evaluation.freeze(marked(item, ("b", *item[1:])), least=2)[1].first()
    assert head.item_count == 2 and head.dataset_sha256 == evaluation.freeze(marked(("b", *item[1:]), item), least=2)[1].first().dataset_sha256
    for k, value, what in ((2, "x", "expected_route"), (3, None, "answerable"), (4, False, "review"), (5, "", "review"), (6, None, "expected_article_ids"), (6, [], "articles_needed")):
        with pytest.raises(evaluation.DatasetError, match=what):
            evaluation.freeze(marked((*item[:k], value, *item[k + 1 :])), least=1)
    fine = {"split": "holdout", "locked": True, "represents_production_distribution": False, "dataset_sha256": "h"}
    evaluation.verify_dataset(fine, "h", "holdout")
    for change in ({"locked": False}, {"split": "calibration"}, {"represents_production_distribution": True}, {"evaluation_validity": "invalid: leak"}, {"dataset_sha256": "g"}):
        with pytest.raises(evaluation.DatasetError):
            evaluation.verify_dataset(fine | change, "h", "holdout")


def test_calibration_and_adoption(spark):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"id": range(120), "x": rng.normal(size=120), "expected_route": "a", "actual_route": "a"})
    rows["needs_correction"], rows["rule_activates"] = rows["x"] > 0, (rows["x"] > 0) | (rng.random(120) < 0.5)
    frame = spark.createDataFrame(rows)
    model, threshold = prospective.calibrate(frame, ("x",), epochs=300)
    got = prospective.judged(model.score(frame), "risk", threshold).first()
    assert got.adopted and got.rule.recall == 1.0 and got.candidate.recall == 1.0 and got.candidate.false_activation_rate < got.rule.false_activation_rate
    assert not prospective.judged(frame.withColumn("risk", F.lit(1.0)), "risk", 0.5).first().adopted
    spent = prospective.read_once({"adoption_state": "pending_holdout", "cycle_id": "c"}, "c")
    for artifact, cycle in ((spent, "c"), ({"adoption_state": "pending_holdout", "cycle_id": "c"}, "d")):
        with pytest.raises(prospective.HoldoutSpent):
            prospective.read_once(artifact, cycle)


@pytest.mark.parametrize("most", [10**9, 5])
def test_percentiles_of_hot_groups(spark, most):
    r = np.random.default_rng(4)
    rows = pd.DataFrame({"k": np.where(r.random(30_000) < 0.9, "hot", "b"), "v": np.round(r.normal(size=30_000), 2)})
    rows = pd.concat([rows, pd.DataFrame({"k": ["one", "two", "two"], "v": [7.0, 1.0, 2.0]})])
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(x.k, x.q): (x.linear, x.nearest) for x in metrics.group_percentiles(spark.createDataFrame(rows).repartition(4), "k", "v", qs, most=most).collect()}
    for k, part in rows.groupby("k"):
        v = np.sort(part["v"].to_numpy())
        for q in qs:
            assert got[k, q][0] == pytest.approx(np.percentile(v, q * 100)) and got[k, q][1] == v[max(0, int(np.ceil(q * len(v))) - 1)]
    assert len(got) == 4 * len(qs)


def test_training_where_the_rows_are(spark):
    """Summed gradients give what the driver's fit gives, and no number of rows is refused."""
    r = np.random.default_rng(5)
    rows = pd.DataFrame(r.normal(size=(10_000, 3)) * [1, 5, 0.1] + [0, 3, 9], columns=["a", "b", "c"])
    rows["label"] = (rows["a"] + rows["b"] / 5 + r.normal(size=len(rows)) > 0.6).astype(float)
    frame = spark.createDataFrame(rows).repartition(4)
    plain, dealt = (mlgate.train(frame, ("a", "b", "c"), most=most, epochs=60) for most in (10_000, 9_999))
    assert abs(plain.intercept - dealt.intercept) < 1e-6 and all(abs(plain.coefficients[f] - dealt.coefficients[f]) < 1e-6 for f in "abc")
    assert (plain.training_count, plain.positive_count) == (dealt.training_count, dealt.positive_count)
    b, w, _, _ = mlgate.descended(frame.limit(60).withColumn("__y", frame.label), ("a",), epochs=100, near=10.0)  # ends at once
    assert len(w) == 1


def test_questions_may_have_an_embedder_of_their_own(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "ALPHA?beta")], "query_id long, text string")
    seen = []

    def of_questions(rows):
        seen.append([r.text for r in rows.collect()])
        return retrieval.hashed_vectors(rows.withColumn("text", F.lit("gamma delta")))

    plain = retrieval.retrieve(retrieval.Retriever.of(docs), asked).dense.filter("rank = 1").first()
    other = retrieval.retrieve(retrieval.Retriever.of(docs, embed_question=of_questions), asked).dense.filter("rank = 1").first()
    assert (plain.doc_id, other.doc_id) == (1, 2) and seen == [["ALPHA?beta"]]


def test_strategies_share_one_search_of_each_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "other words")], "doc_id long, text string")
    asked = lambda *texts: spark.createDataFrame([("q", i, t) for i, t in enumerate(texts)], "query_id string, ord int, text string")
    searched, bm25 = [], retrieval.bm25

    def counted(index, questions, **k):
        searched.append(questions.count())
        return bm25(index, questions, **k)

    monkeypatch.setattr(retrieval, "bm25", counted)
    gold = spark.createDataFrame([("q", 2)], "query_id string, doc_id long")
    strategies = {"one": asked("alpha"), "both": asked("alpha", "gamma"), "none": asked("").limit(0)}
    got = {r.strategy: (r.hits, r.queries) for r in evaluation.strategy_hits(retrieval.Retriever.of(docs.filter("doc_id < 3")), docs, asked("alpha"), strategies, gold).collect()}
    assert searched == [2] and got["none"] == (0, 1) and got["both"] == (1, 1)


def test_index_keeps_a_word_once_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "c"), (4, "a c a a")], "doc_id long, text string").coalesce(1)
    index = retrieval.build_index(docs)
    blocks = index.blocks.collect()
    assert sorted(i for b in blocks for i in b.ids) == [1, 2, 3, 4] and all(len(set(b.words)) == len(b.words) for b in blocks)
    found = {(b.ids[p], b.words[k], n) for b in blocks for k, (lo, hi) in enumerate(zip([0, *b.ends], b.ends)) for p, n in zip(b.places[lo:hi], b.tfs[lo:hi])}
    assert found == {(1, "b", 2), (1, "a", 1), (3, "c", 1), (4, "a", 3), (4, "c", 1)} and tuple(index.totals.first()) == (4.0, 2.0)
    assert {(r.doc_id, tuple(sorted(r.tokens)), r.dl) for r in index.lists.collect()} == {(1, ("a", "b", "b"), 3), (2, (), 0), (3, ("c",), 1), (4, ("a", "a", "a", "c"), 4)}
    vectors = {r.chunk_id: r.vector for r in retrieval.indexed_vectors(index).collect()}
    assert vectors == {r.chunk_id: r.vector for r in retrieval.hashed_vectors(docs.toDF("chunk_id", "text")).collect()}


def test_a_reply_is_read_once(spark):
    replies = spark.createDataFrame([("a", '```json\n[{"index": 1, "supported": true}, {"index": 1, "supported": false}]\n```'), ("b", "nothing"), ("c", None)], "answer_id string, reply string")
    got = grounding.parsed_verdicts(replies)
    assert [(r.answer_id, r["index"], r.supported) for r in got.collect()] == [("a", 1, False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract") == 1
