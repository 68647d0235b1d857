import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import trace
from corpuswright.plans import settings, shared
from corpuswright.streaming import events as streams

RECORDS = [
    {"run_id": "1", "completed_at": "2024-01-02T00:00:00+00:00", "latency_ms": {"total": 10.0}, "token_usage": {"total_tokens": 100, "by_stage": {"gen": {"total_tokens": 100}}}, "grounding": {"removed_count": 2}, "final_status": "answered", "privacy": {"pii_redacted": True},
     "shadow_adaptive": {"initial_gate": {"decision": "refine_once"}, "final_gate": {"decision": "answer"}, "refinement_executed": True, "latency_ms": {"total": 5.0}, "token_usage": {"total_tokens": 7, "by_stage": {"gen": {"total_tokens": 7}}}}},
    {"run_id": "2", "started_at": "2024-01-01T12:00:00", "latency_ms": {"total": 30.0}, "grounding": {"removed_count": -1}, "final_status": "error"},
    {"run_id": "3", "started_at": "soon"},
]


def frame(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, RECORDS)))
    return spark.read.schema(trace.TRACE).json(str(tmp_path / "t.jsonl"))


def test_summary(spark, tmp_path):
    s = trace.summary(frame(spark, tmp_path)).first()
    assert (s.record_count, s.p50, s.tokens, s.tokens_per_trace, s.removed_sentences, s.traces_with_removals) == (3, 20.0, 100, 33.33, 2, 1)
    assert (s.shadow_count, s.would_activate_rate, s.rescues, s.rescue_rate, s.additional_tokens, s.redacted, s.without_privacy) == (1, 1.0, 1, 1.0, 7, 1, 2)
    assert s["first"] == dt.datetime(2024, 1, 1, 12) and s["last"] == dt.datetime(2024, 1, 2)
    assert {r.stage: r.total_tokens for r in trace.stage_tokens(frame(spark, tmp_path)).collect()} == {"gen": 100, "shadow.gen": 7}
    assert {r.category: r.n for r in trace.counted(frame(spark, tmp_path), F.col("final_status"), "unknown").collect()} == {"answered": 1, "error": 1, "unknown": 1}


def test_retention_and_writing(spark, tmp_path):
    t = frame(spark, tmp_path)
    kept = trace.retained(t, trace.moment(F.col("completed_at"), F.col("started_at")), F.lit("2024-01-01T18:00:00Z").cast("timestamp"))
    assert sorted(r.run_id for r in kept.collect()) == ["1", "3"]
    trace.write(t, str(tmp_path / "out"), sample_rate=0.0)
    assert [r.run_id for r in spark.read.json(str(tmp_path / "out")).collect()] == ["2"]
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    share = ids.filter(trace.sampled(F.col("k"), 0.25)).count() / 4000
    assert 0.2 < share < 0.3


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=13 * i * (i % 7)), i % 3, "view", float(i)) for i in range(200)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    # one late event closes every earlier window
    last = spark.createDataFrame([(999, dt.datetime(2025, 1, 1), 99, "view", 0.0)], rows.schema)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for name, f in (("w", streams.windowed), ("s", streams.sessions)):
        stream = streams.read_stream(spark, str(tmp_path / "in"), rows.schema)
        streams.to_table(f(stream), str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination(120)
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()}
        want = {tuple(r) for r in f(batch).collect()}
        assert got == {w for w in want if "2025" not in str(w)}
    stream = streams.read_stream(spark, str(tmp_path / "in"), rows.schema)
    for _ in range(2):  # the second run finds nothing new
        streams.append(stream, str(tmp_path / "a"), str(tmp_path / "a-ck"), 0.5).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "a")).count() == batch.filter(trace.sampled(F.col("event_id").cast("string"), 0.5)).count()


def test_redaction_at_any_depth(spark):
    mail = "a.b@c.org"
    rows = spark.createDataFrame([(mail, [mail, None], {"k": mail}, (mail, [(mail, 7)], None), 5, mail)], "s string, a array<string>, m map<string, string>, t struct<x: string, y: array<struct<z: string, n: int>>, u: struct<v: string>>, n int, kept string")
    got = trace.redacted_all(rows, ("kept",))
    assert got.schema.simpleString() == rows.schema.simpleString()
    r = got.first()
    assert (r.s, r.a, r.m, r.t.x, r.t.y[0].z, r.t.y[0].n, r.t.u, r.n, r.kept) == ("[EMAIL]", ["[EMAIL]", None], {"k": "[EMAIL]"}, "[EMAIL]", "[EMAIL]", 7, None, 5, mail)


def test_grounding_log_and_spans(spark, tmp_path):
    answers = spark.createDataFrame([("a", "q", "x y", "x"), ("b", "q2", "", "")], "answer_id string, question string, original_text string, final_text string")
    verdicts = spark.createDataFrame([("a", 2, "y", False, None, "no"), ("a", 1, "x", True, "L-1", "")], "answer_id string, sentence_no int, sentence string, supported boolean, article string, reason string")
    log = trace.grounding_log(answers, verdicts, "local")
    assert trace.append(log, str(tmp_path / "log")) and trace.append(log, str(tmp_path / "log"))
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert len(rows) == 4 and {r.question: (r.removed_count, [v.sentence for v in r.verdicts or []]) for r in rows} == {"q": (1, ["x", "y"]), "q2": (0, [])}
    (tmp_path / "file").write_text("x")
    assert not trace.append(log, str(tmp_path / "file" / "below"))
    spans = {r.attributes["rag.run_id"]: r for r in trace.span_attributes(frame(spark, tmp_path)).collect()}
    assert spans["1"].attributes["rag.latency.total_ms"] == "10.0" and spans["2"].attributes["rag.final_status"] == "error" and spans["3"].gate_decision == ""


def test_settings(spark):
    assert settings.Settings.of(spark) == settings.Settings()
    spark.conf.set("spark.corpuswright.shadow", "yes")
    spark.conf.set("spark.corpuswright.max_refinements", "0")
    try:
        assert settings.Settings.of(spark) == settings.Settings(shadow=True, max_refinements=0)
    finally:
        spark.conf.unset("spark.corpuswright.shadow")
        spark.conf.unset("spark.corpuswright.max_refinements")
    for wrong in ({"max_refinements": 2}, {"max_total_tokens": 0}, {"execute_refinement": True}):
        with pytest.raises(ValueError):
            settings.Settings(**wrong)
    models = settings.default_models()
    assert models.get("embedder", "hashed") and models.get("answerer", "extractive")
    with pytest.raises(LookupError, match="hashed"):
        models.get("embedder", "none")


def test_jobs_together(spark):
    assert shared.together(lambda: spark.range(3).count(), lambda: "x") == [3, "x"]
    with pytest.raises(ZeroDivisionError):
        shared.together(lambda: 1, lambda: 1 // 0)
    rows = spark.range(50).toDF("i")
    assert shared.fixed(rows).count() == 50 and shared.fixed(rows.limit(0)).columns == ["i"]
