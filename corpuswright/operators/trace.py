"""Trace logs: what is written, kept and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions.text import redact_pii
from .metrics import linear_percentile, rate

TRACE = (
    "request_id string, run_id string, started_at string, completed_at string, original_query string, route struct<route: string>, "
    "confidence_gate struct<decision: string>, shadow_adaptive struct<initial_gate: struct<decision: string>, final_gate: struct<decision: string>, "
    "refinement_executed: boolean, latency_ms: map<string, double>, token_usage: struct<total_tokens: bigint, by_stage: map<string, struct<total_tokens: bigint>>>>, "
    "latency_ms map<string, double>, token_usage struct<total_tokens: bigint, by_stage: map<string, struct<total_tokens: bigint>>>, "
    "grounding struct<removed_count: int>, versions map<string, string>, privacy struct<pii_redacted: boolean>, final_status string"
)


def sampled(key: Column, sample_rate: float, error: Column | None = None) -> Column:
    """Whether a trace is written: the first 32 bits of its key's SHA-256 as a share, so that repeats agree. Errors always are."""
    bucket = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    keep = F.lit(True) if sample_rate >= 1 else F.lit(False) if sample_rate <= 0 else bucket < sample_rate
    return keep if error is None else F.coalesce(error, F.lit(False)) | keep


def redacted_value(c: Column, kind: DataType) -> Column:
    """A value of any type with personal data taken out of every string in it, at any depth; map keys stay."""
    if isinstance(kind, StringType):
        return redact_pii(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: redacted_value(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: redacted_value(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[redacted_value(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def redacted_all(rows: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """rows with every string redacted, nested ones too, but those of the columns `but`."""
    return rows.select(*[F.col(f.name) if f.name in but else redacted_value(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])


def grounding_log(answers: DataFrame, verdicts: DataFrame, provider: str) -> DataFrame:
    """timestamp, question, provider, original_text, final_text, removed_count and verdicts of each checked answer, to be appended as lines of JSON.

    answers: answer_id, question, original_text, final_text; verdicts: answer_id, sentence_no, sentence, supported, article, reason.
    """
    one = F.struct("sentence_no", "sentence", "supported", "article", "reason")
    each = verdicts.groupBy("answer_id").agg(F.array_sort(F.collect_list(one)).alias("verdicts"), F.count_if(~F.col("supported")).alias("removed_count"))
    none = F.expr("cast(array() as array<struct<sentence_no: int, sentence: string, supported: boolean, article: string, reason: string>>)")
    out = answers.join(each, "answer_id", "left")
    return out.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "question", F.lit(provider).alias("provider"), "original_text", "final_text", F.coalesce("removed_count", F.lit(0)).alias("removed_count"), F.coalesce("verdicts", none).alias("verdicts"))


def hit_records(final: DataFrame) -> DataFrame:
    """query_id and hits: a record for each hit that was ranked again, in order of rank, with the lists that it came from and its scores and ranks there. final: as rerank() gives it."""
    sources = F.array_distinct(F.transform("lists", lambda x: F.when(x % 2 == 0, "bm25").otherwise("vector")))
    one = F.struct("rank", "doc_id", sources.alias("sources"), "bm25_score", "bm25_rank", "dense_score", "dense_rank", "rrf_score", "rerank_score")
    return final.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("hits"))  # a few a question


def graph_records(related: DataFrame) -> DataFrame:
    """query_id and related: a record for each article that a hit led to, with the hit. related: query_id, place, target, via."""
    return related.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target", "via"))), lambda x: F.struct(x["target"].alias("article_id"), x["via"].alias("via_article_id"))).alias("related"))


def span_attributes(traces: DataFrame) -> DataFrame:
    """request_id, attributes and gate_decision of each trace, as a span exporter takes them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = {"rag.request_id": text("request_id"), "rag.run_id": text("run_id"), "rag.route": text("route.route"), "rag.final_status": text("final_status"), "rag.latency.total_ms": F.coalesce(F.col("latency_ms")["total"], F.lit(0.0)).cast("string")}
    return traces.select("request_id", F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]).alias("attributes"), text("confidence_gate.decision").alias("gate_decision"))


def append(rows: DataFrame, path: str) -> bool:
    """Appends lines of JSON. A log that can't be written must not fail what it tells of: then False."""
    try:
        rows.write.mode("append").json(path)
    except OSError:
        return False
    except Exception as e:  # Spark wraps the file system's errors
        if "IOException" not in str(e) and "Permission denied" not in str(e) and "FileAlreadyExists" not in str(e) and "ParentNotDirectory" not in str(e):
            raise
        return False
    return True


def redacted(traces: DataFrame, free_text: tuple[str, ...] = ("original_query",)) -> DataFrame:
    """Personal data out of the free texts; ids stay, which the phone pattern would hit."""
    return traces.withColumns({c: redact_pii(F.col(c)) for c in free_text}).withColumn("privacy", F.struct(F.lit(True).alias("pii_redacted")))


def moment(completed: Column, started: Column) -> Column:
    """When a trace ended or, failing that, began; a time without zone is UTC; null where it can't be read."""
    return F.try_to_timestamp(F.coalesce(completed, started))


def retained(rows: DataFrame, at: Column, cutoff: Column) -> DataFrame:
    """Rows at or after the cutoff, and those whose time can't be read."""
    return rows.filter(at.isNull() | (at >= cutoff))


def counted(rows: DataFrame, category: Column, missing: str) -> DataFrame:
    return rows.groupBy(F.coalesce(category, F.lit(missing)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def stage_tokens(traces: DataFrame) -> DataFrame:
    """Tokens by stage, the shadow's under a prefix."""
    own = traces.select(F.explode("token_usage.by_stage").alias("stage", "usage"))
    shadow = traces.select(F.explode("shadow_adaptive.token_usage.by_stage").alias("stage", "usage")).withColumn("stage", F.concat(F.lit("shadow."), "stage"))
    return own.unionByName(shadow).groupBy("stage").agg(F.sum("usage.total_tokens").alias("total_tokens"))


def summary(traces: DataFrame) -> DataFrame:
    """One row: counts, window, latencies, tokens, removals, shadow rates and privacy. Rates are null where nothing is counted, rounded half to even."""
    shadow = F.col("shadow_adaptive")
    has, ran = shadow.isNotNull(), F.coalesce(shadow["refinement_executed"], F.lit(False))
    first, last = shadow["initial_gate"]["decision"], F.coalesce(shadow["final_gate"]["decision"], shadow["initial_gate"]["decision"])
    rescued = ran & F.coalesce((first == "refine_once") & (last == "answer"), F.lit(False))
    removed = F.greatest(F.coalesce("grounding.removed_count", F.lit(0)), F.lit(0))
    at = moment(F.col("completed_at"), F.col("started_at"))
    latency, shadow_latency = F.col("latency_ms")["total"], shadow["latency_ms"]["total"]
    return traces.agg(
        F.count(F.lit(1)).alias("record_count"), F.min(at).alias("first"), F.max(at).alias("last"),
        linear_percentile(latency, 0.5).alias("p50"), linear_percentile(latency, 0.95).alias("p95"),
        F.sum(F.coalesce("token_usage.total_tokens", F.lit(0))).alias("tokens"), F.bround(F.avg(F.coalesce("token_usage.total_tokens", F.lit(0))), 2).alias("tokens_per_trace"),
        F.sum(removed).alias("removed_sentences"), F.count_if(removed > 0).alias("traces_with_removals"),
        F.count_if(has).alias("shadow_count"), F.bround(rate(F.count_if(has & ~F.coalesce(first == "answer", F.lit(False))), F.count_if(has)), 4).alias("would_activate_rate"),
        F.count_if(ran).alias("refinements"), F.count_if(rescued).alias("rescues"), F.bround(rate(F.count_if(rescued), F.count_if(ran)), 4).alias("rescue_rate"),
        linear_percentile(shadow_latency, 0.5).alias("shadow_p50"), linear_percentile(shadow_latency, 0.95).alias("shadow_p95"),
        F.sum(F.coalesce(shadow["token_usage"]["total_tokens"], F.lit(0))).alias("additional_tokens"),
        F.count_if(F.coalesce("privacy.pii_redacted", F.lit(False))).alias("redacted"), F.count_if(F.col("privacy").isNull()).alias("without_privacy"),
    )


def write(traces: DataFrame, path: str, sample_rate: float = 1.0, redact: bool = False) -> None:
    """Appends the traces that the policy keeps as lines of JSON with sorted keys."""
    kept = traces.filter(sampled(F.coalesce("run_id", "request_id", F.lit("")), sample_rate, F.col("final_status") == "error"))
    kept = redacted(kept) if redact else kept
    kept.select(*sorted(kept.columns)).write.mode("append").json(path)
