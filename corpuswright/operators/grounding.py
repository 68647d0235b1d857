"""Checking answers sentence by sentence, and models' replies as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, json_slice
from ..functions.tokenize import segmented

# fixed values: the refusal's text and the marks of an answer-like query
REFUSAL_TEXT = "查無明確法源。建議撥打 1966 長照服務專線洽詢。"
EXPLAINING, ANSWERING = ("以下", "根據", "說明", "修正理由", "原始問題"), ("。", "；", "這個查詢", "查詢策略")
VERDICTS = "array<struct<index: int, supported: boolean, context_no: int, reason: string>>"


def parsed_verdicts(replies: DataFrame) -> DataFrame:
    """answer_id, index, supported, context_no, reason from judges' replies; the last of a repeated index counts, a reply that can't be read gives no row."""
    # the outer form, as Spark would read each reply once more to leave out those without a row
    items = replies.select("answer_id", F.posexplode_outer(F.from_json(json_slice(F.col("reply")), VERDICTS)).alias("at", "v"))
    last = items.filter("v.index is not null").groupBy("answer_id", F.col("v.index").alias("index")).agg(F.max_by("v", "at").alias("v"))
    return last.select("answer_id", "index", "v.supported", "v.context_no", "v.reason")


def reconciled(sentences: DataFrame, verdicts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each sentence with its verdict: unsupported if the judge left it out or named a context that there isn't. contexts: answer_id, context_no, article."""
    v = verdicts.withColumnRenamed("index", "sentence_no")
    joined = sentences.join(v, ["answer_id", "sentence_no"], "left").join(contexts, ["answer_id", "context_no"], "left")
    ok = F.coalesce(F.col("supported"), F.lit(False)) & F.col("article").isNotNull()
    return joined.select("answer_id", "para", "sentence_no", "sentence", ok.alias("supported"), F.when(ok, F.col("article")).alias("article"), F.when(F.col("supported").isNull(), "no verdict").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"))


def overlap_judge(sentences: DataFrame, contexts: DataFrame, least: float = 0.5) -> DataFrame:
    """The default judge in place of a model: the context with the largest share of a sentence's words, if that is enough. contexts also have text."""
    both = sentences.join(contexts, "answer_id")
    asked = F.array_distinct(segmented(F.col("sentence")))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, segmented(F.col("text")))).cast("double"), F.size(asked).cast("double")), F.lit(0.0))
    best = both.groupBy("answer_id", "sentence_no").agg(F.max(F.struct(share.alias("share"), (-F.col("context_no")).alias("neg"))).alias("b"))
    return best.select("answer_id", F.col("sentence_no").alias("index"), (F.col("b.share") >= least).alias("supported"), (-F.col("b.neg")).alias("context_no"), F.lit("word overlap").alias("reason"))


def applied(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """answer_id, final_text, removed_count: supported sentences by paragraph; without any the refusal."""
    part = F.when(F.col("supported"), F.struct("para", "sentence_no", "sentence"))
    kept = verdicts.groupBy("answer_id").agg(F.sort_array(F.collect_list(part)).alias("kept"), F.count_if(~F.col("supported")).alias("removed_count"))
    paras = F.array_distinct(F.transform("kept", lambda k: k["para"]))
    text = F.array_join(F.transform(paras, lambda p: F.array_join(F.transform(F.filter("kept", lambda k: k["para"] == p), lambda k: k["sentence"]), "")), "\n")
    out = answers.select("answer_id").join(kept, "answer_id", "left").withColumn("final_text", text)
    return out.select("answer_id", F.when(F.coalesce("final_text", F.lit("")) == "", REFUSAL_TEXT).otherwise(F.col("final_text")).alias("final_text"), F.coalesce("removed_count", F.lit(0)).alias("removed_count"))


def refined_query(question: Column, previous: Column, reply: Column) -> Column:
    """A model's reply as a query: its last line that doesn't explain, without quotes and labels. One that is too short, too long or an answer gives way to question and previous query."""
    lines = F.filter(F.transform(F.split(reply, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[-•]+", ""))), lambda x: (x != "") & ~x.startswith("```"))
    plain = F.filter(lines, lambda x: ~_starts(x, EXPLAINING))
    last = F.coalesce(F.try_element_at(plain, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, "^[「」\"' ]+|[「」\"' ]+$", ""), "^修正後查詢：", ""), "^查詢：", ""))
    bad = ~F.length(bare).between(4, 64) | contains_any(bare, ANSWERING)
    fallback = F.substring(F.trim(F.concat_ws(" ", question, previous)), 1, 160)
    out = F.when(bad, fallback).otherwise(bare)
    return F.when(reply.isNull() | (out == ""), previous).otherwise(out)


def _starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def cached_reply(rows: DataFrame, cache: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """rows with the cached reply, or the default."""
    return rows.join(cache.select(key, F.col(value).alias("__v")), key, "left").withColumn(value, F.coalesce("__v", default)).drop("__v")


def context_text(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """query_id and context: whole articles of the ranked hits, once each, in order of rank. hits: query_id, parent_id, rank, text; articles: parent_id, law_name, article_no, content."""
    once = hits.groupBy("query_id", "parent_id").agg(F.min("rank").alias("rank"), F.min_by("text", "rank").alias("text"))
    joined = once.join(articles, "parent_id", "left")
    line = F.format_string("《%s》第 %s 條：\n%s", "law_name", "article_no", F.coalesce("content", "text"))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def related_context(related: DataFrame) -> DataFrame:
    """query_id and context of related articles in order of place. related: query_id, place, law_name, article_no, content; five a question at most."""
    line = F.format_string("《%s》第 %s 條：\n%s", "law_name", "article_no", "content")
    return related.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def global_context(chapters: DataFrame) -> DataFrame:
    """query_id and context of chapter summaries. chapters: query_id, ord, law_name, chapter, article_lo, article_hi, summary."""
    line = F.format_string("《%s》%s（第%s〜%s條）：\n%s", "law_name", "chapter", "article_lo", "article_hi", "summary")
    return chapters.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def global_answers(questions: DataFrame, chapters: DataFrame, answer) -> DataFrame:
    """query_id, final_text and removed of questions about whole laws: the answerer reads chapter summaries, and paragraphs that cite a chapter it wasn't given go. Without chapters, or with nothing left, the refusal.

    questions: query_id, text; chapters as for global_context; answer: from question and context to a text, as columns.
    """
    from .citations import verified_paragraphs

    texts = questions.join(global_context(chapters), "query_id").select(F.col("query_id").alias("answer_id"), answer(F.col("text"), F.col("context")).alias("text"))
    checked = verified_paragraphs(texts, chapters.select(F.col("query_id").alias("answer_id"), "law_name", "chapter")).withColumnRenamed("answer_id", "query_id")
    out = questions.select("query_id").join(checked, "query_id", "left")
    return out.select("query_id", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", REFUSAL_TEXT).otherwise(F.col("text")).alias("final_text"), F.coalesce("removed", F.lit(0)).alias("removed"))


def prompt(question: Column, context: Column, related: Column) -> Column:
    """The user's part of a prompt."""
    extra = F.when(F.length(related) > 0, F.concat(F.lit("關聯條文：\n\n"), related))
    return F.concat_ws("\n\n", F.concat(F.lit("參考條文：\n\n"), context), extra, F.concat(F.lit("---\n問題："), question))
