"""Typed routing of questions: one ordered cascade of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import Names

# fixed values: law names and short names, and the patterns of intents
LAW_ALIASES = {
    "長期照顧服務法施行細則": "L0070043",
    "長照服務法施行細則": "L0070043",
    "長照法施行細則": "L0070043",
    "長期照顧服務機構設立許可及管理辦法": "L0070044",
    "設立許可及管理辦法": "L0070044",
    "長期照顧服務申請及給付辦法": "L0070059",
    "申請及給付辦法": "L0070059",
    "長期照顧服務法": "L0070040",
    "長照服務法": "L0070040",
    "長照法": "L0070040",
    "老人福利法": "D0050037",
    "老福法": "D0050037",
}
ENUMERATION = r"每一條|每條|所有條文|全部條文|全部的條文|條文列表|逐條列出|列出.{0,6}條文|有(哪些|幾)條|共(有)?幾條|總共幾條|目錄|條文總覽"
META = r"問你|你能(回答|做|處理)|你可以(回答|做|處理)|你是誰|你叫什麼|你是什麼|這(個|套)(系統|工具|服務|機器人|助手|網站|平台)|(你的|系統的|工具的)(功能|用途|能力|範圍)"
GLOBAL = r"整體|整部.{0,4}(規範|規定|在(講|說|管))|大致(規範|規定)|主要規範|主要規定|規範(什麼|哪些|的重點)|規定(什麼|哪些)(內容|事項)?|重點是什麼|差別|差異|不同之處|比較|哪個.{0,4}(嚴重|重)|最高|最重|最少|最輕"
AMBIGUOUS = r"^(這|那|它|這個|那個|怎麼辦|可以嗎|是否合法|有沒有問題)[？?。\s]*$|^(這個|那個).{0,6}(可以嗎|是否合法|怎麼辦)[？?。\s]*$|(上面|前面|剛才|這件事|那件事|某個規定|相關規定)"
MULTI_HOP = r"(同時|以及|還有).{0,20}(資格|給付|申請|處罰|設立)|(先|之後|再).{0,30}(申請|設立|變更|處罰)|(依據|引用|準用).{0,12}(哪些|哪一|何種).{0,8}(法|條)"
ARTICLE = r"第\s*([0-9]+(?:\s*[-之]\s*[0-9]+)?)\s*條"


def named_laws(question: Column, aliases: dict[str, str] | Names | None = None) -> Column:
    """Codes of the laws that a question names, once each; longer names first, and a name found is taken out before shorter ones are sought. Names (as Names) beyond some dozens take one pass instead of one each."""
    if isinstance(aliases, Names):
        return aliases.codes(question)
    aliases = LAW_ALIASES if aliases is None else aliases
    ordered = sorted(aliases, key=len, reverse=True)
    rest, found = question, []
    for name in ordered:
        found.append(F.when(rest.contains(name), F.lit(aliases[name])))
        rest = F.replace(rest, F.lit(name), F.lit(" "))
    return F.array_distinct(F.array_compact(F.array(*found)))


def first_law(question: Column, aliases: dict[str, str] | Names | None = None) -> Column:
    """The code of the longest name that occurs, or null."""
    if isinstance(aliases, Names):
        return aliases.first(question)
    aliases = LAW_ALIASES if aliases is None else aliases
    return F.coalesce(*[F.when(question.contains(n), F.lit(aliases[n])) for n in sorted(aliases, key=len, reverse=True)])


def required_articles(question: Column, aliases: dict[str, str] | Names | None = None) -> Column:
    """Each law named with each article number named."""
    if isinstance(aliases, Names):
        return aliases.with_articles(question, ARTICLE)
    aliases = LAW_ALIASES if aliases is None else aliases
    bare = question
    for name in sorted(aliases, key=len, reverse=True):
        bare = F.replace(bare, F.lit(name), F.lit(" "))
    numbers = F.transform(F.regexp_extract_all(bare, F.lit(ARTICLE), 1), lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("之"), F.lit("-")))
    return F.flatten(F.transform(named_laws(question, aliases), lambda p: F.transform(numbers, lambda n: F.concat(p, F.lit("-"), n))))


def _result(route: str, reason: str, confidence: float, laws: Column, handler: str | None) -> Column:
    return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"), laws.alias("matched_pcodes"), F.lit(handler).cast("string").alias("handler"))


def route_question(question: Column, aliases: dict[str, str] | Names | None = None, patterns: dict[str, str] | None = None) -> Column:
    """route, reason, confidence, matched_pcodes and handler of a question. The order of the cascade is its meaning."""
    p = {"meta": META, "enumeration": ENUMERATION, "global": GLOBAL, "ambiguous": AMBIGUOUS, "multi_hop": MULTI_HOP} | (patterns or {})
    q = F.regexp_replace(question, r"(?U)^\s+|\s+$", "")
    none, one, laws = F.array().cast("array<string>"), first_law(q, aliases), named_laws(q, aliases)
    return (
        F.when(q.rlike(p["meta"]), _result("no_retrieval", "asks about the system itself", 0.99, none, "meta_response"))
        .when(q.rlike(p["enumeration"]) & one.isNotNull(), _result("structured", "asks for the catalogue of a known law", 0.99, F.array(one), "law_overview"))
        .when(q.rlike(p["global"]) & (F.size(laws) > 0), _result("global_or_multi_hop", "asks about whole laws or chapters", 0.96, laws, "chapter_summary"))
        .when((F.length(q) < 5) | q.rlike(p["ambiguous"]), _result("corrective_candidate", "too short or leans on missing context", 0.82, none, "hybrid_retrieval"))
        .when(q.rlike(p["multi_hop"]), _result("global_or_multi_hop", "joins several conditions", 0.78, none, "citation_graph"))
        .otherwise(_result("single_hop", "a question of one scope", 0.90, none, "hybrid_retrieval"))
    )


def requires_retrieval(route: Column) -> Column:
    """Whether a routed question goes to retrieval."""
    return route["route"].isin("single_hop", "corrective_candidate") | is_multi_hop(route)


def is_multi_hop(route: Column) -> Column:
    return (route["route"] == "global_or_multi_hop") & F.coalesce(route["handler"] == "citation_graph", F.lit(False))


def routed(questions: DataFrame, question_col: str = "question") -> DataFrame:
    return questions.withColumn("route", route_question(F.col(question_col)))
