import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import text, tokenize
from corpuswright.operators import chunking, evaluation, grounding, sentences


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()[0]


@pytest.mark.parametrize(("numeral", "value"), [("一", 1), ("十", 10), ("十一", 11), ("二十", 20), ("七十二", 72), ("一百零三", 103), ("一千零一", 1001), ("〇五", 5), ("12", 12)])
def test_numerals(spark, numeral, value):
    assert one(spark, numeral, text.cn_to_int) == value


def test_dates_and_numbers(spark):
    assert one(spark, "第 8-1 條", text.normalize_article_no) == "8-1"
    assert one(spark, "2026/7/10 上午", text.normalize_update_date) == "2026-07-10"
    with pytest.raises(Exception, match="no date"):
        one(spark, "soon", text.normalize_update_date)
    assert one(spark, "修正 民國 110 年 06 月 9 日", text.roc_date_to_iso8) == "20210609"
    assert one(spark, "none", text.roc_date_to_iso8) == ""
    assert one(spark, "20210609", text.roc_date) == "民國 110 年 6 月 9 日" and one(spark, "2021", text.roc_date) == "2021"
    assert one(spark, "https://x/?pcode=L0070040&y=1", text.pcode_of) == "L0070040" and one(spark, "x", text.pcode_of) is None
    assert one(spark, "a\nb\r\nc", text.to_crlf) == "a\r\nb\r\nc"


def test_canonical_hash_equals_sorted_json(spark):
    fields = {"b": '甲"乙\r\n', "a": None, "c": "x"}
    got = one(spark, fields["b"], lambda c: text.sha256_json({"b": c, "a": F.lit(None).cast("string"), "c": F.lit("x")}))
    want = hashlib.sha256(json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got == want


def test_personal_data(spark):
    found = one(spark, "mail a.b@c.org, id A123456789, 0912-345678 台北市中山路1號", text.redact_pii)
    assert "[EMAIL]" in found and "[NATIONAL_ID]" in found and "[PHONE]" in found and "@" not in found
    assert "[ADDRESS]" in one(spark, "住在台北市中山路", text.redact_pii)


def test_questions(spark):
    assert one(spark, "  A　b\n C ", text.normalize_question) == "a b c"
    assert one(spark, "「問題：長照 機構怎麼申請？謝謝」", text.sanitize_question) == "長照機構怎麼申請？"
    assert one(spark, "長照機構怎麼申請", text.sanitize_question) == "長照機構怎麼申請？"
    ok = [one(spark, q, text.valid_question) for q in ("長照機構要怎麼申請？", "短？", "依本法要怎麼申請呢？", "一個問題？兩個問題？", "第 3 條說了什麼內容？")]
    assert ok == [True, False, False, False, False]
    assert one(spark, "申請長照補助", text.long_tail) == "申請長炤補助"


def test_citations_and_json(spark):
    got = one(spark, "見[甲法 §8-1]及[ 乙法§2 ]，[丙法 §3]", text.extract_citations)
    assert [(x.law_name, x.article_no) for x in got] == [("甲法", "8-1"), ("丙法", "3")]
    assert one(spark, '```json\nsure: [{"a": [1]}] ok\n```', text.json_slice) == '[{"a": [1]}]'
    assert one(spark, "] none [", text.json_slice) is None
    assert one(spark, "一\n[甲法 §1]。\n二<b>", text.render_answer) == '<div class="answer-para">一[甲法 §1]。</div>\n<div class="answer-para">二&lt;b&gt;</div>'


def test_small_functions(spark):
    assert one(spark, "Connection refused", text.friendly_error) == "service_unreachable"
    assert one(spark, "/home/u/x/y", lambda c: text.portable_path(c, {"/home/u": "~", "/home/u/x": "X"})) == "X/y"
    assert [one(spark, s, text.parse_retention_days) for s in ("7", "off", "x")] == [7, None, None]
    assert one(spark, " YES ", text.parse_bool) is True
    assert one(spark, "1000", lambda c: text.generation_cost(c.cast("double"), F.lit(0), 2.0, 8.0, 0.95)) == pytest.approx((50 + 950 * 0.25) * 2 / 1e6)
    for x in (-800.0, 0.0, 800.0):
        assert spark.range(1).select(text.sigmoid(F.lit(x))).first()[0] == pytest.approx(0 if x < 0 else 0.5 if x == 0 else 1)


def test_tokens(spark):
    assert one(spark, "Ab-c 12,É", tokenize.words) == ["ab", "c", "12", "é"]
    assert one(spark, "長照機構之設立ABC", lambda c: tokenize.cjk_tokens(c, ["長照", "長照機構"])) == ["長照機構", "之設", "立", "abc"]


def packed(paras, budget):
    out, now, n = [], [], 0
    for p in paras:
        if len(p) > budget and not now:
            out.append([p])
        elif now and n + len(p) > budget:
            out.append(now)
            now, n = [p], len(p)
        else:
            now, n = now + [p], n + len(p)
    return out + [now] if now else out


@pytest.mark.parametrize("sizes", [[100] * 6, [30], [300, 20, 20], [20, 300, 20], [250, 250], [249, 1, 250, 251, 1]])
def test_chunks(spark, sizes):
    paras = [chr(97 + i) * n for i, n in enumerate(sizes)]
    rows = spark.createDataFrame([("L-1", "\r\n".join(paras) + "\n \n", "ch")], "id string, content string, chapter string")
    got = chunking.chunk_articles(rows, "id", "content", F.lit("P"), most=253).orderBy("part").collect()
    whole = "\r\n".join(paras) + "\n \n"
    if len(whole) <= 253:
        assert [(g.chunk_id, g.part, g.text) for g in got] == [("L-1", 0, whole)]
    else:
        assert [g.text for g in got] == ["P\r\n" + "\r\n".join(s) for s in packed(paras, 250)]
        assert [g.chunk_id for g in got] == [f"L-1-p{i}" for i in range(1, len(got) + 1)] and got[0].chapter == "ch"


def test_sentences(spark):
    cases = {
        "長照機構應經許可。「不是嗎？」他這樣說道。": ["長照機構應經許可。", "「不是嗎？」他這樣說道。"],
        "機構應於期限內申請。 [長照法 §3]。\n[甲法 §2]": ["機構應於期限內申請。[長照法 §3]。"],
        "短句。查無明確法源。建議撥打1966專線洽詢服務。": [],
        "）多餘的括號不影響判斷。後面這句也要切開。": ["）多餘的括號不影響判斷。", "後面這句也要切開。"],
        "only latin letters here. yes": [],
    }
    for body, want in cases.items():
        assert [s for _, s in sentences.split_sentences(body)] == want
    rows = spark.createDataFrame([("a", k) for k in cases] + [("n", None)], "answer_id string, text string")
    assert sentences.sentences(rows).count() == sum(map(len, cases.values()))


def test_more_of_questions_and_pages(spark):
    assert one(spark, "可以請假嗎？", text.long_tail) == "想請問一下，可以請假嗎？"
    assert [one(spark, c, text.trivial) for c in ("本辦法自發布日施行。", " 本細則依本法第十條規定訂定之。\r\n", "由中央主管機關定之。", "申請人應檢附文件。", "主管機關應於三十日內核定，並通知申請人補正文件後施行。其他事項。")] == [True, True, True, False, False]
    cite = lambda c: text.render_citation(F.lit("甲<法"), F.lit("8-1"), c)
    assert one(spark, "a&b\r\nc", cite) == '<details class="citation"><summary>[甲&lt;法 §8-1]</summary><div class="citation-body">《甲&lt;法》第 8-1 條：<br>a&amp;b<br>c</div></details>'
    assert one(spark, None, cite) == '<span class="citation-missing">[甲&lt;法 §8-1]</span>'
    items = spark.createDataFrame([([("L-1", "甲", "1", "u?a&b"), ("L-2", "乙", "2", "v"), ("L-1", "甲", "1", "w")],), ([],)], "i array<struct<article_id: string, law_name: string, article_no: string, url: string>>").coalesce(1)
    got = [r[0] for r in items.select(text.render_article_list(F.col("i"), "x")).collect()]
    assert got == ['<p><b>x</b></p><ul class="article-list"><li><a href="u?a&amp;b" target="_blank">《甲》第 1 條</a></li><li><a href="v" target="_blank">《乙》第 2 條</a></li></ul>', ""]
    assert one(spark, "長期照顧服務法之罰鍰abc 甲乙丙 的x", tokenize.segmented) == ["長期照顧服務法", "之罰", "鍰", "abc", "甲乙", "丙", "x"]


def test_chosen_questions(spark):
    replies = spark.createDataFrame([("a", 0, "短"), ("a", 1, "長照機構要怎麼申請？"), ("b", 0, "長照機構要怎麼申請？"), ("c", 0, "依本法要怎麼申請呢？"), ("d", 0, "已經問過的問題是什麼？"), ("e", 0, "喘息服務可以用幾天呢？")], "id string, attempt int, reply string")
    known = spark.createDataFrame([("已經問過的問題是什麼？",)], "q string").select(text.question_hash(F.col("q")).alias("question_hash"))
    assert sorted(map(tuple, evaluation.chosen_questions(replies, known).collect())) == [("a", "長照機構要怎麼申請？"), ("e", "喘息服務可以用幾天呢？")]


def test_contexts(spark):
    rows = spark.createDataFrame([("q", 2, "乙法", "2", "y"), ("q", 1, "甲法", "1", "x")], "query_id string, place int, law_name string, article_no string, content string")
    assert grounding.related_context(rows).first().context == "《甲法》第 1 條：\nx\n\n《乙法》第 2 條：\ny"
    chapters = spark.createDataFrame([("q", 0, "甲法", "第一章總則", "1", "3", "s")], "query_id string, ord int, law_name string, chapter string, article_lo string, article_hi string, summary string")
    assert grounding.global_context(chapters).first().context == "《甲法》第一章總則（第1〜3條）：\ns"
    asked = spark.createDataFrame([("q", "好"), ("none", "x")], "query_id string, text string")
    made = lambda t: {r.query_id: (r.final_text, r.removed) for r in grounding.global_answers(asked, chapters, lambda question, context: F.lit(t)).collect()}
    assert made("好[甲法 第一章總則]\n壞[乙法 第九章]") == {"q": ("好[甲法 第一章總則]", 1), "none": (grounding.REFUSAL_TEXT, 0)}
    assert made("壞[乙法 第九章]")["q"] == (grounding.REFUSAL_TEXT, 1)
