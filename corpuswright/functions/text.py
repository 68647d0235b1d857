"""Scalar text functions, each a Column expression that stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns for personal data and citations, numerals, marks and typing errors of questions, and procedural articles
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
NATIONAL_ID = r"(?i)\b[A-Z][12]\d{8}\b"
PHONE = r"(?<!\d)(?:\+?886[-\s]?)?(?:0?\d{1,2}[-\s]?)?\d{3,4}[-\s]?\d{3,4}(?!\d)"
ADDRESS = r"[一-鿿]{2,}(?:縣|市)[一-鿿0-9\-]{1,30}(?:路|街|巷|弄|號)(?:\d+樓)?"
CITATION = r"\[([^\[\]§]+?)\s*§\s*([0-9]+(?:-[0-9]+)?)\]"
CHAPTER_CITATION = r"\[([^\[\]]+?)\s+(第[一二三四五六七八九十百]+章[^\[\]]*?|全文)\]"
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
FORBIDDEN_QUESTION_MARKERS = ("第1條", "第 1 條", "依本法", "依該法", "根據條文")
TYPO_MAP = {"長照": "長炤", "機構": "機搆", "申請": "申晴", "補助": "補住", "許可": "許課", "服務": "服物", "主管機關": "主管機觀"}

# fixed values: the polite opening of a long-tail question, and articles about procedure alone
LONG_TAIL_PREFIX = "想請問一下，"
PROCEDURAL = (
    r"^(本法|本細則|本辦法)?[^。]{0,20}"
    r"(自(中華民國)?[^。]{0,20}施行|由(中央|地方)?主管機關(另)?定之|"
    r"依[^。]{0,60}(訂定|訂定之|定之))\s*[。.]?"
    r"(\r?\n[^。]{0,40}(施行|訂定之)[。.]?)?\s*$"
)


def trivial(c: Column) -> Column:
    """Whether an article only says when it takes effect, what it rests on or who decides the rest."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "").rlike(PROCEDURAL)


def quoted(text: str) -> str:
    """text as a Java regular expression that matches just itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def collapsed(c: Column) -> Column:
    """Runs of white space, Unicode's too, as one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_article_no(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[第條\s]", "")


def normalize_update_date(c: Column) -> Column:
    """Y/M/D... as ISO; an error where it can't be read."""
    part = lambda i: F.regexp_extract(F.trim(c), r"^(\d{4})/(\d{1,2})/(\d{1,2})", i)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) == "", F.raise_error(F.concat(F.lit("no date: "), c)).cast("string")).otherwise(iso)


def roc_date_to_iso8(c: Column) -> Column:
    """A date of the Minguo calendar as YYYYMMDD; empty where there is none."""
    pattern = r"(?U)民國\s*(\d+)\s*年\s*(\d+)\s*月\s*(\d+)\s*日"
    part = lambda i: F.regexp_extract(c, pattern, i)
    year = (part(1).try_cast("int") + 1911).cast("string")
    return F.when(part(1) == "", "").otherwise(F.concat(F.lpad(year, 4, "0"), F.lpad(part(2).try_cast("int").cast("string"), 2, "0"), F.lpad(part(3).try_cast("int").cast("string"), 2, "0")))


def roc_date(c: Column) -> Column:
    """YYYYMMDD as a Minguo date; other texts as they are."""
    number = lambda a, n: F.substring(c, a, n).try_cast("int")
    return F.when(c.rlike(r"^\d{8}$"), F.format_string("民國 %d 年 %d 月 %d 日", number(1, 4) - 1911, number(5, 2), number(7, 2))).otherwise(c)


def pcode_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"pcode=([A-Za-z0-9]+)", 1)
    return F.when(found != "", found)


def to_crlf(c: Column) -> Column:
    return F.regexp_replace(c, r"\r?\n", "\r\n")


def cn_to_int(c: Column) -> Column:
    """A Chinese numeral as an integer; plain digits are read as they are, other characters are skipped."""
    digits = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in CN_UNITS.items() for x in kv])
    start = F.struct(F.lit(0).alias("section"), F.lit(0).alias("num"))

    def step(acc: Column, ch: Column) -> Column:
        digit, unit = digits[ch], units[ch]
        times = F.when(acc["num"] == 0, 1).otherwise(acc["num"])
        section = F.when(digit.isNull() & unit.isNotNull(), acc["section"] + times * unit).otherwise(acc["section"])
        num = F.when(digit.isNotNull(), digit).when(unit.isNotNull(), 0).otherwise(acc["num"])
        return F.struct(section.alias("section"), num.alias("num"))

    folded = F.aggregate(F.split(c, ""), start, step, lambda acc: acc["section"] + acc["num"])
    return F.when(c.rlike(r"^[0-9]+$"), c.try_cast("int")).otherwise(folded)


def article_no_of(base: Column, suffix: Column) -> Column:
    """base, or base-suffix where there is one, both Chinese numerals or digits."""
    head = cn_to_int(base).cast("string")
    return F.when(suffix.isNull() | (suffix == ""), head).otherwise(F.concat_ws("-", head, cn_to_int(suffix).cast("string")))


def normalize_question(c: Column) -> Column:
    return F.lower(collapsed(c))


def question_hash(c: Column) -> Column:
    return F.sha2(normalize_question(c), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sha256_json(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def article_content_hash(article_no: Column, chapter: Column, content: Column, law_modified_date: Column, pcode: Column) -> Column:
    """Over the five fields of content; when it was fetched doesn't count."""
    return sha256_json({"article_no": article_no, "chapter": chapter, "content": content, "law_modified_date": law_modified_date, "pcode": pcode})


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def composite_text(summary: Column, text: Column) -> Column:
    """The summary on a line of its own before the text; without a summary the text alone."""
    return F.when(F.length(summary) > 0, F.concat(summary, F.lit("\r\n"), text)).otherwise(text)


def sigmoid(x: Column) -> Column:
    """The logistic function, without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def parse_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "on")


def parse_retention_days(c: Column) -> Column:
    """Days, or null for 0, none, off and an empty text."""
    value = F.lower(F.trim(c))
    return F.when(~value.isin("", "0", "none", "off"), value.try_cast("int"))


def json_slice(c: Column, opening: str = "[", closing: str = "]") -> Column:
    """What a model's reply holds from the first opening to the last closing bracket, code fences taken off; null without both."""
    return F.nullif(F.regexp_extract(c, rf"(?s)\{opening}.*\{closing}", 0), F.lit(""))  # fences stand before and behind


def sanitize_question(c: Column, law_names: Sequence[str] = ()) -> Column:
    """The first line of a model's question without quotes, labels, law names, article numbers and white space, up to the question mark."""
    out = F.regexp_replace(F.trim(c), "^[「」\"' ]+|[「」\"' ]+$", "")
    out = F.regexp_replace(F.trim(F.regexp_extract(out, r"^[^\r\n]*", 0)), r"^(問題|問句)\s*[：:]\s*", "")
    for name in law_names:
        out = F.replace(F.replace(out, F.lit(f"《{name}》"), F.lit("")), F.lit(name), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, r"第\s*\d+(?:-\d+)?\s*條", ""), r"(?U)\s+", "")
    return F.when(out.rlike("[？?]"), F.regexp_extract(out, r"^[^？?]*[？?]", 0)).when(out != "", F.concat(out, F.lit("？"))).otherwise(out)


def valid_question(c: Column, law_names: Sequence[str] = ()) -> Column:
    """8 to 80 characters, one question mark, no banned marker, article number or law name. Known questions are left out by an anti-join."""
    return (
        F.length(c).between(8, 80) & (F.regexp_count(c, F.lit("[？?]")) == 1) & ~contains_any(c, FORBIDDEN_QUESTION_MARKERS)
        & ~c.rlike(r"第\s*\d+(?:-\d+)?\s*條") & ~contains_any(c, law_names)
    )


def long_tail(c: Column) -> Column:
    """A deterministic typing error: the first word of the table that occurs, replaced once; without any a phrase in front."""
    out = F.concat(F.lit(LONG_TAIL_PREFIX), c)
    for word, typo in reversed(TYPO_MAP.items()):
        out = F.when(c.contains(word), F.regexp_replace(c, f"^((?s).*?){quoted(word)}", f"$1{typo}")).otherwise(out)
    return out


def paragraphs(c: Column) -> Column:
    """Lines with content."""
    return F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != "")


def redact_pii(c: Column) -> Column:
    """E-mail addresses, national ids, phone numbers and addresses, in this order."""
    for pattern, name in ((EMAIL, "EMAIL"), (NATIONAL_ID, "NATIONAL_ID"), (PHONE, "PHONE"), (ADDRESS, "ADDRESS")):
        c = F.regexp_replace(c, pattern, f"[{name}]")
    return c


def extract_citations(c: Column, pattern: str = CITATION) -> Column:
    """Array of (law_name, article_no) in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("law_name"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("article_no"))
    return F.transform(pairs, lambda x: F.struct(F.trim(x["law_name"]).alias("law_name"), x["article_no"].alias("article_no")))


def escape_html(c: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#x27")):
        c = F.replace(c, F.lit(char), F.lit(f"&{name};"))
    return c


def render_answer(c: Column) -> Column:
    """Escaped paragraphs; a line that holds only citations and punctuation joins the one before."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), F.trim), lambda x: x != "")
    noise = r"(?U)^[\s，。、；：！？!?,.\"'「」『』（）()\[\]【】《》<>]*$"

    def step(acc: Column, line: Column) -> Column:
        joins = (F.size(acc) > 0) & F.regexp_replace(line, CITATION, "").rlike(noise)
        kept = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(kept, F.array(F.concat(F.element_at(acc, -1), line)))).otherwise(F.concat(acc, F.array(line)))

    merged = F.aggregate(lines, F.array().cast("array<string>"), step)
    return F.array_join(F.transform(merged, lambda x: F.concat(F.lit('<div class="answer-para">'), escape_html(x), F.lit("</div>"))), "\n")


def render_citation(law_name: Column, article_no: Column, content: Column) -> Column:
    """A citation that opens to its article, or is marked as missing where there is none (a null content)."""
    label = escape_html(F.concat(F.lit("["), law_name, F.lit(" §"), article_no, F.lit("]")))
    body = F.regexp_replace(escape_html(content), r"\r?\n", "<br>")
    found = F.concat(F.lit('<details class="citation"><summary>'), label, F.lit('</summary><div class="citation-body">《'), escape_html(law_name), F.lit("》第 "), escape_html(article_no), F.lit(" 條：<br>"), body, F.lit("</div></details>"))
    return F.when(content.isNull(), F.concat(F.lit('<span class="citation-missing">'), label, F.lit("</span>"))).otherwise(found)


def render_article_list(items: Column, label: str) -> Column:
    """A list of links, an article once. items: array of (article_id, law_name, article_no, url); empty without any."""
    ids = F.transform(items, lambda x: x["article_id"])
    once = F.filter(items, lambda x, i: F.array_position(ids, x["article_id"]) == i + 1)
    row = lambda x: F.concat(F.lit('<li><a href="'), escape_html(x["url"]), F.lit('" target="_blank">《'), escape_html(x["law_name"]), F.lit("》第 "), escape_html(x["article_no"]), F.lit(" 條</a></li>"))
    rows = F.array_join(F.transform(once, row), "")
    return F.when(F.size(items) == 0, "").otherwise(F.concat(F.lit(f'<p><b>{label}</b></p><ul class="article-list">'), rows, F.lit("</ul>")))


def friendly_error(c: Column) -> Column:
    """A class of error by what its message contains."""
    low = F.lower(c)
    return (
        F.when(contains_any(low, ("connection", "refused", "connect")), "service_unreachable")
        .when(contains_any(low, ("api key", "api_key", "unauthorized", "401", "403")), "credentials")
        .when(contains_any(low, ("quota", "rate limit", "429")), "quota")
        .when(contains_any(low, ("timeout", "timed out")), "timeout").otherwise("other")
    )


def portable_path(c: Column, prefixes: dict[str, str]) -> Column:
    """A path below one of the prefixes as its label and the rest; the longest prefix counts."""
    out = c
    for prefix, label in sorted(prefixes.items(), key=lambda x: len(x[0])):
        out = F.when(c.startswith(prefix), F.concat(F.lit(label), F.substr(c, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


def text_of_parts(parts: Column) -> Column:
    """The texts of a reply's parts as one text."""
    return F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "")


def generation_cost(input_tokens: Column, output_tokens: Column, price_in: float, price_out: float, shared: float = 0.0, cached_price: float = 0.25) -> Column:
    """Cost in the prices' currency (per million tokens); `shared` is the share of input billed at cached_price."""
    billed = input_tokens * (1 - shared) + input_tokens * shared * cached_price
    return (billed * price_in + output_tokens * price_out) / 1e6
