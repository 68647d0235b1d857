"""Law packages (ZIP of JSON, XML, HTML pages) to one shape of rows, and articles from them.

A package is one row, unpacked in one task, as a file is. JSON is read by Spark itself. Formats that interleave headings and
articles without a list around them need an ordered scan, an Arrow map that gives numbered events; what follows is relational.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_article_no, normalize_update_date, pcode_of, to_crlf
from ..operators.windows import carried

LAW = "pcode string, law_name string, law_modified_date string, law_effective_date string, law_effective_note string, source_update_date string"
EVENTS = f"{LAW}, ord int, article_type string, article_no string, content string"
LAWS_URL = "https://law.moj.gov.tw/LawClass/LawSingle.aspx?pcode=%s&flno=%s"
# fixed values: fields of the JSON package, elements of the XML one, and marks of the full-text page
_JSON = "UpdateDate string, Laws array<struct<LawName: string, LawURL: string, LawModifiedDate: string, LawEffectiveDate: string, LawEffectiveNote: string, LawArticles: array<struct<ArticleType: string, ArticleNo: string, ArticleContent: string>>>>"
_LAW_TAG, _HEADING, _ARTICLE, _NUMBER, _BODY = "法規", "編章節", "條文", "條號", "條文內容"
_FIELDS = {"法規名稱": "law_name", "法規網址": "url", "最新異動日期": "law_modified_date", "生效日期": "law_effective_date", "生效內容": "law_effective_note"}
_TITLE = re.compile(r"<title>\s*(.+?)-全國法規資料庫", re.S)
_DATED = re.compile(r"(?:修正|公布)日期：</th>\s*<td>(.*?)</td>", re.S)
_ROC = re.compile(r"民國\s*(\d+)\s*年\s*(\d+)\s*月\s*(\d+)\s*日")
_PAGE_BODY, _PAGE_CHAPTER, _PAGE_NUMBER, _PAGE_TEXT, _PAGE_LINE = "law-reg-content", "h3 char-", "col-no", "law-article", "line-"


class VersionMismatch(RuntimeError):
    """Packages of one load that are of different dates."""


def mapped(rows: DataFrame, schema: str, parse: Callable[..., Iterator[tuple]]) -> DataFrame:
    """rows through a parser that gives tuples for each row; an Arrow batch holds what one row gives."""
    kinds = [(x.split()[0], {"string": pa.string(), "int": pa.int32()}[x.split()[1]]) for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                made = list(parse(*row))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return rows.mapInArrow(run, schema)


def text_of(kind: str, content: bytes) -> str:
    """A package's text: of a ZIP the first entry of its kind."""
    if content.startswith(b"PK"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if n.lower().endswith(f".{kind}")]
            if not names:
                raise OSError(f"a package without a .{kind} entry")
            content = z.read(names[0])
    return content.decode("utf-8-sig")


def json_events(texts: DataFrame) -> DataFrame:
    """Events of JSON packages, read by Spark. texts: text."""
    laws = texts.select(F.from_json("text", _JSON).alias("p")).select(normalize_update_date(F.col("p.UpdateDate")).alias("source_update_date"), F.explode("p.Laws").alias("law"))
    rows = laws.select("source_update_date", "law", F.posexplode("law.LawArticles").alias("ord", "a"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        pcode_of(F.col("law.LawURL")).alias("pcode"), F.col("law.LawName").alias("law_name"), empty("law.LawModifiedDate").alias("law_modified_date"), empty("law.LawEffectiveDate").alias("law_effective_date"),
        to_crlf(empty("law.LawEffectiveNote")).alias("law_effective_note"), "source_update_date", "ord", F.col("a.ArticleType").alias("article_type"), F.col("a.ArticleNo").alias("article_no"), F.col("a.ArticleContent").alias("content"),
    )


class _XmlWalk:
    """Headings and articles in the order in which their elements end, under the fields of their law; a law is given out when its element ends."""

    def __init__(self):
        self.path, self.text, self.rows, self.date = [], {}, [], None

    def start(self, tag: str, attributes: dict) -> None:
        if not self.path:
            self.date = attributes.get("UpdateDate", "")
        self.path.append(tag)
        self.text[len(self.path)] = []
        if tag == _LAW_TAG:
            self.law, self.found = dict.fromkeys(_FIELDS.values(), ""), []
        elif tag == _ARTICLE:
            self.article = {_NUMBER: "", _BODY: ""}

    def data(self, text: str) -> None:
        if self.path:
            self.text[len(self.path)].append(text)

    def end(self, tag: str) -> None:
        text = "".join(self.text.pop(len(self.path))).strip()
        self.path.pop()
        if tag in (_NUMBER, _BODY) and _ARTICLE in self.path:
            self.article[tag] = text
        elif tag in _FIELDS and self.path[-1:] == [_LAW_TAG]:
            self.law[_FIELDS[tag]] = text
        elif tag == _HEADING:
            self.found.append(("C", "", text))
        elif tag == _ARTICLE:
            self.found.append(("A", self.article[_NUMBER], self.article[_BODY]))
        elif tag == _LAW_TAG:
            names = ("url", "law_name", "law_modified_date", "law_effective_date", "law_effective_note")
            self.rows += [(*(self.law[n] for n in names), self.date, i, *x) for i, x in enumerate(self.found)]


def xml_events(texts: DataFrame) -> DataFrame:
    """Events of XML packages. texts: text."""

    def parse(text: str) -> Iterator[tuple]:
        walk, reader = _XmlWalk(), expat.ParserCreate()
        reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = walk.start, walk.end, walk.data
        reader.Parse(text.encode(), True)
        return iter(walk.rows)

    rows = mapped(texts.select("text"), "url string, law_name string, law_modified_date string, law_effective_date string, law_effective_note string, date string, ord int, article_type string, article_no string, content string", parse)
    text = lambda c: F.when(F.col("article_type") == "A", to_crlf(F.col(c))).otherwise(F.col(c))
    return rows.select(pcode_of(F.col("url")).alias("pcode"), "law_name", "law_modified_date", "law_effective_date", to_crlf(F.col("law_effective_note")).alias("law_effective_note"), normalize_update_date(F.col("date")).alias("source_update_date"), "ord", "article_type", "article_no", text("content").alias("content"))


def _inner(piece: str) -> str:
    """What stands in a div whose start tag the piece begins inside of, up to its end tag."""
    return piece[piece.find(">") + 1 :].split("</div>", 1)[0]


def page_parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(type, number, content) of a full-text page in order. The page is cut at its divs; a number waits for the lines of its article."""
    number, lines = None, []

    def done() -> Iterator[tuple[str, str, str]]:
        if number is not None:
            yield "A", number, "\r\n".join(x for x in lines if x)

    for piece in page[max(page.find(_PAGE_BODY), 0) :].split('<div class="')[1:]:
        name = piece.split('"', 1)[0]
        if name.startswith(_PAGE_CHAPTER):
            yield from done()
            number = None
            yield "C", "", _inner(piece).strip()
        elif name == _PAGE_NUMBER:
            yield from done()
            link = re.search(r"flno=[^>]*>([^<]+)</a>", piece)
            number, lines = (link[1].strip() if link else None), []
        elif name.startswith(_PAGE_LINE) and number is not None:
            lines.append(html.unescape(_inner(piece)).strip())
    yield from done()


def page_events(pages: DataFrame) -> DataFrame:
    """Events of full-text pages. pages: text, pcode, update_date."""

    def parse(text: str, pcode: str, date: str) -> Iterator[tuple]:
        name, dated = _TITLE.search(text), _DATED.search(text)
        roc = _ROC.search(dated[1]) if dated else None
        modified = f"{int(roc[1]) + 1911:04d}{int(roc[2]):02d}{int(roc[3]):02d}" if roc else ""
        for i, (kind, number, content) in enumerate(page_parts(text)):
            yield pcode, name[1].strip() if name else "", modified, "", "", date or "", i, kind, number, content

    return mapped(pages.select("text", "pcode", "update_date"), EVENTS, parse)


def events(packages: DataFrame) -> DataFrame:
    """Ordered headings (C) and articles (A) of packages: format (json, xml or html), content (binary), pcode and update_date (for html)."""

    def unpack(kind, content, pcode, date):
        yield kind, text_of(kind, bytes(content)), pcode, date

    texts = mapped(packages.select("format", "content", "pcode", "update_date"), "format string, text string, pcode string, update_date string", unpack)
    of = lambda kind: texts.filter(F.col("format") == kind)
    return json_events(of("json")).unionByName(xml_events(of("xml"))).unionByName(page_events(of("html")))


def wanted(rows: DataFrame, codes: DataFrame) -> DataFrame:
    return rows.join(codes.select("pcode").distinct(), "pcode", "left_semi")


def extract_articles(rows: DataFrame, fetched_at: str | None = None) -> DataFrame:
    """Article rows under their chapter. A blank heading takes the chapter away; articles without number or content are left out. fetched_at: when the packages were read, now by default."""
    heading = F.col("article_type") == "C"
    title = F.trim(F.regexp_replace("content", r"(?U)^\s+|\s+$", ""))
    placed = carried(rows, heading, F.when(title != "", title), "pcode", "ord", name="chapter")
    number, content = normalize_article_no(F.col("article_no")), F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if fetched_at is None else F.lit(fetched_at)
    found = placed.filter(F.col("article_type") == "A").select("law_name", "pcode", "chapter", number.alias("article_no"), content.alias("content"), F.format_string(LAWS_URL, "pcode", number).alias("url"), "law_modified_date", when.alias("fetched_at"), "source_update_date", "ord")
    return found.filter("article_no <> '' and content <> ''")


def law_meta(rows: DataFrame) -> DataFrame:
    """pcode, law_name, article_count, chapter_count and the dates of each law of the events."""
    fine = (F.col("article_type") == "A") & (normalize_article_no(F.col("article_no")) != "") & (F.regexp_replace("content", r"(?U)^\s+|\s+$", "") != "")
    return rows.groupBy("pcode").agg(
        F.max("law_name").alias("law_name"), F.count_if(fine).alias("article_count"), F.count_if(F.col("article_type") == "C").alias("chapter_count"),
        *[F.max(c).alias(c) for c in ("law_modified_date", "law_effective_date", "law_effective_note", "source_update_date")],
    )


def load_first(tiers: list, expected: dict[str, str | None] | list[str]) -> DataFrame:
    """Rows of the first tier (a function that gives events, or raises OSError) in which every expected law has articles and, where given, its name.

    Packages of different dates are an error, not a reason to fall back. expected: codes, or names by code.
    """
    names, problems = expected if isinstance(expected, dict) else dict.fromkeys(expected), []
    for tier in tiers:
        try:
            rows = tier()
        except OSError as e:
            problems.append(str(e))
            continue
        own = law_meta(rows.filter(F.col("pcode").isin(*names)))
        dates = rows.agg(F.min("source_update_date").alias("a"), F.max("source_update_date").alias("b")).first()
        if dates.a != dates.b:
            raise VersionMismatch(f"packages of {dates.a} to {dates.b}")
        seen = {r.pcode: r for r in own.collect()}  # a row an expected law
        missing = sorted(set(names) - set(seen))
        renamed = sorted(p for p, r in seen.items() if names[p] and r.law_name != names[p])
        empty = sorted(p for p, r in seen.items() if not r.article_count)
        if not missing and not renamed and not empty:
            return rows
        problems.append("; ".join(f"laws {what}: {x}" for what, x in (("missing", missing), ("of another name", renamed), ("without articles", empty)) if x))
    raise OSError("; ".join(problems))
