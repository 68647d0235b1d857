"""Main text of pages by wrapper induction.

A page is parsed to blocks of text, each under a node of the page's tree; siblings with one label (tag and classes) are folded
into one node, so that a tree is its layout and no longer than its labels. Pages of a host are aligned by simple tree matching: a wrapper
grows by the nodes that no earlier page had, and each of its nodes counts the block texts seen there. A text that most of a
host's pages share at a node, over several different pages, is constant and so template; varying slots are content. What
elements, roles and class names say (navigation, adverts, forms, comments and so on) is left out as well, inline elements
too, and within a page the article is preferred.

Wrappers are built inside the tasks, a small record a host, and merged by host in two steps; a merge is an alignment too.
A node forgets rare texts and knows how much that may have cost the others; where a host's wrapper has forgotten any, its
candidates are counted exactly in a second pass over the host's pages.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .neardup import groups

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>|([^<]+|<)", re.S)
_REST = re.compile(r"()()()((?:(?!<(?:!--|/?[a-zA-Z])).)*)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# fixed values: elements by their part in a page
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg canvas object select".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("body head html li dd dt td th tr tbody thead tfoot figcaption summary".split())
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_ASIDE = frozenset("nav aside form button footer dialog menu head label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
_WORDS = frozenset("ad ads adsense adsbygoogle adv advert adverts advertisement advertising alert announcement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus respond replies related recommended share sharing social newsletter subscribe subscription signup login search widget toolbar hidden".split())
_AROUND = frozenset("area article articles banner bar block bottom box btn button buttons center col column container content desktop entry fixed form global google group header icon icons inner item items left link links list main media message mobile module outer page panel policy post posts primary region right row secondary section site slot sticky story text title top unit visually wrap wrapper zone".split())
_TOP = frozenset("header site page top main global primary bar inner wrap wrapper container".split())
#: These decide as the last word of a name, unless its first one says that the name is a state of the page.
_HEADS = frozenset("comment comments notice notices advert adverts advertisement advertisements".split())
_STATES = frozenset("no has have with without is not non show enable disable hide".split())
_UNSEEN = frozenset("sr-only screen-reader-text".split())
_SPARED = frozenset("html body main article".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper than this share their parent's node, so that no page makes a tree too deep to walk; their text and flags are those of any other.
DEEPEST = 200


class Node:
    """A node of a folded tree: label and kids; in a wrapper also what was seen there."""

    __slots__ = ("label", "kids", "seen", "lost")

    def __init__(self, label: str):
        self.label, self.kids, self.seen, self.lost = label, [], {}, 0


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip() else {}


@lru_cache(4096)
def described(tag: str, raw: str) -> tuple[str, int, bool, int]:
    """An element's label, whether it is beside the text (2 by what it is, 1 by its class or id), whether it is a header (which is beside the text outside of an article), and its rank as a container of text.

    A class or id speaks for an element beside the text if it consists of such a word and of words for parts of a page, or if
    its last word is one for comments, notices or adverts: `share`, `share-links`, `cookieNotice`, `reader-comments` and
    `legal-notice` do, `share-price`, `hidden-xs`, `no-sidebar`, `has-comments` and `comment-free-zone` don't.
    """
    at = attributes(raw)
    named = [(x.lower(), [w.lower() for w in _NAME.findall(x)]) for x in f"{at.get('class', '')} {at.get('id', '')}".split()]
    label = ".".join([tag, *sorted({w.lower() for w in _NAME.findall(at.get("class", ""))})])
    role, style = at.get("role", "").lower(), at.get("style", "").replace(" ", "").lower()
    aside = 2 * (tag in _ASIDE or role in _ROLES or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style)
    if tag not in _SPARED:
        aside = aside or +any(x in _UNSEEN or beside_text(words) for x, words in named)
    elif tag == "article":
        aside = aside or +any({"comment", "comments"} & {*words} for _, words in named)
    rank = 3 if tag == "article" else 2 if tag == "main" or role == "main" else 0
    header = tag == "header" or (tag not in _SPARED | _HEADINGS and any("header" in words and _TOP.issuperset(words) for _, words in named))
    return label, aside, header, rank


def beside_text(words: list[str]) -> bool:
    if not words:
        return False
    return (not _WORDS.isdisjoint(words) and (_WORDS | _AROUND).issuperset(words)) or (words[-1] in _HEADS and words[0] not in _STATES)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool, int]]]:
    """The page's folded tree and its blocks in order: node, text, whether a heading inside the article, rank of the container (3 article, 2.5 a title beside it, 2 main, 0 page).

    Text of an element beside the text is left out. Only elements that are blocks end a block, so an inline advert or hidden
    span leaves the block around it whole; what is inside an element beside the text ends none.
    """
    root = Node("")
    # tag, node, whether beside the text, rank, place of the element that its text is a block of, whether a heading in the article
    stack: list[tuple[str, Node, int, int, int, bool]] = [("", root, 0, 0, 0, False)]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # the places of open elements by tag
    blocks: list[tuple[Node, str, bool, int]] = []
    buffer: list[str] = []
    where = stack[0]
    folds: dict[tuple[int, str], Node] = {}  # a node's child of each label

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((where[1], text, where[5], where[3]))
            buffer.clear()

    def last_of(tags) -> int:
        return max((opened[x][-1] for x in tags if opened[x]), default=0)

    def close(place: int) -> None:
        while len(stack) > place:
            tag = stack.pop()[0]
            opened[tag].pop()
            if tag in _BLOCK and not stack[-1][2]:
                flush()

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        # behind the last > there is only text, up to a tag or comment that doesn't end
        m = _TOKEN.match(page, at) if at <= last else _REST.match(page, at)
        at = m.end() if at <= last else end
        text, tag = m[4], (m[2] or "").lower()
        if text is not None or tag == "br" and not m[1]:
            if not stack[-1][2]:
                if not buffer:
                    where = stack[stack[-1][4]]
                buffer.append(" " if text is None else html.unescape(text) if "&" in text else text)
            continue
        if not tag:
            continue
        if m[1]:
            if place := last_of((tag,)):
                close(place)
            continue
        if tag in _VOID:
            if tag == "hr" and not stack[-1][2]:
                flush()
            continue
        if tag in _RAW:
            if not m[3].endswith("/") or tag not in ("svg", "iframe"):
                found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = found.end() if found else (end if tag in ("script", "style", "template") else at)
            continue
        if tag in _ENDS_P and opened["p"]:
            close(last_of(("p",)))
        elif tag in _ENDS:
            closes, limits = _ENDS[tag]
            place = last_of(closes)
            if place > last_of(limits):
                close(place)
        label, aside, header, rank = described(tag, m[3])
        up = stack[-1]
        if header and not last_of(("article", "main")):
            aside = 2
        if tag in _BLOCK and not up[2]:
            flush()
        # a main element inside one with the class sidebar-left or so shows that the class spoke of the layout
        parent, beside = up[1], aside if up[2] == 1 and tag == "main" else max(up[2], aside)
        if tag == "h1" and up[3] == 2:  # a title beside the article
            rank = 2.5
        if len(stack) >= DEEPEST:
            node = parent
        elif (node := folds.get((id(parent), label))) is None:
            parent.kids.append(node := Node(label))
            folds[id(parent), label] = node
        opened[tag].append(len(stack))
        stack.append((tag, node, beside, max(up[3], rank), len(stack) if tag in _BLOCK else up[4], tag in _HEADINGS and up[3] >= 2))
    flush()
    return root, blocks


def skeleton(node: Node) -> tuple:
    """The folded tree as nested tuples, to compare and remember layouts."""
    return (node.label, *(skeleton(k) for k in node.kids))


@lru_cache(1 << 16)
def matching(a: tuple, b: tuple) -> int:
    """Simple tree matching: nodes in the largest match of two trees that keeps labels, order and ancestors."""
    return 1 + best_pairs(a[1:], b[1:])[0] if a[0] == b[0] else 0


def best_pairs(a: tuple, b: tuple) -> tuple[int, tuple | None]:
    """The most nodes that pairs of children can match in order, and the pairs as a chain from the last: (i, j, the rest).

    Only children of one label can be a pair. So instead of a table of all places, pairs are met by label in the order of a,
    and a tree of prefix maxima over b's places gives the best chain that each can go on from.
    """
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j][0], []).append(j)
    top: list[tuple[int, tuple | None]] = [(0, None)] * (len(b) + 1)
    for i, x in enumerate(a):
        for j in places.get(x[0], ()):  # from the last, so that no chain holds i twice
            size, chain = 0, None
            k = j
            while k:
                if top[k][0] > size:
                    size, chain = top[k]
                k &= k - 1
            new, k = (size + matching(x, b[j]), (i, j, chain)), j + 1
            while k <= len(b):
                if top[k][0] < new[0]:
                    top[k] = new
                k += k & -k
    size, chain, k = 0, None, len(b)
    while k:
        if top[k][0] > size:
            size, chain = top[k]
        k &= k - 1
    return size, chain


def aligned(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Places of the children of a and b that the largest match pairs."""
    chain, out = best_pairs(a[1:], b[1:])[1], []
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


class Wrapper:
    """A host's merged layout. At each node: texts by hash, with the number of pages and a few smallest page hashes.

    A node with more than `most` texts forgets rare ones as long as no text's count can be short by more than
    tolerance * pages; until then it grows. An exact wrapper counts its candidates and forgets nothing.
    """

    most, sample = 24, 3

    def __init__(self, tolerance: float = 0.3):
        self.root, self.pages, self.maps, self.tolerance, self.exact = Node(""), 0, {}, tolerance, False

    def place(self, layout: tuple, grow: bool) -> list[Node | None]:
        """The wrapper's node for each node of the layout, in document order; where it has none it grows or gives None."""
        if layout not in self.maps:
            if len(self.maps) > 500:
                self.maps.clear()
            out: list[Node | None] = []
            self._place(self.root, layout, out, grow)
            self.maps[layout] = out
        return self.maps[layout]

    def _place(self, node: Node | None, layout: tuple, out: list, grow: bool) -> None:
        out.append(node)
        if node is None:
            for kid in layout[1:]:
                self._place(None, kid, out, grow)
            return
        pairs = {j: i for i, j in aligned(skeleton(node), layout)} if node.kids else {}
        found: list[Node | None] = [node.kids[pairs[j]] if j in pairs else Node(kid[0]) if grow else None for j, kid in enumerate(layout[1:])]
        if grow and len(pairs) < len(found):
            kids, at = [], 0
            for j, x in enumerate(found):  # a new node comes right behind the one before it
                if j in pairs:
                    kids += node.kids[at : pairs[j]]
                    at = pairs[j] + 1
                kids.append(x)
            node.kids = kids + node.kids[at:]
        for x, kid in zip(found, layout[1:]):
            self._place(x, kid, out, grow)

    @staticmethod
    def note(node: Node, text: int, pages: int, which: tuple[int, ...]) -> None:
        n, seen = node.seen.get(text, (0, ()))
        node.seen[text] = (n + pages, tuple(sorted({*seen, *which})[: Wrapper.sample]))

    def forget(self, node: Node) -> None:
        """When a node has too many texts, all lose what the rarest have (Misra and Gries), within the tolerance."""
        if self.exact or len(node.seen) <= self.most:
            return
        least = int(min(self.tolerance * self.pages - node.lost, min(n for n, _ in node.seen.values())))
        if least >= 1:
            node.lost += least
            node.seen = {t: (n - least, w) for t, (n, w) in node.seen.items() if n > least}

    def candidates(self, share: float) -> Wrapper:
        """Of the same layout, to count exactly: every text that may be on `share` of the pages, from zero."""
        out = Wrapper.load(self.dump())
        for node in walk(out.root):
            node.seen, node.lost = {t: (0, ()) for t, (n, _) in node.seen.items() if n + node.lost >= share * self.pages}, 0
        out.pages, out.exact = 0, True
        return out

    def add(self, page: str) -> None:
        """Takes the page in; an exact wrapper counts its candidates there."""
        root, blocks = parse(page)
        places = self.place(skeleton(root), not self.exact)
        of = {id(x): w for x, w in zip(walk(root), places)}
        which = (xxhash.xxh3_64_intdigest("\n".join(b[1] for b in blocks)),)
        self.pages += 1
        # by the wrapper's node, as several nodes of a page may have one place
        for node, text in {(of[id(b[0])], hashed(b[1])) for b in blocks}:
            if not self.exact or (node is not None and text in node.seen):
                self.note(node, text, 1, which)
        if not self.exact:
            for node in {of[id(b[0])] for b in blocks}:
                self.forget(node)

    def merge(self, other: Wrapper) -> None:
        self.exact = other.exact
        self.pages += other.pages
        for mine, theirs in zip(self.place(skeleton(other.root), True), walk(other.root)):
            for text, (n, which) in sorted(theirs.seen.items()):
                self.note(mine, text, n, which)
            mine.lost += theirs.lost
            self.forget(mine)

    def dump(self) -> bytes:
        flat = lambda x: (x.label, x.seen, x.lost, [flat(k) for k in x.kids])
        return pickle.dumps((self.pages, self.tolerance, self.exact, flat(self.root)))

    @staticmethod
    def load(data: bytes) -> Wrapper:
        def node(x):
            out = Node(x[0])
            out.seen, out.lost, out.kids = x[1], x[2], [node(k) for k in x[3]]
            return out

        out = Wrapper()
        out.pages, out.tolerance, out.exact, tree = pickle.loads(data)
        out.root = node(tree)
        return out

    def constant(self, node: Node | None, text: str, share: float, least: int) -> bool:
        if node is None or self.pages < least:
            return False
        n, which = node.seen.get(hashed(text), (0, ()))
        return n >= share * self.pages and len(which) >= self.sample


def walk(node: Node) -> Iterator[Node]:
    yield node
    for k in node.kids:
        yield from walk(k)


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def main_text(page: str, wrapper: Wrapper | None, share: float = 0.6, least: int = 5) -> str:
    """The page's blocks that the wrapper doesn't call constant. Headings inside the article stay however often a host has them.

    Of the blocks only those in the best container stay: the articles, where main's text outside of them is no longer than
    theirs, else main with what is in it, else the page.
    """
    root, blocks = parse(page)
    if wrapper is not None and wrapper.pages >= least:
        of = {id(x): w for x, w in zip(walk(root), wrapper.place(skeleton(root), False))}
        blocks = [b for b in blocks if b[2] or not wrapper.constant(of[id(b[0])], b[1], share, least)]
    sizes: defaultdict[float, int] = defaultdict(int)
    for _, text, _, rank in blocks:
        sizes[rank] += len(text)
    least = 2.5 if sizes[3] and sizes[3] >= sizes[2] else 2 if sizes[2] or sizes[2.5] else 3 if sizes[3] else 0
    return "\n\n".join(b[1] for b in blocks if b[3] >= least)


def merged(parts: DataFrame) -> DataFrame:
    """One wrapper for each host. parts: host, slot, wrapper."""

    def merge(batches):
        for rows_ in groups(batches, 2):
            total = None
            for _, _, data, _ in rows_:
                now = Wrapper.load(data)
                total = total or Wrapper(now.tolerance)
                total.merge(now)
            yield dumped({rows_[0][0]: total}, 0)

    for keys in (("host", "slot"), ("host",)):
        parts = parts.repartition(*keys).sortWithinPartitions("host", "slot").mapInArrow(merge, _PARTS)
    return parts.select("host", "wrapper", "lost")


_PARTS = "host string, slot int, wrapper binary, lost boolean"


def dumped(found: dict[str, Wrapper], part: int) -> pa.RecordBatch:
    lost = [any(n.lost for n in walk(w.root)) for w in found.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([part % 64] * len(found), pa.int32()), pa.array([w.dump() for w in found.values()], pa.binary()), pa.array(lost, pa.bool_())], ["host", "slot", "wrapper", "lost"])


def wrappers(pages: DataFrame, share: float = 0.6, most_bytes: int = 32 << 20) -> DataFrame:
    """host and wrapper (pickled) of each host. pages: host, html. Pages without a host share no layout and bring none."""

    def build(batches):
        found: dict[str, Wrapper] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for host, page in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in found:
                    found[host] = Wrapper(share / 2)
                found[host].add(page or "")
            if len(found) > 20_000:
                yield dumped(found, part)
                found.clear()
        yield dumped(found, part)

    pages = pages.filter("host <> ''").select("host", "html")
    found = staged(merged(pages.mapInArrow(build, _PARTS)), "wrappers")
    short = found.filter("lost").select("host", "wrapper")
    if short.isEmpty():
        return found.select("host", "wrapper")
    rows, get = beside(pages.join(F.broadcast(short.select("host")) if within(short, most_bytes) else short.select("host"), "host", "left_semi"), short, most_bytes)

    def count(batches):
        now: dict[str, Wrapper] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for host, page, data in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in now:
                    if len(now) > 5000:
                        yield dumped(now, part)
                        now.clear()
                    now[host] = Wrapper.load(get(host, data)).candidates(share)
                now[host].add(page or "")
        yield dumped(now, part)

    counted = merged(rows.select("host", "html", "wrapper").mapInArrow(count, _PARTS)).select("host", "wrapper")
    return staged(found.filter("not lost").select("host", "wrapper").unionByName(counted), "counted")


def within(found: DataFrame, most_bytes: int) -> bool:
    return (found.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= most_bytes


def beside(rows: DataFrame, found: DataFrame, most_bytes: int):
    """rows with a column wrapper, and how a task gets a host's: from a broadcast up to most_bytes, else joined by host."""
    if within(found, most_bytes):
        sent = rows.sparkSession.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in found.collect()})
        return rows.withColumn("wrapper", F.lit(None).cast("binary")), lambda host, data: sent.value.get(host)
    return rows.join(found, "host", "left"), lambda host, data: data


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.6, most_bytes: int = 32 << 20) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    A null html counts as empty and gives an empty text. A host with fewer than five pages, and pages without a host, are
    read without a wrapper. Repeated rows are read each, and copies of one page don't make its text constant. Wrappers are
    broadcast up to most_bytes and joined by host beyond. An empty table gives an empty result; other columns are ignored.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    rows, get = beside(rows, wrappers(rows, share, most_bytes), most_bytes)
    known: dict[str, Wrapper] = {}

    def run(batches):
        for batch in batches:
            out = []
            for host, page, data in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("host", "html", "wrapper"))):
                if host not in known:
                    data = get(host, data)
                    if len(known) > 5000:
                        known.clear()
                    known[host] = Wrapper.load(data) if data else None
                out.append(main_text(page or "", known[host], share))
            cols = [batch.column(batch.schema.get_field_index(k)) for k in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.select("page_id", "url", "host", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
