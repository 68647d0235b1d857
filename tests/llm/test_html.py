import random
import time
from html.parser import HTMLParser

import pytest

from corpuswright.llm import html_extract as H


def page(r, i, words):
    w = lambda k: " ".join(r.choices(words, k=k))
    title, ps = w(5), [w(r.randrange(4, 30)) for _ in range(r.randrange(1, 5))]
    head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
    body = f"<body class='page has-sidebar'><header><h2>Site</h2></header><nav><ul>{''.join(f'<li><a href=/x>{w(1)}</a></li>' for _ in range(r.randrange(1, 5)))}</ul></nav><!-- no <p> -->"
    body += f"<div class='cookie-notice'>We use {i} cookies</div><div class=ad>{w(3)}</div>"
    body += f"<div class='text'><h1>{title}</h1><p>Read on our fine site.</p>{''.join(f'<p>{p} &amp; <b>x</b>{chr(10)} y<br>z' for p in ps)}</div>"
    body += f"<section id='comments'><p>{w(4)}</p></section><form><input value=1> Name <button>Go</button></form><footer>&copy; {w(3)}</footer></body></html>"
    return head + body, "\n\n".join([title, *(f"{p} & x y z" for p in ps)])


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_pages_without_an_article(spark, most_bytes):
    r = random.Random(1)
    words = "lorem ipsum dolor sit amet Ünï consectetur".split()
    made = [page(r, i, words) for i in range(60)]
    rows = [(i, f"http://h{i % 2}.org/{i}", m[0]) for i, m in enumerate(made)]
    rows += [(100, None, None), (101, "http://h0.org/", ""), (101, "http://h0.org/", ""), (102, "no url", "<p>just &lt;this&gt;"), (None, "http://solo.org/", "<p>a\n b<div>c</div>d")]
    pages = spark.createDataFrame([(*x, "h", b"w") for x in rows], "page_id long, url string, html string, host string, wrapper binary").repartition(4)
    got = {}
    for x in H.extract(pages, most_bytes=most_bytes).collect():
        got.setdefault(x.page_id, []).append(x)
    for i, (_, text) in enumerate(made):
        assert got[i][0].text == text and got[i][0].n_chars == len(text)
    assert got[100][0].text == "" and got[100][0].url is None and len(got[101]) == 2
    assert got[102][0].text == "just <this>" and got[None][0].text == "a b\n\nc\n\nd"
    assert H.extract(pages.limit(0)).collect() == []


def test_articles_and_roles():
    main = "<div class='menu-top'>m</div><main><p>intro</p><article class=post><header><h1>T</h1></header><p>a<aside>s</aside><p>b<ul><li>one<li>two</ul><div class='share-links'>s</div><p hidden>h</p></article><article class=comment>c</article></main>"
    assert H.main_text(main, None) == "T\n\na\n\nb\n\none\n\ntwo"
    assert H.main_text("<div class='site-header'>x</div><h1 class='page-header'>T</h1><div class='alert'>n</div><article><div class='header'>h</div>a</article>", None) == "h\n\na"
    assert H.main_text("<div id='header'>x</div><h1 class='page-header'>T</h1><p>a</p>", None) == "T\n\na"
    assert H.main_text("<p>a <span>b</span>c<p>d</b></p>e < f &nbsp; g", None) == "a bc\n\nd\n\ne < f g"
    assert H.main_text("<script>x<p>y</p>", None) == "" and H.main_text("<!-- open <p>x</p>", None) == ""
    assert H.main_text("<table><tr><td>1<td>2<tr><td>3</table>", None) == "1\n\n2\n\n3"
    assert H.main_text("<pre>" + "x " * 100_000, None).count("x") == 100_000


def test_deep_and_broken_pages():
    w = H.Wrapper()
    for page in ("<div>" * 5000 + "x" + "</div>" * 9000 + "y", "<b>" * 20_000 + "x<p>y", "<p><i>" * 3000 + "x<p>y", "<" * 10_000 + "<p>x", "</p></div>x<p>y", '<p title="a>x</p><p>y', "<p>x" + "<a " * 50_000, "<p>x" + "<a '" * 50_000, "<p>x" + "<!--" * 30_000, "x<p>y<"):
        w.add(page)
        own = H.Wrapper()
        own.add(page)
        assert H.main_text(page, H.Wrapper.load(own.dump())) and H.main_text(page, H.Wrapper.load(w.dump())) is not None


def test_what_does_not_end_is_left_out():
    for page, text in (("<p>x<!-- hidden", "x"), ("<p>x<div class='a", "x"), ("<p>a < b", "a < b"), ("x", "x"), ("<p>x</p", "x"), (">", ">"), ("<p", "")):
        assert H.main_text(page, None) == text


def test_copies_are_not_constant():
    w = H.Wrapper()
    for _ in range(50):
        w.add("<div><p>the same text</p></div>")
    assert H.main_text("<div><p>the same text</p></div>", w) == "the same text"


def test_simple_tree_matching_against_brute_force():
    r = random.Random(2)

    def tree(d):
        return (r.choice("abc"), *(tree(d - 1) for _ in range(r.randrange(0, 3) if d else 0)))

    def brute(a, b):
        def best(x, y):
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute(x[0], y[0]))

        return 1 + best(a[1:], b[1:]) if a[0] == b[0] else 0

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert H.matching(a, b) == brute(a, b)


def test_merge_is_like_adding():
    r = random.Random(4)
    pages = [page(r, i, ["u", "v", "w"])[0] for i in range(30)]
    one, parts = H.Wrapper(), [H.Wrapper() for _ in range(3)]
    for i, p in enumerate(pages):
        one.add(p)
        parts[i % 3].add(p)
    total = H.Wrapper()
    for p in parts:
        total.merge(H.Wrapper.load(p.dump()))
    assert total.pages == one.pages == 30
    assert [H.main_text(p, one) for p in pages] == [H.main_text(p, total) for p in pages]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_a_notice_among_many_paragraphs(spark, most_bytes):
    """A notice on 70 % of a host's pages goes, one on half of them stays, with 40 other paragraphs a page."""
    rows, want = [], {}
    for i in range(200):
        ps = [f"page {i} paragraph {k}" for k in range(40)]
        want[i] = "\n\n".join([*ps, *["Half of the pages."] * (i % 2)])
        notes = ["On most pages."] * (i % 10 < 7) + ["Half of the pages."] * (i % 2)
        rows.append((i, f"http://h.org/{i}", "<div>" + "".join(f"<p>{x}</p>" for x in [*ps[:20], *notes[:-1], *ps[20:], *notes[-1:]]) + "</div>"))
        if len(notes) == 1 and i % 10 < 7 and not i % 2:
            want[i] = "\n\n".join(ps)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x.page_id: x.text for x in H.extract(pages, most_bytes=most_bytes).collect()}
    assert got == want


def test_what_is_forgotten_is_bounded():
    w = H.Wrapper()
    for i in range(300):
        w.add("<div>" + "".join(f"<p>{x}</p>" for x in ["notice", *(f"{i} {k}" for k in range(50))]) + "</div>")
    nodes = [n for n in H.walk(w.root) if n.seen]
    assert all(0 < n.lost <= 0.3 * 300 and len(n.seen) < 1000 for n in nodes)
    assert any(n.seen[H.hashed("notice")][0] + n.lost >= 300 for n in nodes)


def test_below_the_deepest_node():
    deep, out = "<div>" * 250, "</div>" * 250
    assert H.main_text(f"<div id=page><article><p>first</p>{deep}in{out}<p>rest</p></article>after</div>", None) == "first\n\nin\n\nrest"
    assert H.main_text(f"<article>{deep}<nav>n<b>m</b></nav>a<div class=ad>b<p>c</p></div>d{out}e</article>", None) == "a\n\nd\n\ne"
    n = 30_000  # in linear time
    for page in ("<dl><dt><dl>" + "<b>" * n + "<dt>x</dt>" * n, "<b>" * n + "x<i>y</i>" * n, "<div>" * n + "<p>x" * n + "</div>" * n):
        assert H.parse(page)[1]


def test_inline_elements_beside_the_text():
    """They go without ending the block around them."""
    for inner in ("<span hidden>X</span>", "<a class=ad href=x>X</a>", "<button>X</button>", "<label>X</label>", "<span class='cookie-notice'>X</span>", "<span style='display: none'>X</span>", "<i aria-hidden=true>X</i>", "<span class=adBox><b>X</b> Y</span>", "<b class='sr-only'>X</b>"):
        assert H.main_text(f"<article><p>a {inner} b</p><p>c{inner}d</p>{inner}e</article>", None) == "a b\n\ncd\n\ne", inner
    assert H.main_text("<div>a <span hidden><div>X</div><br>Y<hr></span> b</div>", None) == "a b"
    assert H.main_text("<p>a<div class=ad>X</div>b", None) == "a\n\nb"


def test_class_names():
    for name in ("social-science", "share-price", "related-work", "hidden-xs", "no-sidebar", "has-menu", "comment-free-zone", "adder", "section-header", "story", "post-meta"):
        assert H.main_text(f"<p>a</p><div class='x {name}'><p>b</p></div>", None) == "a\n\nb", name
    for name in ("social", "share-links", "shareButtons", "related-posts", "hidden", "sidebar-left", "menu-top", "post-comments", "google-ad", "ad_slot", "site-header", "no-print ad"):
        assert H.main_text(f"<p>a</p><div class='x {name}'><p>b</p></div>", None) == "a", name
    assert H.main_text("<div class='page sidebar-left'><div>x</div><main><p>a</p></main></div>", None) == "a"
    assert H.main_text("<p>a</p><div class=content><p>b</p></div>", None) == "a\n\nb"
    assert H.main_text("<main><h1>T</h1><p>x</p><article><p>a</p></article></main>", None) == "T\n\na"


def test_recurring_headings_stay():
    w = H.Wrapper()
    pages = [f"<h2>Site</h2><article><h1>t{i}</h1><h2>Summary</h2><p>s{i}</p><p>Read on.</p><h2><i>Details</i></h2><p>d{i}</p></article>" for i in range(20)]
    for p in pages:
        w.add(p)
    assert [H.main_text(p, w) for p in pages] == [f"t{i}\n\nSummary\n\ns{i}\n\nDetails\n\nd{i}" for i in range(20)]


def test_deep_articles():
    for n in (250, 5000):
        inside = "<div>" * n + "in" + "</div>" * n
        assert H.main_text(f"<div class=page><article><p>first</p>{inside}<p>tail</p></article></div>", None) == "first\n\nin\n\ntail"
        assert H.main_text("<div>" * n + "<nav>x</nav><p>a <b hidden>x</b>b" + "</div>" * n + "<p>c", None) == "a b\n\nc"


class Dom(HTMLParser):
    """Well-formed pages as trees: [tag, attributes, children]."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack = [["", {}, []]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        now = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(now)
        if tag != "br":
            self.stack.append(now)

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        self.stack[-1][2].append(data)


BLOCKS, GONE = ("div", "p", "h1", "h2", "article", "main", "ul", "li", "section", "nav", "aside", "footer", "header", "form", "body"), ("nav", "aside", "footer", "form", "button", "label", "script")
GONE_CLASSES = ("ad", "share-links", "comments", "reader-comments", "userComments", "legal-notice", "top_notice", "comment-list", "text-advert")


def brute(page):
    """What main_text should give without a wrapper, from a tree: blocks of text with the container that each is in, of which one kind is chosen."""
    out = []  # text and container, or None where a block ends

    def write(x, kind, gone):
        """gone: 2 below what is beside the text by its kind, 1 by its class alone, which a main element in it overrules."""
        if isinstance(x, str):
            if not gone:
                out.append((x, kind))
            return
        tag, at, kids = x
        if tag == "br":
            if not gone:
                out.append((" ", kind))
            return
        edge = tag in BLOCKS and not gone
        if edge:
            out.append(None)
        own = 2 if tag in GONE or "hidden" in at or (tag == "header" and kind == "page") else 1 if at.get("class") in GONE_CLASSES else 0
        gone = own if gone == 1 and tag == "main" else max(gone, own)
        kind = "article" if "article" in (tag, kind) else "main" if "main" in (tag, kind) and tag != "h1" else "title" if kind in ("main", "title") else kind
        for k in kids:
            write(k, kind, gone)
        if edge:
            out.append(None)

    write(Dom(page).stack[0], "page", 0)
    blocks, now = [], []
    for x in [*out, None]:
        if x is not None:
            now.append(x)
        elif now:
            text = " ".join("".join(t for t, _ in now).split())
            if text:
                blocks.append((text, now[0][1]))
            now = []
    size = lambda kind: sum(len(t) for t, k in blocks if k == kind)
    held = {k for _, k in blocks}
    if "article" in held and size("article") >= size("main"):
        chosen = {"article", "title"}
    elif held & {"main", "title"}:
        chosen = {"article", "main", "title"}
    else:
        chosen = held
    return "\n\n".join(t for t, k in blocks if k in chosen)


def test_against_a_tree_of_the_page():
    r = random.Random(8)
    words = ["a", "b &amp; c", "é", "x\n y", " ", "&lt;p&gt;", "1&nbsp;2", "a long run of words"]
    marks = ["", "", "", "", " hidden", *(f" class='{c}'" for c in GONE_CLASSES), " class=ad", " class='share-price'", " class=body", " id='x'", " class=no-comments", " class='comment-free-zone'", " title=it's", " title=\"it's > that\"", " title='a \"b\" > c'", " data-x=a'b'c\"d class=body"]

    def inline(d):
        if d == 0 or r.random() < 0.5:
            return r.choice([*words, "<br>"])
        tag = r.choice(["b", "i", "span", "a", "button", "label"])
        return f"<{tag}{r.choice(marks)}>{''.join(inline(d - 1) for _ in range(r.randrange(3)))}</{tag}>"

    def block(d, inside=()):
        if d == 0 or r.random() < 0.3:
            tag = r.choice(["p", "p", "h1", "h2"])
            return f"<{tag}{r.choice(marks)}>{' '.join(inline(2) for _ in range(r.randrange(4)))}</{tag}>"
        tag = r.choice(["div", "div", "section", "ul", "nav", "aside", "footer", "header", "form", "div" if "article" in inside else "article", "div" if inside else "main"])
        own = (*inside, tag) if tag in ("article", "main") else inside
        kids = (f"<li>{inline(2)}</li>" if tag == "ul" else r.choice([inline(1), block(d - 1, own), block(d - 1, own)]) for _ in range(r.randrange(4)))
        return f"<{tag}{r.choice(marks) if tag not in ('article', 'main') else ''}>{''.join(kids)}</{tag}>"

    kinds = set()
    for _ in range(6000):
        page = f"<html><body>{''.join(block(4) for _ in range(r.randrange(1, 5)))}<script>var a='<p>';</script></body></html>"
        want = brute(page)
        assert H.main_text(page, None) == want, page
        kinds.add(("<main" in page, "<article" in page, bool(want)))
    assert len(kinds) == 8


def test_main_with_a_teaser():
    assert H.main_text("<main><p>Long text of the page.</p><article><p>teaser</p></article></main>", None) == "Long text of the page.\n\nteaser"
    assert H.main_text("<main><h1>T</h1><p>x</p></main>", None) == "T\n\nx"
    assert H.main_text("<p>out</p><main><article><p>The text itself.</p></article><p>More</p></main>", None) == "The text itself."


def test_names_of_comments_and_notices():
    for name in ("user-comments", "reader-comments", "legal-notice", "siteNotice", "comment-list", "comments-list", "inline_advert"):
        assert H.main_text(f"<p>a</p><div class='{name}'><p>b</p></div>", None) == "a", name
    for name in ("has-comments", "no-notice", "comment-free-zone", "noticeable", "commentary"):
        assert H.main_text(f"<p>a</p><div class='{name}'><p>b</p></div>", None) == "a\n\nb", name


def test_quotes_inside_values():
    assert H.main_text("<p title=it's>one</p>", None) == "one"
    assert H.main_text("<p title=it's class=ad>one</p><p>two", None) == "two"
    assert H.main_text("<p title = 'a>b' class = \"body\">one</p>", None) == "one"
    for page in ("<p " + "a='" * 40_000 + ">x", "<p " + "=" * 40_000 + ">x", '<a ="' * 40_000 + ">x", "<p " + "= " * 40_000):  # in linear time
        H.main_text(page, None)


def test_long_pages_are_aligned_in_time():
    began, w, n = time.time(), H.Wrapper(), 10_000
    w.add("<div>" + "<h3>a</h3><p>b</p>" * n + "</div>")
    w.add("<div>" + "<h3>a</h3><p>b</p><ul><li>x</ul>" * n + "</div>")
    for k in range(2):  # labels of which half are new, in another order
        w.add("<div>" + "".join(f"<p class={'abcdefghij'[i % 10]}{'klmnop'[i // 10 % 6]}{'qrstuvw'[i // 60 % 7]}{chr(97 + i // 420)}{'xy'[(i + k) % 2]}>t</p>" for i in sorted(range(n), key=lambda i: (i % (3 + k), i))) + "</div>")
    assert time.time() - began < 15
