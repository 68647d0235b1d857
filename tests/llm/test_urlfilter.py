import random
import re

import pytest

from corpuswright.llm import urlfilter
from corpuswright.llm.urlfilter import Rule, judge

RULES = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


ODD = [None, "", "nothing", "http://", "://x", "HTTP://A.Example.ORG/en/12?x=/es/", "https://example.org", "http://org/", "http://borg/", "http://x.com/de/1#a/b", "http://x.com/FR/2", "http://É.com/de/", "a://b://c/d", "http://h.net/a\nb/c?d", "//x.com/de/1", "http://x.com?/de/", "http://x.com:80/de/7", "http://u@x.com/de/", "http://deep.net/" + "a/" * 400, "http://long.net/" + "x" * 100_000]


def test_rules_and_parts(spark):
    rows = list(enumerate(ODD)) + [(99, ODD[9]), (99, ODD[9]), (None, ODD[5])]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = judge(pages, rules=RULES).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute(u)) for i, u in rows), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=repr) == want
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert judge(pages.limit(0), rules=RULES).collect() == []


def test_templates_learn_from_labels(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        host, branch = r.choice(["a.net", "b.net"]), r.choice(["news", "ads", "user"])
        tail = {"news": f"{r.randrange(10**5)}.html", "ads": f"x{r.randrange(10**4)}/click", "user": "name" + "".join(r.choices("abcdef", k=6))}[branch]
        label = None if r.random() < 0.5 or host == "b.net" and branch == "news" else "block" if branch == "ads" else "allow"
        rows.append((i, f"http://{host}/{branch}/{tail}", label, branch))
    pages = spark.createDataFrame(rows, "page_id long, url string, known string, branch string").repartition(3)
    got = {x.page_id: x for x in judge(pages, labels=pages["known"]).collect()}
    for i, _, _, branch in rows:
        assert got[i].verdict == ("block" if branch == "ads" else "allow"), (rows[i], got[i])
    assert {got[i].template for i, *_, b in rows if b == "user"} == {"/user/{var}"}
    assert {got[i].template for i, *_, b in rows if b == "news"} == {"/news/{num}.html"}


@pytest.mark.parametrize("labels", [None])
def test_without_any_label(spark, labels):
    pages = spark.createDataFrame([(1, "http://a.net/x/1"), (2, None)], "page_id long, url string")
    assert {x.verdict for x in judge(pages).collect()} == {"allow"}


def test_branches_that_differ_deep_down(spark, monkeypatch):
    """Labels tell apart what differs only at the fifteenth level, and templates are those of reading level by level."""
    up = "/".join("abcdefghijklmn")
    rows = [(i, f"http://a.net/{up}/{('bad', 'good')[i % 2]}/{i}/" + "x" * (i % 3) + "/" + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (i % 2), ("block", "allow")[i % 2] if i < 60 else None) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, known string").repartition(3)
    got = {x.page_id: x for x in judge(pages, labels=pages["known"], most_children=5).collect()}
    assert all(got[i].verdict == ("block", "allow")[i % 2] for i in range(120))
    assert got[1].template == f"/{up}/good/{{num}}/x/{{var}}" and got[0].template == f"/{up}/bad/{{num}}//"
    monkeypatch.setattr("corpuswright.llm.urlfilter.DEPTH", 99)
    level = {x.page_id: x for x in judge(pages, labels=pages["known"], most_children=5).collect()}
    assert {i: x.template for i, x in got.items()} == {i: x.template for i, x in level.items()}


def brute_shape(seg):
    m = re.search(r"\.[A-Za-z][A-Za-z0-9]{0,5}$", seg)
    ext = m[0] if m else ""
    stem = seg[: len(seg) - len(ext)]
    for pattern, name in ((r"[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", "{date}"), (r"[0-9]+", "{num}")):
        if re.fullmatch(pattern, stem):
            return name, ext
    if any(c in "0123456789" for c in stem):
        return ("{hex}" if re.fullmatch(r"[0-9a-fA-F-]{8,}", stem) else "{mix}"), ext
    return "", seg.replace("{", "%7B").replace("}", "%7D")


def brute_verdicts(pages, most, weight, like, reject):
    """{page: (template, share, verdict)} from one tree a host, built and judged by recursion over whole lists of pages."""
    known = [label for *_, label in pages if label]
    prior = (known.count("block") + 1) / (len(known) + 2) if known else 0.0
    out = {}

    def evidence(rows):
        return sum(x[2] == "block" for x in rows), sum(x[2] is not None for x in rows)

    def children(rows, level):
        rows = [x for x in rows if len(x[1]) > level]
        names = {}
        for x in rows:
            a, b = x[1][level]
            names.setdefault(a, set()).add(b)
        kids = {}
        for x in rows:
            a, b = x[1][level]
            kids.setdefault((a + ".{ext}" if a else "{var}") if len(names[a]) > most else a + b, []).append(x)
        return kids

    def alike(group, kid, level):
        (b1, n1), (b2, n2) = evidence([x for g in group for x in g]), evidence(kid)
        if not n1 or not n2:
            return False
        p = (b1 + b2) / (n1 + n2)
        if abs(b1 / n1 - b2 / n2) > 1.96 * (p * (1 - p) * (1 / n1 + 1 / n2)) ** 0.5:
            return False
        x, y = {k for g in group for k in children(g, level + 1)}, set(children(kid, level + 1))
        return not x | y or len(x & y) / len(x | y) >= like

    def walk(rows, level, share, template):
        for x in rows:
            if len(x[1]) == level:
                out[x[0]] = ("/" + "/".join(template), round(share, 9), "block" if share >= reject else "allow")
        groups = []
        kids = children(rows, level)
        for name in sorted(kids):
            group = next((g for g in groups if alike([kids[k] for k in g], kids[name], level)), None)
            if group is None:
                groups.append([name])
            else:
                group.append(name)
        for g in groups:
            b, n = evidence([x for k in g for x in kids[k]])
            for k in g:
                walk(kids[k], level + 1, (b + weight * share) / (n + weight), [*template, k])

    hosts = {}
    for i, url, label in pages:
        host, path = url.split("://")[1].split("/", 1)
        hosts.setdefault(host, []).append((i, [brute_shape(x) for x in path.split("/")], label))
    for rows in hosts.values():
        b, n = evidence(rows)
        walk(rows, 0, (b + weight * prior) / (n + weight), [])
    return out


@pytest.mark.parametrize("depth", [12, 1])
def test_method_against_a_brute_force_tree(spark, monkeypatch, depth):
    monkeypatch.setattr(urlfilter, "DEPTH", depth)
    r = random.Random(11)
    words = ["news", "ads", "shop", "{x}", "", "2024-01", "a.html", "b.php", "deadbeef12", "v2", "77", "8.jpg", "x1.gif"]
    rows = []
    for i in range(900):
        segs = [r.choice(words[:5])] + [r.choice(words) if r.random() < 0.6 else r.choice(["{}", "{}.x{}", "p{}.html", "w" + "abcdefgh"[i % 8] * (i % 5)]).format(i % 70, i % 30) for _ in range(r.randrange(4))]
        bad = ("ads" in segs) if r.random() < 0.9 else r.random() < 0.5
        rows.append((i, f"http://h{r.randrange(3)}.net/{'/'.join(segs)}", None if r.random() < 0.4 else "block" if bad else "allow"))
    pages = spark.createDataFrame(rows, "page_id long, url string, known string").repartition(3)
    got = {x.page_id: (x.template, round(x.share, 9), x.verdict) for x in judge(pages, labels=pages["known"], most_children=5, reject=0.7).collect()}
    assert got == brute_verdicts(rows, 5, 5.0, 0.5, 0.7)
    assert {v for *_, v in got.values()} == {"allow", "block"}


def test_extensions_and_braces(spark):
    rows = [(i, f"http://a.net/{i}.x{i}") for i in range(60)] + [(100 + i, f"http://b.net/{{{'ab'[i % 2] * (1 + i // 2)}") for i in range(60)] + [(300, "http://c.net/{num}"), (301, "http://c.net/7")]
    got = {x.page_id: x.template for x in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {got[i] for i in range(60)} == {"/{num}.{ext}"} and {got[100 + i] for i in range(60)} == {"/{var}"}
    assert (got[300], got[301]) == ("/%7Bnum%7D", "/{num}")


def test_more_keys_than_are_broadcast(spark):
    rows = spark.createDataFrame([(i, i % 4) for i in range(20)], "n int, k int")
    found = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, v string")
    few, many = (sorted(map(tuple, urlfilter.beside(rows, found, ["k"], most).collect()), key=str) for most in (10, 1))
    assert few == many and len(few) == 20 and urlfilter.beside(rows, found.limit(0), ["k"]).filter("v is null").count() == 20
