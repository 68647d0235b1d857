"""URL filter by a path-template tree.

A path is cut into segments and each segment has a shape: digits, hexadecimal, date, other text with digits, or the
literal itself; an extension is kept beside it. Per host, distinct shaped paths are counted first, so what follows works on
that much smaller table. Level by level from the host down, a node with more than `most_children` literal children has
them generalised to one wildcard, and if it has more children than that of one shape, these lose their extensions. What is left is the host's template tree. Sibling branches whose labelled shares don't
differ significantly and whose children look alike are merged, and a template's share of blocked pages is smoothed
towards its parent's, up to the share over all hosts. Templates with a smoothed share of at least `reject` are rejected.

Labels come with the call: verdicts that are known for some urls. A list of (host, path prefix) rules can give them, and
then also decides the urls that it covers.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, ANY, DEPTH = "{var}", ".{ext}", 12


@dataclass(frozen=True)
class Rule:
    name: str  # like example.org/en/
    verdict: str  # allow or block

    @property
    def host(self) -> str:
        return self.name.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.name.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame, url_col: str) -> DataFrame:
    """__url, host and path beside the row."""
    out = pages.withColumn("__url", F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    return out.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and subdomains if the path begins with its own."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """A segment's class, with its extension; plain words stay as they are, with braces written as %7B and %7D, so that only classes begin with one."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,5}$", "")
    kind = (
        F.when(stem.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), "{date}")
        .when(stem.rlike(r"^\d+$"), "{num}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike(r"\d"), "{hex}")
        .when(stem.rlike(r"\d"), "{mix}")
        .otherwise(F.replace(F.replace(stem, F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D")))
    )
    return F.concat(kind, extension)


def shaped(path: Column) -> Column:
    """The path's segments by shape; a trailing slash is a last empty segment."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)


def kind_of(seg: Column) -> Column:
    """The class that a segment begins with; empty for a literal."""
    return F.regexp_extract(seg, r"^(\{[a-z]+\})", 1)


def generalised(paths: DataFrame, most_children: int) -> DataFrame:
    """paths (host, segs, ...) with `template`: of a node's literal children, and of those of each class, more than most_children become one, from the top down.

    Down to DEPTH the table is read a level at a time; what a branch has below that is finished in one task.
    """
    deepest = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    now = paths.withColumn("template", F.array().cast("array<string>"))
    for level in range(min(deepest, DEPTH)):
        seg = F.get("segs", F.lit(level))
        now = now.withColumn("kind", kind_of(seg))
        wide = (
            now.filter(seg.isNotNull()).select("host", "template", "kind", seg.alias("child")).distinct()
            .groupBy("host", "template", "kind").agg(F.count(F.lit(1)).alias("children")).filter(F.col("children") > most_children)
            .select("host", "template", "kind", F.lit(True).alias("wide"))
        )
        now = beside(now, staged(wide, "wide"), ["host", "template", "kind"])
        word = F.when(~F.coalesce("wide", F.lit(False)), seg).when(F.col("kind") == "", F.lit(WILD)).otherwise(F.concat("kind", F.lit(ANY)))
        now = now.withColumn("template", F.when(seg.isNull(), F.col("template")).otherwise(F.concat("template", F.array(word)))).drop("wide", "kind")
        if level % 3 == 2:
            now = staged(now, "templates")
    if deepest <= DEPTH:
        return now
    deep = now.filter(F.size("segs") > DEPTH)
    names = now.columns

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(template=below([list(x) for x in rows["segs"]], [list(x) for x in rows["template"]], most_children))[names]

    return now.filter(F.size("segs") <= DEPTH).unionByName(deep.groupBy("host", "template").applyInPandas(finish, now.schema))


def beside(rows: DataFrame, found: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """rows left-joined to found, a row a key, which is broadcast up to `most` rows, so that a host that holds many rows isn't moved; without any found, rows with nulls."""
    n = found.limit(most + 1).count()
    if n == 0:
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in found.dtypes if c not in keys})
    return rows.join(F.broadcast(found) if n <= most else found, keys, "left")


def below(segs: list[list[str]], templates: list[list[str]], most_children: int) -> list[list[str]]:
    """The templates of paths that share one so far, carried on to the end of each path."""
    todo = [(len(templates[0]), list(range(len(segs))))]
    while todo:
        level, rows = todo.pop()
        rows = [i for i in rows if len(segs[i]) > level]
        of, kids = {}, {}
        for i in rows:
            of.setdefault(kind(segs[i][level]), set()).add(segs[i][level])
        for i in rows:
            word, of_kind = segs[i][level], kind(segs[i][level])
            word = word if len(of[of_kind]) <= most_children else of_kind + ANY if of_kind else WILD
            templates[i].append(word)
            kids.setdefault(word, []).append(i)
        todo += [(level + 1, x) for x in kids.values()]
    return templates


def kind(seg: str) -> str:
    return seg[: seg.index("}") + 1] if seg.startswith("{") else ""


def differ(block_a: float, n_a: float, block_b: float, n_b: float, z: float = 1.96) -> bool:
    """Whether two shares differ by a two-proportion test."""
    share = (block_a + block_b) / (n_a + n_b)
    spread = (share * (1 - share) * (1 / n_a + 1 / n_b)) ** 0.5
    return abs(block_a / n_a - block_b / n_b) > z * spread


def judge_host(rows: pd.DataFrame, prior: float, weight: float, like: float) -> pd.DataFrame:
    """The smoothed blocked share of each template of one host. rows: template (tuple-able), n, blocked, allowed."""
    root: dict = {"kids": {}, "n": 0, "blocked": 0, "allowed": 0}
    leaves = []
    for template, n, blocked, allowed in zip(rows["template"], rows["n"], rows["blocked"], rows["allowed"]):
        node = root
        for seg in [None, *template]:
            if seg is not None:
                node = node["kids"].setdefault(seg, {"kids": {}, "n": 0, "blocked": 0, "allowed": 0})
            node["n"], node["blocked"], node["allowed"] = node["n"] + n, node["blocked"] + blocked, node["allowed"] + allowed
        leaves.append(node)
    shares: dict[int, float] = {}
    todo = [(root, (root["blocked"] + weight * prior) / (root["blocked"] + root["allowed"] + weight))]
    while todo:
        node, share = todo.pop()
        shares[id(node)] = share
        merged: list[list[dict]] = []
        for _, kid in sorted(node["kids"].items()):
            for group in merged:
                if alike(group, kid, like):
                    group.append(kid)
                    break
            else:
                merged.append([kid])
        for group in merged:
            blocked, known = sum(k["blocked"] for k in group), sum(k["blocked"] + k["allowed"] for k in group)
            todo += [(k, (blocked + weight * share) / (known + weight)) for k in group]
    return pd.DataFrame({"share": [shares[id(x)] for x in leaves]})


def alike(group: list[dict], kid: dict, like: float) -> bool:
    """Whether a branch is statistically similar to a group: the labelled shares don't differ and the children are alike. Without labels there is no evidence to merge on."""
    known = [sum(k["blocked"] + k["allowed"] for k in group), kid["blocked"] + kid["allowed"]]
    if min(known) == 0 or differ(sum(k["blocked"] for k in group), known[0], kid["blocked"], known[1]):
        return False
    a, b = {s for k in group for s in k["kids"]}, set(kid["kids"])
    return not (a or b) or len(a & b) / len(a | b) >= like


def judge(pages: DataFrame, labels: Column | None = None, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", most_children: int = 20, weight: float = 5.0, like: float = 0.5, reject: float = 0.8) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, template, share.

    labels: a column of pages, allow, block or null; by default what the rules say. A null url, or one without ://, has an
    empty host and path. A url that a rule covers gets the longest rule's verdict; any other one is blocked if its template's
    smoothed share is at least `reject`. Hosts without labels keep the overall share. Repeated rows count each, and rows
    without an id as well; paths of any length and depth are read whole; ties between rules go to the last by name; an empty
    table gives an empty result; other columns of pages are ignored.
    """
    rules = rules or []
    rows = parsed(pages, url_col)
    found = rule_of(F.col("__host"), F.col("__path"), rules)
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)])[F.col("rule")] if rules else F.lit(None).cast("string")
    rows = rows.select(F.col(id_col).alias("page_id"), F.col("__host").alias("host"), F.col("__path").alias("path"), found.alias("rule"), (labels if labels is not None else F.lit(None)).cast("string").alias("given"))
    rows = rows.withColumn("ruled", by_rule).withColumn("label", F.coalesce("given", "ruled")).withColumn("segs", shaped(F.col("path")))
    paths = rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "block").alias("blocked"), F.count_if(F.col("label") == "allow").alias("allowed"))
    paths = staged(generalised(staged(paths, "paths"), most_children), "templates")
    total = paths.agg(F.sum("blocked"), F.sum(F.col("blocked") + F.col("allowed"))).first()
    prior = (total[0] + 1) / (total[1] + 2) if total[1] else 0.0
    templates = paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))

    def per_host(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([rows[["host", "template"]].reset_index(drop=True), judge_host(rows, prior, weight, like)], axis=1)

    # a host's group is its templates, which wildcards keep few, not its pages
    shares = templates.groupBy("host").applyInPandas(per_host, "host string, template array<string>, share double")
    known = beside(paths, staged(shares, "shares"), ["host", "template"]).select("host", "segs", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "share")
    judged = beside(rows, staged(known, "known"), ["host", "segs"])
    verdict = F.coalesce("ruled", F.when(F.col("share") >= reject, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "share")
