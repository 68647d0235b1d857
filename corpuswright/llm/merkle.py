"""A Merkle manifest of a dataset, with a proof for each row.

Each row becomes a leaf hash while it is scanned; no text is moved. The leaves of a group (a source) are ordered and
numbered from 0, and an iteration over DataFrames divides the numbers by the fanout, hashes each run's sorted children to
their parent and goes on with the parents, each level a sixteenth of the one below, until every group has one node, its
subroot. The subroots make a tree of their own in the same way. Then joins from the top level to the leaves append each
run's siblings to what its parent has, so that a level's siblings are joined once for a run and not once for a leaf.

H is SHA-256 in lowercase hex, of its inputs concatenated, digests as their hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l: string, r: string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value; numbers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `at`, their place from 0 in their group (grp) by `order`, and `n`, the group's size; staged.

    Rows are dealt out by ranges of (grp, order, tie), so a group of any size, or rows that repeat, lie in several
    neighbouring ranges. Each range's rows are numbered where they are, and the sizes of a group's earlier ranges are added.
    """
    keys = ["grp", *(F.col(c).asc_nulls_first() for c in order), "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.drop("tie").withColumn("id", F.monotonically_increasing_id()), name)
    part = F.shiftright("id", 33)
    sizes = dealt.groupBy("grp", part.alias("part")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("grp")
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    return dealt.withColumn("part", part).join(starts, ["grp", "part"]).withColumn("at", F.col("id") + F.col("shift")).drop("id", "part", "shift")


def digest_of(kids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(kids, lambda k: k["hash"]), ""), 256)


@dataclass
class Tree:
    """tops: grp, hash, kids (null at a lone leaf) of every group's last node. levels: grp, at, n, hash, kids of each level above the leaves, from the lowest; n is the number of the group's nodes in the level."""

    leaves: DataFrame
    levels: list[DataFrame]

    @property
    def tops(self) -> DataFrame:
        out = self.leaves.filter("n = 1").select("grp", "hash")
        for level in self.levels:
            out = out.unionByName(level.filter("n = 1").select("grp", "hash"))
        return out


def tree(leaves: DataFrame, fanout: int = FANOUT, name: str = "level") -> Tree:
    """The levels above leaves (grp, at, n, hash and any struct `own` that goes along). A group of one leaf is its own top."""
    levels: list[DataFrame] = []
    below, most = leaves, leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        kid = F.struct("at", "hash", *(["own"] if "own" in below.columns else []))
        runs = below.filter("n > 1").groupBy("grp", F.expr(f"at div {fanout}").alias("up")).agg(F.max("n").alias("m"), F.array_sort(F.collect_list(kid)).alias("kids"))
        below = staged(runs.select("grp", F.col("up").alias("at"), F.ceil(F.col("m") / fanout).cast("long").alias("n"), digest_of(F.col("kids")).alias("hash"), "kids"), f"{name}{len(levels)}")
        levels.append(below)
        most = -(-most // fanout)
    return Tree(leaves, levels)


def with_paths(found: Tree, tops: DataFrame) -> DataFrame:
    """at, hash, own and path of every leaf with what tops (grp, path and others) says of its group.

    path: of each level up to the tops' own path, what is to the left and to the right of the node in its run.
    """
    more = [c for c in tops.columns if c not in ("grp", "path")]
    own = ["own"] if "own" in found.leaves.columns else []
    above = None
    for k, level in reversed(list(enumerate(found.levels))):
        mine = level.filter("n = 1").drop("n", "hash").join(tops, "grp")
        if above is not None:
            mine = mine.unionByName(level.filter("n > 1").drop("n", "hash").join(above, ["grp", "at"]))
        each = mine.select("grp", *more, "path", F.transform("kids", lambda x: x["hash"]).alias("hashes"), F.posexplode("kids").alias("p", "kid"))
        left, right = F.slice("hashes", F.lit(1), F.col("p")), F.slice("hashes", F.col("p") + 2, F.size("hashes"))
        side = F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))
        ends = [F.col(f"kid.{c}").alias(c) for c in ["hash", *own]] if k == 0 else []
        above = each.select("grp", F.col("kid.at").alias("at"), F.concat(F.array(side), F.col("path")).alias("path"), *more, *ends)
    cols = ["grp", "at", "hash", "path", *more, *own]
    lone = found.leaves.filter("n = 1").join(tops, "grp").select(*cols)
    return lone if above is None else above.select(*cols).unionByName(lone)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def proofs(docs: DataFrame, tampered: Column | None = None, tampering=None, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, path and folded_root of every row of docs.

    A row's leaf is H of its fields. Per group (null is one), leaves ascend by `order` (null first; rows that share it, by
    leaf, so that repeated rows are leaves each). Groups are ordered by name, null first, bytewise. Where `tampered` is true,
    folded_root starts from the leaf of the row after `tampering` (a function from a field's name and column to a column), else
    from the leaf itself; siblings are the original ones. path holds the siblings, level by level from the leaf's run to the
    root, left and right of the node. An empty table gives an empty result; columns beside the fields are ignored, whatever
    their names. Values of any length are hashed whole.
    """
    own = [F.col(c) for c in fields]
    other = row_hash([tampering(c, F.col(c)) for c in fields]) if tampering else None
    start = F.when(F.coalesce(tampered, F.lit(False)), other) if other is not None else F.lit(None).cast("string")
    # a name for the group that sorts as the group does, with null first
    grp = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("-"))
    leaves = staged(docs.select(grp.alias("grp"), F.col(order).cast("long").alias("doc_id"), row_hash(own).alias("hash"), start.alias("changed")), "leaves")
    placed = numbered(leaves, ["doc_id", "hash"], "ordered").select("grp", "at", "n", "hash", F.struct("doc_id", "changed").alias("own"))
    below = tree(placed, fanout)
    # the subroots' tree has one group
    roots = staged(below.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), "subroots")
    upper = numbered(roots, ["name"], "groups").select("grp", "at", "n", "hash", F.struct("name").alias("own"))
    top = tree(upper, fanout, "upper")
    root = top.tops.select("grp", F.col("hash").alias("root"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    groups = staged(with_paths(top, root).select(F.col("own.name").alias("grp"), F.col("hash").alias("subroot"), "root", "path"), "paths")
    out = with_paths(below, groups)
    return out.select(F.col("own.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "path", folded(F.coalesce("own.changed", "hash"), F.col("path")).alias("folded_root"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document, as proofs() has them.

    Where 5 divides the CRC-32 of the decimal doc_id, the text's A-Z are lower-cased before the root is recomputed; so a text
    without any is verified all the same, as is a null. A null doc_id is never tampered with.
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = proofs(docs, changed, lambda name, c: lower_ascii(c) if name == "text" else c)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
