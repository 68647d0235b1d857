"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

A text is lower-cased (A-Z) and its distinct runs of five words are hashed to 64 bits each. SuperMinHash gives each
element one random permutation of the registers with ranks that fall step by step, so registers are correlated and less
variable than with independent hashes, and a document is done as soon as no further step can lower a register.

Rows with equal sets are one node. Registers are banded; nodes that share a band's bucket are candidates, and plausible
unless their sizes rule a link out or their signatures differ by far more than chance allows. Plausible candidates are
joined to blocks without listing them all: a bucket is compared with its smallest node (an aggregate and a join, which a
hot bucket doesn't hold up), and only buckets that then still hold several blocks are compared further, each giving a
spanning forest. Inside a block every plausible pair is verified on the full sets unless links found before join its ends
already; large buckets and blocks are dealt as grids. Verified links are joined to components by union-find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import fresh, id_and_text, map_arrow, slices, split_hot, staged, texts_of, without_ids, worker_cache
from .graph import components

SHINGLE, BANDS, ROWS = 5, 44, 5
REGISTERS = BANDS * ROWS
#: Signatures estimate a similarity with a deviation of 0.03 at most; below this a pair can't have 0.75.
PLAUSIBLE = 0.55
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_U = np.uint64
_MULT = np.random.default_rng(5).integers(0, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_BAND_MULT = np.random.default_rng(6).integers(0, 2**63, ROWS, dtype=np.uint64) * _U(2) + _U(1)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Words(dict):
    """Hashes of words; of at most 200,000, none longer than 256 bytes."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 256:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of five words; of fewer words, the whole sequence as one."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    known = worker_cache("words", _Words)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(w) == 0:
        return w
    k = min(SHINGLE, len(w))
    h = w[: len(w) - k + 1] * _MULT[0]
    for i in range(1, k):
        h += w[i : len(w) - k + 1 + i] * _MULT[i]
    h += _U(k)
    return np.unique(mix(h))


def signatures(sets: list[np.ndarray], m: int = REGISTERS, block: int = 200_000) -> np.ndarray:
    """SuperMinHash registers of each set, rank above, fraction below: sets x m, uint64; empty sets have all ones."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= block):
            size += len(sets[end])
            end += 1
        _fill(out[at:end], sets[at:end], m, block)
        at = end
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray], m: int, block: int) -> None:
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat, perm = out.reshape(-1), None
    for j in range(m):
        if len(element) == 0:
            return
        for a in range(0, len(element), block):
            part = slice(a, a + block)
            x = mix(element[part] + _U((j * _GOLDEN + 1) & (2**64 - 1)))
            k = (j + ((x >> _U(32)) * _U(m - j) >> _U(32))).astype(np.intp)
            if perm is None:
                place = k
            else:
                rows = np.arange(a, a + len(x))
                place = perm[rows, k].astype(np.intp)
                perm[rows, k] = perm[rows, j]
            np.minimum.at(flat, owner[part] * m + place, _U(j << 32) | (x & _U(0xFFFFFFFF)))
        live = (out.max(axis=1) >= _U((j + 1) << 32))[owner]
        if perm is None and live.any():  # step 0 swapped places 0 and k
            element, owner = element[live], owner[live]
            x = mix(element + _U(1))
            k = ((x >> _U(32)) * _U(m) >> _U(32)).astype(np.intp)
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(element), 1))
            perm[np.arange(len(element)), k] = 0
        elif not live.all():
            element, owner = element[live], owner[live]
            perm = None if perm is None else perm[live]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, salted by the band's number."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    h = (rows * _BAND_MULT).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_GOLDEN)
    return mix(h).view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, n_shingles, set_id, sig (a byte a register) and bands of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        for few in slices([batch]):
            sets = [shingle_set(t) for t in texts_of(few)]
            sig = signatures(sets)
            keys = band_keys(sig)
            first = seen.get(part, 0)
            seen[part] = first + len(sets)
            yield {
                "row_id": [part << 33 | first + i for i in range(len(sets))],
                "doc_id": few.column(0).to_pylist(),
                "n_shingles": [len(s) for s in sets],
                "set_id": [set_key(s) for s in sets],
                "sig": [x.tobytes() for x in (sig & _U(255)).astype(np.uint8)],
                "bands": list(keys),
            }

    seen: dict[int, int] = {}
    return map_arrow(docs, "row_id long, doc_id long, n_shingles long, set_id binary, sig binary, bands array<long>", run)


def similar_size(a: str, b: str, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose signatures don't speak against it, with the share of equal registers."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    # a leader of many pairs is sent to them
    x = x.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")), "a")
    joined = split_hot(pairs, x, ["a"], "pairs").join(y, "b").filter(similar_size("na", "nb", percent)).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in (2, 3))
            like = (sa == sb).mean(axis=1) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["a", "b", "like"]).filter(pa.array(like >= PLAUSIBLE, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long, like double")


def node_texts(docs: DataFrame, wanted: DataFrame, most: int = 2_000_000) -> DataFrame:
    """node and text of the wanted nodes (node, doc_id, set_id). Ids may repeat, so a row counts if its set is the node's.

    Up to `most` ids are broadcast, so that other rows' texts never leave their task; beyond, it is Spark that filters a large
    scan by the ids before it deals it out.
    """
    ids = wanted.select("doc_id").distinct()
    if ids.limit(most + 1).count() <= most:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    found = docs.join(wanted, "doc_id").select("node", "set_id", "text")

    def run(batches):
        for batch in slices(batches):
            stay = [set_key(shingle_set(t or "")) == s for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["node", "text"]).filter(pa.array(stay, pa.bool_()))

    return found.mapInArrow(run, "node long, text string")


def groups(batches, width: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first `width` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if rows:
                    yield rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield rows


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in pairs], pa.int64()), pa.array([max(x) for x in pairs], pa.int64())], ["a", "b"])


def grid(members: DataFrame, by: list[str], cells: F.Column) -> DataFrame:
    """members dealt to slots of their group by the node's hash, `cells` slots a group; each member is in the cells (i, j) of all pairs of slots that have its own. A group of one slot is one cell."""
    sizes = members.groupBy(*by).agg(cells.cast("int").alias("g")).filter("g > 1")
    dealt = members.join(sizes, by, "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.withColumns({"i": F.least("slot", "other"), "j": F.greatest("slot", "other")})


def bridging_pairs(members: DataFrame, percent: int, most_nodes: int = 1024) -> DataFrame:
    """Plausible pairs that join different components inside a bucket: a spanning forest. members: key, node, n, comp, sig.

    A bucket is split by classes of set size, a factor apart; a node goes to its class and the next, so that a pair of
    similar size meets in one of them. A class beyond most_nodes is dealt as a grid.
    """
    step = float(np.log(100 / percent)) if percent < 100 else 1e-9
    cls = F.floor(F.log("n") / step).cast("long")
    dealt = grid(members.withColumn("cls", F.explode(F.array(cls, cls + 1))), ["key", "cls"], F.ceil(F.count(F.lit(1)) / most_nodes))
    at = ["key", "cls", "i", "j"]
    dealt = dealt.repartition(*at).sortWithinPartitions(*at, "node").select(*at, "node", "n", "comp", "sig", "slot")

    def run(batches):
        for rows in groups(batches, 4):
            n, comp, slot = (np.array([r[k] for r in rows]) for k in (5, 6, 8))
            if comp.min() == comp.max():
                continue
            across = rows[0][2] != rows[0][3]
            sig, found = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), -1), []
            for x in range(1, len(rows)):
                for y in _partners(x, sig, n, comp, percent).tolist():
                    if comp[x] != comp[y] and not (across and slot[x] == slot[y]):
                        comp[comp == comp[x]] = comp[y]
                        found.append((rows[x][4], rows[y][4]))
            if found:
                yield pair_batch(found)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _partners(x: int, sig: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int, block: int = 8192) -> np.ndarray:
    """Places before x with which a link is plausible and not known yet, the likeliest first."""
    js = np.flatnonzero((comp[:x] != comp[x]) & (np.minimum(n[:x], n[x]) * 100 >= np.maximum(n[:x], n[x]) * percent))
    like = np.concatenate([(sig[js[k : k + block]] == sig[x]).mean(axis=1) for k in range(0, len(js), block)]) if len(js) else np.zeros(0)
    keep = like >= PLAUSIBLE
    return js[keep][np.argsort(-like[keep], kind="stable")]


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    same = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return same * 100 >= percent * (len(p) + len(q) - same)


def block_links(members: DataFrame, percent: int, most_nodes: int = 1024, most_shingles: int = 2_000_000) -> DataFrame:
    """Verified links inside each block: a spanning forest of them. members: block, node, n, sig, text.

    A block beyond the sizes is dealt to g slots by hash and compared as a grid of slot pairs, so that no task holds more
    than two slots.
    """
    dealt = grid(members, ["block"], F.greatest(F.ceil(F.count(F.lit(1)) / most_nodes), F.ceil(F.sum("n") / most_shingles))).select("block", "i", "j", "slot", "node", "n", "sig", "text")
    dealt = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "node")

    def run(batches):
        for rows in groups(with_sets(batches), 3):
            grid, slot = rows[0][1] != rows[0][2], np.array([r[3] for r in rows])
            n, label = np.array([r[5] for r in rows]), np.arange(len(rows))
            sig, found = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1), []
            for x in range(1, len(rows)):
                for y in _partners(x, sig, n, label, percent).tolist():
                    if label[x] != label[y] and not (grid and slot[x] == slot[y]) and similar(rows[x][7], rows[y][7], percent):
                        label[label == label[x]] = label[y]
                        found.append((rows[x][4], rows[y][4]))
            if found:
                yield pair_batch(found)

    def with_sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield _Rows([*part.columns[:7], [shingle_set(t) for t in part.column(7).to_pylist()]])

    return dealt.mapInArrow(run, "a long, b long")


class _Rows:
    """Columns that groups() can read, of which some are lists already."""

    def __init__(self, columns):
        self.columns = [_Listed(c) if isinstance(c, list) else c for c in columns]


class _Listed(list):
    def to_pylist(self):
        return self


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, most_nodes: int = 1024) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id
    reachable, and kept says that it is the row's own. A null text or one without words has an empty set and no link. Rows
    that repeat an id are documents of their own; a row without an id is linked with nothing, has a null component and is
    kept. Texts of any length are read whole. An empty table gives an empty result; other columns of docs are ignored. A
    task compares at most about twice most_nodes nodes with each other.
    """
    return marked(docs, id_col, text_col, percent, most_nodes).drop("set_id", "comp")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, most_nodes: int = 1024) -> DataFrame:
    """near_duplicates with set_id, null for a row that is linked with nothing, and comp, which names the component where ids repeat."""
    docs = id_and_text(docs, id_col, text_col)
    rows = staged(sketches(docs), "sketches")
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("row_id", "doc_id"))
    sets = staged(linked.groupBy("set_id").agg(first["row_id"].alias("node"), first["doc_id"].alias("of_doc"), F.min("doc_id").alias("least_doc"), F.count(F.lit(1)).alias("uses")), "sets")
    nodes = staged(linked.join(sets.select(F.col("node").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("node"), F.col("n_shingles").alias("n"), "sig", "bands"), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = staged(buckets.withColumn("uses", F.col("size")), "buckets")
    members = staged(split_hot(entries, buckets, ["key"], "uses").filter("leader is not null").select("key", "node", "leader", "size"), "members")
    led = staged(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "led")
    stars = staged(plausible(led, nodes, percent).select("a", "b"), "stars")
    blocks = components(stars)
    # buckets that hold several blocks, where a plausible pair may not have met
    named = members.filter("size > 2").join(blocks, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    within = named.join(mixed, "key").join(nodes.select("node", "n", "sig"), "node").select("key", "node", "n", "comp", "sig")
    bridges = staged(bridging_pairs(within, percent, most_nodes), "bridges")
    if not bridges.isEmpty():
        blocks = components(stars.unionByName(bridges))
    reps = sets.select("node", F.col("of_doc").alias("doc_id"), "set_id")
    texts = staged(node_texts(docs, staged(reps.join(blocks.select("node"), "node"), "wanted")), "texts")
    held = blocks.withColumnRenamed("comp", "block").join(nodes.select("node", "n", "sig"), "node").join(texts, "node").select("block", "node", "n", "sig", "text")
    comps = components(staged(block_links(held, percent, most_nodes), "links"))
    least = sets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("set_id", "comp", "least_doc", "uses")
    least = staged(least, "least")
    ids = staged(least.groupBy("comp").agg(F.min("least_doc").alias("component_id"), F.sum("uses").alias("total"), F.count(F.lit(1)).alias("sets")).filter("total > 1").drop("total"), "ids")
    known = staged(split_hot(least, ids, ["comp"], "sets").filter("component_id is not null").select("set_id", "component_id", "comp", "uses"), "known")
    # rows that are linked with nothing have no key to be dealt by, and copies of a frequent set stay where they are
    apart = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    alone = rows.filter(apart).select(F.lit(None).cast("binary").alias("set_id"), "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    found = split_hot(rows.filter(~apart).select("set_id", "doc_id", "n_shingles"), known, ["set_id"], "uses").unionByName(alone)
    own = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "set_id", "comp")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns, whatever their names; of those of one component that share the id one stays.

    A null text, one without words or a row without an id is linked with nothing and stays; texts of any length are compared
    whole; of a group the smallest doc_id stays, and an empty table gives an empty one. Ids of which no row stays are taken
    out by id alone. Only where an id repeats and has a row that stays are sets compared.
    """
    rows = staged(marked(docs), "marked")
    ids = staged(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kept")).alias("go")).filter("go > 0 or n > 1"), "dropped")
    out = without_ids(docs, ids.filter("go = n").select("doc_id"))
    id_, set_, of = (fresh(docs, x) for x in ("__id", "__set", "__of"))
    mixed = ids.filter("go < n").select(F.col("doc_id").alias(id_))
    if mixed.isEmpty():
        return out
    same = F.col("doc_id") == F.col(id_)
    some = rows.join(mixed, same, "left_semi")
    # a set that is alone has no component
    stay = some.filter("kept and set_id is not null").withColumn("comp", F.coalesce(F.col("comp").cast("string"), F.hex("set_id")))
    stay = stay.groupBy(F.col("doc_id").alias(id_), "comp").agg(F.min("set_id").alias(of)).drop("comp")
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_key(x) if len(x) else None for x in sets], pa.binary())], [*batch.schema.names, set_])

    again = docs.join(mixed, same, "left_semi")
    again = staged(again.mapInArrow(run, StructType([*again.schema.fields, StructField(set_, BinaryType())])), "again")
    once = again.join(stay, same & (F.col(set_) == F.col(of))).dropDuplicates([id_, set_])
    return out.join(mixed, same, "left_anti").unionByName(once.select(*docs.columns)).unionByName(again.filter(F.col(set_).isNull()).select(*docs.columns))
