"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, run once over each text.

Words are runs of lower-cased ASCII letters, digits and non-ASCII bytes. A window is `window` consecutive words of an item;
a shorter item, if it has words, is one window. The automaton's patterns are windows with a space on either side, so that
a match in a text's words, joined by spaces, begins and ends at word borders. Character offsets map back to the original.

All windows make one automaton as long as their text stays below BLOCK_BYTES; a worker then needs about 40 times that, 160
MB. A larger benchmark makes several: blocks are the outer loop, a pass over the texts each, so that a worker builds each
automaton once and holds one at a time, whatever the number of windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, slices, staged, texts_of, worker_cache

WINDOW, BLOCK_BYTES = 10, 4 << 20
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str, window: int) -> set[str]:
    words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
    if not words:
        return set()
    n = min(window, len(words))
    return {f" {' '.join(words[i : i + n])} " for i in range(len(words) - n + 1)}


def item_blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[dict[str, list[str]]]:
    """Windows with their items' ids, in blocks of about block_bytes at most; the items stream through the driver."""
    block: dict[str, list[str]] = {}
    size = 0
    for item, text in items.toLocalIterator():
        for w in windows_of(text or "", window):
            ids = block.setdefault(w, [])
            if item is not None and str(item) not in ids:
                ids.append(str(item))
            size += len(w) + 16
        if size >= block_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def automaton(key: str, block: dict[str, list[str]]) -> ahocorasick.Automaton:
    """Built once a worker process, which holds the one of the present pass; key names the block."""
    held = worker_cache("automaton", dict)
    if key not in held:
        held.clear()
        found = ahocorasick.Automaton()
        for w, ids in block.items():
            found.add_word(w, (w.count(" ") - 1, ids))
        found.make_automaton()
        held[key] = found
    return held[key]


def passes(rows: DataFrame, items: DataFrame, window: int, block_bytes: int, scan: Callable[[DataFrame, str, Broadcast], DataFrame]) -> DataFrame:
    """rows through one scan for each block of the items, at least one. Between passes rows are written, so that no task holds two automata."""
    sc, blocks = rows.sparkSession.sparkContext, item_blocks(items, window, block_bytes)
    block = next(blocks, {})
    while True:
        rows = scan(rows, uuid.uuid4().hex, sc.broadcast(block))
        block = next(blocks, None)
        if block is None:
            return rows
        rows = staged(rows, "scanned")


def char_offsets(text: str, wanted: list[tuple[int, int]]) -> list[dict]:
    """Offsets in the original text of runs (first, end) of words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.frombuffer(_TABLE[:128], np.uint8)[np.minimum(codes, 127)] != 0x20
    kept |= codes >= 128
    edge = np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in wanted]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids and spans (character offsets of runs of hit words).

    Null texts have no words; null item ids mark words but aren't listed; ids and windows that repeat count once. With no
    items nothing is hit. Texts of any length are scanned whole; rows that repeat are each scanned; an empty table gives an
    empty result; other columns of docs and items are ignored. Windows are broadcast, block_bytes at a time.
    """
    state = passes(id_and_text(docs, id_col, text_col), items.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string")), window, block_bytes, scan)
    return state.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids", "spans")


def scan(state: DataFrame, key: str, sent: Broadcast) -> DataFrame:
    """Adds the block's finds to those in state, if it has any; a map without a shuffle."""

    def find(batch: pa.RecordBatch) -> Iterator[dict]:
        found = automaton(key, sent.value)
        rows = batch.to_pydict()
        texts, before = list(texts_of(batch)), rows.get("runs") or [None] * batch.num_rows
        out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "item_ids", "spans", "runs")} | {"doc_id": rows["doc_id"], "text": rows["text"]}
        for at, text in enumerate(texts):
            words = words_of(text)
            out["n_words"].append(len(words))
            runs = [(x["first"], x["end"]) for x in before[at] or ()]
            ids = set(rows["item_ids"][at]) if "item_ids" in rows else set()
            if words and len(found):
                joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
                hits = [(end, n, of) for end, (n, of) in found.iter(joined)]
                if hits:
                    spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
                    lasts = np.searchsorted(spaces, [e for e, _, _ in hits]).tolist()
                    runs += [(b - n, b) for b, (_, n, _) in zip(lasts, hits)]
                    ids.update(*(of for _, _, of in hits))
            runs = merged(runs)
            out["runs"].append([{"first": a, "end": b} for a, b in runs])
            out["n_hit"].append(sum(b - a for a, b in runs))
            out["item_ids"].append(sorted(ids))
            out["spans"].append(char_offsets(text, runs) if runs else [])
        yield out

    run = "array<struct<first: int, end: int>>"
    return map_arrow(state, f"doc_id long, text string, n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>, runs {run}", find)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with all their columns, whatever their names. The scan works beside the row, so that no join follows.

    A null or empty text, or one without words, stays; repeated rows and rows without an id are judged each by their text,
    which is scanned whole, however long. Null items and items without words hit nothing; an empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def clean(rows: DataFrame, key: str, sent: Broadcast) -> DataFrame:
        def keep(batches):
            for batch in slices(batches):
                found, stay = automaton(key, sent.value), []
                for text in batch.column(at).to_pylist():
                    words = words_of(text or "")
                    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
                    stay.append(not (words and len(found) and next(found.iter(joined), None)))
                yield batch.filter(pa.array(stay, pa.bool_()))

        return rows.mapInArrow(keep, rows.schema)

    return passes(docs, items.select(F.col("item_id").cast("string"), F.col("text").cast("string")), window, block_bytes, clean)
