"""Hashes of ordered lists without a list: rows of a key are sorted, and a running SHA-256 takes them one by one.

A hash over a list depends on its order, so a key's rows pass through one task. They aren't gathered there: the sort may
spill, and what a task holds is one running hash and a batch of rows, however many rows a key has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = object()


def ordered(rows: DataFrame, by: Column | None, order: list[Column], item: Column, opening: str = "", separator: str = ",", closing: str = "") -> DataFrame:
    """key, n and digest: for each key (null is one; without `by` all rows are of one, and no rows give the empty list's) SHA-256 in hex of its items in order, with what stands before, between and behind them.

    item: text, in UTF-8; a null counts as the text null, as in JSON. Rows that tie in `order` have to have equal items.
    """
    keyed = rows.select((by if by is not None else F.lit(0)).cast("string").alias("key"), F.coalesce(item, F.lit("null")).alias("item"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    alone = by is None
    dealt = (keyed.repartition("key") if not alone else keyed.repartition(1)).sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, state, n = _NONE, None, 0
        done: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now or now is _NONE:
                    if state is not None:
                        done.append(_end(now, n, state))
                    now, state, n = key, hashlib.sha256(opening.encode()), 0
                state.update((separator if n else "").encode() + text.encode("utf-8", "surrogatepass"))
                n += 1
            yield _rows(done)
            done = []
        if state is not None:
            done.append(_end(now, n, state))
        elif alone:
            done.append(_end("0", 0, hashlib.sha256(opening.encode())))
        yield _rows(done)

    def _end(key, n, state) -> tuple:
        state.update(closing.encode())
        return key, n, state.hexdigest()

    return dealt.select("key", "item").mapInArrow(run, "key string, n long, digest string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["key", "n", "digest"])


def pairs(rows: DataFrame, by: Column | None, key: Column, value: Column) -> DataFrame:
    """key, n and digest of the sorted lists of pairs as compact JSON."""
    pair = F.array(key.cast("string"), value.cast("string"))
    return ordered(rows, by, [pair], F.to_json(pair), "[", ",", "]")
