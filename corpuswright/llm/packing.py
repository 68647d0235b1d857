"""Concatenate and cut: documents' tokens form one stream, cut into windows of a fixed length.

Pass one tokenises, keeps each partition's running token total beside the ids and writes both. Prefix sums over the
partitions' totals (one number a partition) give every partition its global offset. Pass two cuts each document at the
windows' borders into boundary records; nothing is shuffled in either pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, staged, texts_of
from .tokens import encoder, tokenizer_json


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """part, local_start (ids of the partition before the document), doc_id, n_tokens and ids (unsigned 16-bit if they fit, else 32)."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(vocabulary))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batch: pa.RecordBatch) -> Iterator[dict]:
        enc, part = encoder(spec.value), TaskContext.get().partitionId()
        out: dict[str, list] = {k: [] for k in ("part", "local_start", "n_tokens", "ids", "wide")} | {"doc_id": batch.column(0).to_pylist()}
        for text in texts_of(batch):
            ids = np.frombuffer(enc.encode(text) + end, "<u4")
            wide = bool(ids.max() > 65535)
            out["part"].append(part)
            out["local_start"].append(seen.get(part, 0))
            out["n_tokens"].append(len(ids))
            out["ids"].append(ids.tobytes() if wide else ids.astype("<u2").tobytes())
            out["wide"].append(wide)
            seen[part] = seen.get(part, 0) + len(ids)
        yield out

    seen: dict[int, int] = {}
    return map_arrow(docs, "part int, local_start long, doc_id long, n_tokens long, ids binary, wide boolean", encode)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_pieces.

    Null text counts as empty; every row, repeated ones too, brings at least its end id. Only the last sequence has padding.
    An empty table gives no pieces; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    table = staged(tokenised(id_and_text(docs, id_col, text_col), vocabulary, end_id), "tokens")
    # one number a partition, not a row
    totals, before, offsets = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), 0, {}
    for part, n in sorted(totals):
        offsets[part], before = before, before + n
    sent = spark.sparkContext.broadcast(offsets)

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_pieces")
        out: dict[str, list] = {k: [] for k in names}
        rows = batch.to_pydict()
        for part, local, doc, n, raw, wide in zip(*(rows[k] for k in ("part", "local_start", "doc_id", "n_tokens", "ids", "wide"))):
            data = raw if wide else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            first = sent.value[part] + local
            borders = [first, *range((first // length + 1) * length, first + n, length), first + n]
            for a, b in zip(borders, borders[1:]):
                for k, v in zip(names, (doc, a - first, b - a, zlib.crc32(data[4 * (a - first) : 4 * (b - first)]), n, a // length, a % length, len(borders) - 1)):
                    out[k].append(v)
        yield out

    return map_arrow(table, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_pieces long", cut)
