"""An index that grows by what a version changes.

A build compares the chunks' hashes with the active version's. New and changed chunks become a segment of their own, with
their vectors and postings; for changed and deleted ones it says which earlier segment's row is gone, and what their words
take off the corpus's counts. A version is a list of segments, so rows that stay aren't written again, an earlier version is
read as it was, and a compaction is one more segment that replaces all.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenize import segmented
from ..plans.shared import fixed, in_groups, lean, spread
from . import postings
from .retrieval import Embedder, hashed_vectors, with_vectors
from .versions import Store, diff


class Segments(Store):
    """Below a path: segments/<id>/ with chunks, index, gone and less, log/<version>.json, and segments.json, which says which version is active."""

    def __init__(self, spark: SparkSession, path: str, embed: Embedder = hashed_vectors, tokens: Callable[[Column], Column] = segmented):
        super().__init__(spark, path)
        self.embed, self.tokens = embed, tokens

    def manifest(self, version: str | None = None) -> dict | None:
        """The active version's manifest, or a named one's."""
        if version is None:
            head = self.pointer("segments.json")
            return head and self.manifest(head["version"])
        found = self.pointer(f"log/{version}.json")
        if found is None:
            raise LookupError(f"there is no version {version}")
        return found

    def build(self, chunks: DataFrame, version: str) -> dict:
        """Makes a version of chunks (chunk_id, text; ids are unique) active and gives its manifest, with the numbers of rows written, reused and taken out. A version that is there already is made active as it is."""
        if self._exists(f"log/{version}.json"):
            self._write_atomic("segments.json", {"version": version})
            return self.manifest(version)
        before = self.manifest()
        hashed = chunks.select("chunk_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
        if before is None:
            return self._publish(version, None, self._segment(spread(hashed), None), reused=0)
        old = self.chunks(before["version"])
        status = diff(old.select("chunk_id", "hash"), hashed.select("chunk_id", "hash"), "chunk_id", "hash")
        status = fixed(status)
        reused = status.filter("status = 'UNCHANGED'").count()
        if status.filter("status <> 'UNCHANGED'").isEmpty():
            return self._publish(version, before, None, reused)
        new = hashed.join(status.filter("status in ('NEW', 'CHANGED')").select("chunk_id"), "chunk_id", "left_semi")
        gone = old.join(status.filter("status in ('DELETED', 'CHANGED')").select("chunk_id"), "chunk_id", "left_semi")
        return self._publish(version, before, self._segment(new, gone), reused)

    def compact(self, version: str) -> dict:
        """The active version's chunks as one segment; earlier versions keep theirs."""
        before = self.manifest()
        if before is None:
            raise LookupError("there is no version to compact")
        segment = self._segment(self.chunks(before["version"]).select("chunk_id", "text", "hash", "vector"), None)
        return self._publish(version, before | {"segments": []}, segment, reused=0)

    def rollback(self) -> dict:
        """Makes the version before the active one active; its segments are as they were."""
        now = self.manifest()
        if not now or not now.get("previous"):
            raise LookupError("there is no version to go back to")
        self._write_atomic("segments.json", {"version": now["previous"]})
        return self.manifest()

    def chunks(self, version: str | None = None) -> DataFrame:
        """chunk_id, text, hash, vector and segment of a version's rows: of each segment those that no later one takes out."""
        parts = self.manifest(version)["segments"]
        every = [self.spark.read.parquet(f"{self.path}/segments/{s['id']}/chunks").withColumn("segment", F.lit(s["id"])) for s in parts]
        rows = functools.reduce(DataFrame.unionByName, every)
        gone = self._gone(parts)
        return rows if gone is None else rows.join(gone, ["chunk_id", "segment"], "left_anti").select(*rows.columns)

    def index(self, version: str | None = None) -> postings.Postings:
        """The version's inverted index; scores are those of an index that is built anew."""
        parts = self.manifest(version)["segments"]
        gone, out = self._gone(parts), []
        for k, s in enumerate(parts):
            mine = None if gone is None or k == len(parts) - 1 else gone.filter(F.col("segment") == s["id"]).select(F.col("chunk_id").alias("doc_id"))
            out.append(postings.Segment(f"{self.path}/segments/{s['id']}/index", mine))
        less = [self.spark.read.parquet(f"{self.path}/segments/{s['id']}/less") for s in parts if s["gone"]]
        return postings.Postings(self.spark, out, self.tokens, functools.reduce(DataFrame.unionByName, less) if less else None, sum(s["gone"] for s in parts), sum(s["length_gone"] for s in parts))

    def _gone(self, parts: list[dict]) -> DataFrame | None:
        found = [self.spark.read.parquet(f"{self.path}/segments/{s['id']}/gone") for s in parts if s["gone"]]
        return functools.reduce(DataFrame.unionByName, found) if found else None

    def _segment(self, new: DataFrame, gone: DataFrame | None) -> dict:
        """Writes a segment of new (chunk_id, text, hash and perhaps vector) that takes gone (as chunks() has them) out."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        lean(self.spark)
        if "vector" not in new.columns and self.embed is hashed_vectors:
            new = with_vectors(new)
        elif "vector" not in new.columns:
            new = fixed(new)
            new = new.join(self.embed(new.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))), "chunk_id", "left")
        in_groups(new.select("chunk_id", "text", "hash", "vector").write, 16 << 20).parquet(f"{folder}/chunks")
        rows = self.spark.read.parquet(f"{folder}/chunks")
        postings.write(spread(rows).select(F.col("chunk_id").alias("doc_id"), self.tokens(F.col("text")).alias("tokens")), f"{folder}/index")
        head = {"id": name, "rows": rows.count(), "gone": 0, "length_gone": 0}
        if gone is not None:
            gone = fixed(gone.select("chunk_id", "segment", self.tokens(F.col("text")).alias("tokens")))
            count, words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.size("tokens"), F.lit(0))), F.lit(0))).first()
            if count:
                gone.select("chunk_id", "segment").write.parquet(f"{folder}/gone")
                gone.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{folder}/less")
            head |= {"gone": count, "length_gone": words}
        return head

    def _publish(self, version: str, before: dict | None, segment: dict | None, reused: int) -> dict:
        parts = [*(before["segments"] if before else []), *([segment] if segment else [])]
        head = {"version": version, "previous": before["version"] if before else None, "segments": parts, "written": segment["rows"] if segment else 0, "reused": reused, "taken_out": segment["gone"] if segment else 0}
        self._write_atomic(f"log/{version}.json", head)
        self._write_atomic("segments.json", {"version": version})
        return head
