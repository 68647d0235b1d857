"""Versions of a corpus: hashes, manifests, differences, caches and what an update has to compute anew."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import generation_cost, short_hash
from ..plans.shared import fixed
from . import digests


def pair_list_hash(key: Column, value: Column) -> Column:
    """An aggregate: SHA-256 of the sorted list of pairs as compact JSON."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.array(key.cast("string"), value)))), 256)


def document_hashes(articles: DataFrame) -> DataFrame:
    """pcode, article_count, document_hash from article_id, pcode and hash: pair_list_hash of each pcode's articles, in constant memory."""
    return digests.pairs(articles, F.col("pcode"), F.col("article_id"), F.col("hash")).select(F.col("key").cast(dict(articles.dtypes)["pcode"]).alias("pcode"), F.col("n").alias("article_count"), F.col("digest").alias("document_hash"))


def manifest(articles: DataFrame, date: str) -> DataFrame:
    """One row: version (date and twelve digits of the corpus hash), corpus_hash, counts. The corpus hash goes over the documents' hashes, so that a document's articles meet in its own group."""
    docs = fixed(document_hashes(articles))
    counts = docs.agg(F.sum("article_count").alias("article_count"), F.count(F.lit(1)).alias("document_count"))
    whole = digests.pairs(docs, None, F.col("pcode"), F.col("document_hash")).agg(F.coalesce(F.max("digest"), F.sha2(F.lit("[]"), 256)).alias("corpus_hash"))
    total = counts.crossJoin(F.broadcast(whole))  # one row each
    return total.withColumn("version", F.concat(F.lit(f"{date}-"), F.substring("corpus_hash", 1, 12)))


def diff(old: DataFrame, new: DataFrame, key: str = "article_id", value: str = "hash") -> DataFrame:
    """Each key's status between two versions: NEW, DELETED, CHANGED or UNCHANGED."""
    a, b = old.select(F.col(key), F.col(value).alias("old")), new.select(F.col(key), F.col(value).alias("new"))
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "DELETED").when(F.col("old") != F.col("new"), "CHANGED").otherwise("UNCHANGED")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def pending(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose summary isn't cached for just their text. cache: chunk_id, hash."""
    return chunks.withColumn("hash", short_hash(F.col("text"))).join(cache.select("chunk_id", "hash"), ["chunk_id", "hash"], "left_anti")


# fixed values: prices of a million tokens, tokens of the instruction and of a summary, and how much of the input a cached prefix is and costs
PRICE_IN, PRICE_OUT, INSTRUCTION_TOKENS, SUMMARY_TOKENS, CACHED_SHARE, CACHED_PRICE = 0.25, 1.50, 160, 60, 0.95, 0.25


def summary_cost(chunks: DataFrame, laws: DataFrame, count) -> DataFrame:
    """One row: n_chunks, input_tokens, output_tokens, cost_no_cache and cost_with_implicit_cache of the summaries that are still to be made. Each call reads the chunk's whole law.

    chunks: law and text, as pending() gives them; laws: law and tokens, a row a law; count: from a text to its tokens, as columns.
    """
    each = chunks.join(laws.select("law", "tokens"), "law", "left").select((F.coalesce("tokens", F.lit(0)) + count(F.col("text")) + INSTRUCTION_TOKENS).alias("t"))
    total = each.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("input_tokens")).withColumn("output_tokens", F.col("n_chunks") * SUMMARY_TOKENS)
    cost = lambda shared: generation_cost(F.col("input_tokens"), F.col("output_tokens"), PRICE_IN, PRICE_OUT, shared, CACHED_PRICE)
    return total.withColumns({"cost_no_cache": cost(0.0), "cost_with_implicit_cache": cost(CACHED_SHARE)})


def reused(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """chunks (chunk_id, text) with the previous version's vector where the text is the same; null where it has to be made."""
    old = previous.select("chunk_id", F.col("text").alias("old_text"), "vector")
    joined = chunks.join(old, "chunk_id", "left")
    return joined.select(*chunks.columns, F.when(F.col("old_text") == F.col("text"), F.col("vector")).alias("vector"))


class Store:
    """Published versions below a path of any file system that Spark reaches: a folder a version, and a pointer that moves by rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._fs_path(f"{self.path}/{name}"))

    def pointer(self, name: str = "active.json") -> dict | None:
        if not self._exists(name):
            return None
        source = self._fs.open(self._fs_path(f"{self.path}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        except Py4JJavaError as e:
            raise ValueError(f"the pointer {name} can't be read") from e
        finally:
            source.close()

    def _write_atomic(self, name: str, data: dict) -> None:
        """Written beside, then renamed over in one step, so that there is an old or a new pointer at any time."""
        text = json.dumps(data, ensure_ascii=False, sort_keys=True).encode()
        temp, final = (self._fs.makeQualified(self._fs_path(f"{self.path}/{x}")) for x in (f".{uuid.uuid4().hex}", name))
        self._fs.mkdirs(final.getParent())
        if final.toUri().getScheme() == "file":  # where Hadoop's own rename first deletes
            with open(temp.toUri().getPath(), "wb") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            self._fs.delete(self._fs_path(final.getParent(), f".{final.getName()}.crc"), False)
            os.replace(temp.toUri().getPath(), final.toUri().getPath())
            return
        out = self._fs.create(temp, True)
        try:
            out.write(bytearray(text))
            out.hsync()
        finally:
            out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, final, how)

    def publish(self, articles: DataFrame, date: str) -> dict:
        """Writes the version's snapshot if it is new, then moves the pointer. Publishing the same content again changes nothing; a new date alone is a refresh of metadata."""
        head = manifest(articles, date).first().asDict()
        before = self.pointer()
        folder = f"versions/{head['version']}"
        if not self._exists(f"{folder}/_SUCCESS"):
            articles.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        changed = before is None or before["corpus_hash"] != head["corpus_hash"]
        refreshed = not changed and before["version"] != head["version"]
        if changed or refreshed:
            self._write_atomic("active.json", head | {"previous_version": (before or {}).get("version"), "content_changed": changed, "metadata_only": refreshed})
        return {"version": head["version"], "changed": changed, "refreshed": refreshed}

    def load(self, version: str | None = None) -> DataFrame:
        """The active version, or a named one."""
        version = version or (self.pointer() or {}).get("version")
        if version is None:
            raise LookupError("no version is published")
        return self.spark.read.parquet(f"{self.path}/versions/{version}")

    def rollback(self) -> str:
        now = self.pointer()
        if not now or not now.get("previous_version"):
            raise LookupError("there is no version to go back to")
        head = manifest(self.load(now["previous_version"]), now["previous_version"].rsplit("-", 1)[0]).first().asDict()
        self._write_atomic("active.json", head | {"previous_version": None, "content_changed": True, "metadata_only": False})
        return head["version"]


#: Which version is active where no pointer says so, or one that can't be read.
NO_INDEX, NO_LAWS, UNREADABLE, UNKNOWN = "legacy-unversioned", "legacy-current-laws", "manifest-unreadable", "unknown"


class Indexes(Store):
    """Built indexes beside the corpus versions that they were built from: indexes/<version> holds chunks with vectors, and index.json says which one serves.

    An index is written in the state building; only what is complete and passed its regression becomes ready and active.
    """

    def write(self, chunks: DataFrame, version: str, law_version: str, embedding: str, dimension: int, contextual: bool) -> dict:
        """Writes chunks (chunk_id, parent_id, part, text, vector) of a candidate; a version that is there already stays as it is."""
        folder = f"indexes/{version}"
        head = {"version": version, "law_version": law_version, "embedding": embedding, "dimension": dimension, "contextual": contextual, "state": "building", "path": folder}
        if not self._exists(f"{folder}/_SUCCESS"):
            chunks.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._write_atomic(f"{folder}.json", head)
        return head

    def activate(self, head: dict, recall: float, passed: bool) -> dict:
        """Moves the pointer to a candidate that passed; an error leaves the pointer where it is."""
        check_activation("ready" if self._exists(f"{head['path']}/_SUCCESS") else "incomplete", passed)
        before = self.read_pointer()
        ready = head | {"state": "ready", "active_version": head["version"], "recall": recall, "previous_version": before.get("active_version") if before else None}
        self._write_atomic(f"{head['path']}.json", ready)
        self._write_atomic("index.json", ready)
        return ready

    def read_pointer(self) -> dict | None:
        """The pointer; None without one or where it can't be read."""
        try:
            return self.pointer("index.json")
        except ValueError:
            return None

    def select(self, embedding: str, dimension: int, contextual: bool) -> tuple[str, DataFrame] | None:
        """Version and chunks of the active index if it is ready and of this kind, else of the unversioned one, else None: then one has to be built."""
        head = self.read_pointer()
        wanted = {"state": "ready", "embedding": embedding, "dimension": dimension, "contextual": contextual}
        if head and all(head.get(k) == v for k, v in wanted.items()) and self._exists(f"{head.get('path')}/_SUCCESS"):
            return head.get("active_version") or head["version"], self.spark.read.parquet(f"{self.path}/{head['path']}")
        legacy = f"indexes/{embedding}_{dimension}_{'ctx' if contextual else 'noctx'}"
        return (NO_INDEX, self.spark.read.parquet(f"{self.path}/{legacy}")) if self._exists(f"{legacy}/_SUCCESS") else None

    def active_laws(self) -> DataFrame:
        """The corpus version that the serving index was built from, however new the published one is; without such a pair the published one."""
        version = (self.read_pointer() or {}).get("law_version")
        return self.load(version if version and self._exists(f"versions/{version}/_SUCCESS") else None)

    def active_versions(self) -> tuple[str, str]:
        """Versions of index and laws for traces, with a word of its own for each way in which there is none."""
        try:
            head = self.pointer("index.json")
        except ValueError:
            return UNREADABLE, UNREADABLE
        if head is None:
            return NO_INDEX, NO_LAWS
        return str(head.get("active_version") or head.get("version") or UNKNOWN), str(head.get("law_version") or UNKNOWN)


class ActivationRefused(RuntimeError):
    """An index that isn't ready or failed its regression."""


def check_activation(state: str, regression_passed: bool) -> None:
    if state != "ready" or not regression_passed:
        raise ActivationRefused(f"state {state}, regression {'passed' if regression_passed else 'failed'}")


def copy_missing(store: Store, seed: str, target: str, required: list[str]) -> dict[str, str]:
    """Copies the required files that target lacks from seed and gives what became of each: copied, preserved or missing. Paths are folders of the store's file system."""
    out = {}
    for name in required:
        to, come = store._fs_path(f"{target}/{name}"), store._fs_path(f"{seed}/{name}")
        if store._fs.exists(to):
            out[name] = "preserved"
        elif not store._fs.exists(come):
            out[name] = "missing"
        else:
            conf = store.spark._jsc.hadoopConfiguration()
            store.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store._fs, come, store._fs, to, False, conf)
            out[name] = "copied"
    return out


def missing_files(seed: DataFrame, present: DataFrame) -> DataFrame:
    """Seed files (path) with what a start has to do: copied or preserved."""
    return seed.join(present.select("path", F.lit(True).alias("there")), "path", "left").select("path", F.when(F.col("there"), "preserved").otherwise("copied").alias("action"))


def readiness(checks: DataFrame) -> DataFrame:
    """One row from named checks (name, passed): ready, and the failed names."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ready"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed"))


def verify_hashes(found: DataFrame, locked: DataFrame) -> DataFrame:
    """Files of a locked list (path, sha256) that are missing or differ from found (path, content)."""
    now = found.select("path", F.sha2("content", 256).alias("now"))
    return locked.join(now, "path", "left").filter(F.col("now").isNull() | (F.col("now") != F.col("sha256"))).select("path")
