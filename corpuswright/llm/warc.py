"""WARC archives: a writer of one gzip member a record, and a sequential reader.

The reader takes an archive as a stream of byte blocks. It inflates member by member, frames each record by its
Content-Length, checks that a member holds just that record and verifies block and payload digests. It keeps one record in
memory. Tasks write archives of about `archive_bytes` as .warc.gz files to a folder that all executors reach, and a table
lists those of the tasks that came to their end; readers stream the listed files in blocks. Any path that pyarrow's file
systems know will do (file, s3, gs, hdfs and so on).

Record ids are unique. A page's id is in a field of its own, and so is the id of the page that a revisit refers to, beside
the standard's target URI and date.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, split_hot, staged

_PAGE, _OF_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


class WarcError(ValueError):
    """A record that is cut short, badly framed or fails a digest."""


@dataclass
class Record:
    kind: str
    fields: dict[str, str]
    block: bytes = b""
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields below the first line; a name counts whatever its case, and a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def written(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    out = zlib.compressobj(4, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(lines).encode() + _END + block + _END) + out.flush()


def members(blocks: Iterable[bytes], step: int = 1 << 16) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its inflated data piece by piece; each has to be read to its end before the next."""
    source = (block[i : i + step] for block in blocks for i in range(0, len(block), step))
    rest = b""

    def one() -> Iterator[bytes]:
        nonlocal rest
        inflate, data = zlib.decompressobj(31), rest
        while True:
            try:
                piece = inflate.decompress(data, step)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            if piece:
                yield piece
            if inflate.eof:
                rest = inflate.unused_data
                return
            data = inflate.unconsumed_tail
            if not data and not piece:
                data = next(source, b"")
                if not data:
                    raise WarcError("the archive ends inside a member")

    while True:
        if not rest:
            rest = next(source, b"")
            if not rest:
                return
        yield one()


def read_records(blocks: Iterable[bytes]) -> Iterator[Record]:
    for member in members(blocks):
        data = bytearray()
        while (at := data.find(_END)) < 0:
            piece = next(member, None)
            if piece is None:
                raise WarcError("a record without the end of its header")
            data += piece
        head = bytes(data[:at])
        if not head.startswith(b"WARC/"):
            raise WarcError("a member that is no record")
        fields = fields_of(head)
        if not re.fullmatch(r"\d+", fields.get("content-length", "")):
            raise WarcError("a record without a length")
        need = int(fields["content-length"])
        del data[: at + 4]
        for piece in member:
            data += piece
            if len(data) > need + 4:
                break
        if len(data) != need + 4 or data[need:] != _END:
            raise WarcError("a record that isn't as long as it says")
        record = Record(fields.get("warc-type", ""), fields, bytes(data[:need]))
        verify(record)
        yield record


def verify(record: Record) -> None:
    """Takes an HTTP block apart and checks the digests that the record has. A revisit's payload digest is the one of the payload that it leaves out."""
    said = record.fields.get("warc-block-digest")
    if said and said.removeprefix("sha1:") != digest(record.block):
        raise WarcError("a block that differs from its digest")
    if record.fields.get("content-type", "").startswith("application/http"):
        head, _, record.payload = record.block.partition(_END)
        record.http = fields_of(head)
    else:
        record.payload = record.block
    said = record.fields.get("warc-payload-digest")
    if said and record.kind != "revisit" and said.removeprefix("sha1:") != digest(record.payload):
        raise WarcError("a payload that differs from its digest")


def record_id() -> str:
    return f"<{uuid.uuid4().urn}>"


def uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def info_record(name: str, date: str) -> bytes:
    """The record that describes an archive, its first."""
    block = b"software: corpuswright\r\nformat: WARC File Format 1.1\r\n"
    return written("warcinfo", {"WARC-Record-ID": record_id(), "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, block)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, first_url: str | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    fields = {"WARC-Record-ID": record_id(), "WARC-Date": date, "WARC-Target-URI": uri(url), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if page_id is not None:
        fields[_PAGE] = str(page_id)
    if refers_to is None:
        return written("response", fields, http + payload)
    return written("revisit", fields | {_OF_PAGE: str(refers_to), "WARC-Refers-To-Target-URI": uri(first_url), "WARC-Refers-To-Date": date, "WARC-Profile": _PROFILE}, http)


def with_first(pages: DataFrame, least_bytes: int, most: int = 200_000) -> DataFrame:
    """page_id, url, html, refers_to and first_url: the smallest page_id with an equal payload and its url, null for that page itself and for payloads below least_bytes.

    Payloads are compared by their SHA-256, which alone is shuffled. Keys that several pages share are broadcast up to
    `most`; beyond that pages are joined by key, large groups of them in place.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.withColumn("key", F.unhex(F.sha2(body, 256)))
    first = keyed.filter(F.col("page_id").isNotNull() & (F.octet_length(body) >= least_bytes)).groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("pages"))
    several = staged(first.filter("first.page_id <> last").select("key", F.col("first.page_id").alias("first"), F.substring("first.url", 1, 4096).alias("first_url"), "pages"), "several")
    joined = keyed.join(F.broadcast(several.drop("pages")), "key", "left") if several.limit(most + 1).count() <= most else split_hot(keyed, several, ["key"], "pages")
    other = F.col("page_id") != F.col("first")
    return joined.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("first_url"))


def write_files(pages: DataFrame, folder: str, archive_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives of the rows of pages (page_id, url, html, refers_to, first_url) to folder and gives path, bytes and records of each, once written.

    Every attempt of a task writes files of its own, so that an attempt that is lost or beaten leaves only files that aren't
    listed. A file is whole members, a warcinfo first, and ends at about archive_bytes.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        context, n, sink, path, size, records = TaskContext.get(), 0, None, "", 0, 0
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)))
        for page_id, url, page, refers_to, first_url in rows:
            if sink is None:
                name = f"pages-{context.partitionId():06d}-{n:05d}-{uuid.uuid4().hex}.warc.gz"
                path, size, records, n = f"{base}/{name}", 0, 0, n + 1
                sink = store.open_output_stream(path, compression=None)
                size += sink.write(info_record(name, date))
            size += sink.write(page_record(page_id, url, (page or "").encode("utf-8", "surrogatepass"), refers_to, date, first_url))
            records += 1
            if size >= archive_bytes:
                sink.close()
                sink = None
                yield row_of(path, size, records)
        if sink is not None:
            sink.close()
            yield row_of(path, size, records)

    def row_of(path, size, records):
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "bytes", "records"])

    listed = pages.select("page_id", "url", "html", "refers_to", "first_url").mapInArrow(run, "path string, bytes long, records long")
    root = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    return staged(listed, "archives").withColumn("path", F.concat(F.lit(root), "path"))


def stream(path: str, step: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in blocks; path is a URI or a local path."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as source:
        while block := source.read(step):
            yield block


def read_files(files: DataFrame) -> DataFrame:
    """A row for each page's record of the listed files (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits).

    Files are streamed, so a task's memory follows its largest record, not its files.
    """

    def number(text: str | None) -> int | None:
        return int(text) if text and re.fullmatch(r"-?\d+", text) else None

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for x in read_records(stream(path)):
                    if x.kind not in ("response", "revisit"):
                        continue
                    length = int(x.http.get("content-length", len(x.payload)))
                    rows.append((number(x.fields.get(_PAGE.lower())), x.fields.get("warc-target-uri"), length, x.fields.get("warc-payload-digest", "").removeprefix("sha1:"), x.kind, number(x.fields.get(_OF_PAGE.lower())), None if x.kind == "revisit" else x.payload))
                    size += len(x.block)
                    if len(rows) >= 500 or size >= 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return files.select("path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files to read, as read_files takes them."""
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages to .warc.gz files in the shared folder and reads them back, as read_files.

    A null html is an empty payload, a null url about:blank. Of records with equal payloads of at least least_bytes the one
    with the smallest page_id is a response and others revisit it; rows that repeat that id are responses too, and so are
    rows without an id. An empty table gives an empty result; other columns of pages are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    folder = new_path(pages.sparkSession, "warc")
    files = write_files(with_first(rows, least_bytes), folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))
    # a file each, so that all tasks read
    return read_files(files.repartitionByRange(max(1, min(files.count(), 10_000)), "path"))
