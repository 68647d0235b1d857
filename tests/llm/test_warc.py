import base64
import gzip
import hashlib
import random
import zlib

import pytest

from corpuswright.llm import warc


def brute(rows, least):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        refers = first if i is not None and i != first and len(body) >= least else None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return out


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    r = random.Random(1)
    rows = [(i, f"http://x/{i}", r.choice(["", "<p>é", "same text", "x" * 3, f"own {i}"])) for i in range(80)] + [(100, None, None), (3, "a\r\nb c", "same text"), (3, "u", "same text"), (-7, "u", "<p>é"), (None, "u", "lonely"), (101, "u", "y\r\n\r\nz" * 50_000)]
    pages = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, payload string").repartition(4)
    got = warc.round_trip(pages, least_bytes=least).collect()
    want = brute(rows, least)
    assert sorted([(g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got], key=repr) == sorted(want, key=repr)
    text = {i: h or "" for i, _, h in rows}
    assert all(bytes(g.payload).decode() == text[g.page_id] for g in got if g.record_type == "response")
    assert warc.round_trip(pages.limit(0)).collect() == []


def records(n=5):
    return [warc.page_record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * (1 + 30_000 * (i == 2)), 0 if i == 4 else None, "2024-01-01T00:00:00Z") for i in range(n)]


def test_reader_takes_any_block_size():
    data = b"".join(records())
    for size in (1, 7, 1000, 10**6):
        found = list(warc.read_records(data[i : i + size] for i in range(0, len(data), size)))
        assert [f.kind for f in found] == ["response"] * 4 + ["revisit"]
        assert found[2].payload == b"<p>2</p>" * 30_001 and found[4].payload == b""
    assert list(warc.read_records([])) == []


def test_reader_refuses_what_is_wrong():
    good = gzip.decompress(records()[1])
    pack = lambda b: zlib.compress(b, wbits=31)
    for bad in (records()[1][:-3], pack(good[:-5]), pack(good + good), pack(good.replace(b"<p>1", b"<p>9")), pack(good.replace(b"WARC/", b"XARC/")), pack(b"WARC/1.1\r\n\r\n"), b"junk", pack(good.replace(b"Payload-Digest: sha1:", b"Payload-Digest: sha1:A"))):
        with pytest.raises(warc.WarcError):
            list(warc.read_records([bad]))


def test_files(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(records()))
    assert warc.read_files(warc.listed(spark, [str(tmp_path / f"{k}.warc.gz") for k in range(2)])).count() == 10


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_written_files(spark, tmp_path, scheme):
    """Gzip files of whole members with a warcinfo first and unique ids; a revisit names its target."""
    rows = [(i, f"http://x/{i} a", "same" if i % 3 else f"own {i} " * 200) for i in range(300)] + [(None, None, None), (7, "u", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_files(warc.with_first(pages, 0), f"{scheme}{tmp_path}/a", archive_bytes=20_000)
    made = files.collect()
    assert sum(f.records for f in made) == 302 and len(made) > 3
    ids, revisits = [], []
    for f in made:
        path = f.path.removeprefix("file://")
        with open(path, "rb") as h:
            data = h.read()
        assert path.endswith(".warc.gz") and len(data) == f.bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        found = list(warc.read_records([data]))
        assert [x.kind for x in found].count("warcinfo") == 1 and found[0].fields["warc-filename"] == path.rsplit("/", 1)[1]
        ids += [x.fields["warc-record-id"] for x in found]
        revisits += [x for x in found if x.kind == "revisit"]
    assert len(set(ids)) == len(ids) == 302 + len(made)
    assert len(revisits) == 199 and {x.fields["warc-refers-to-target-uri"] for x in revisits} == {"http://x/1%20a"}
    back = warc.read_files(files)
    assert back.count() == 302 and back.filter("refers_to = 1").count() == 199


def test_many_shared_payloads_are_joined(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i % 50}") for i in range(200)], "page_id long, url string, html string")
    got = {x.page_id: x.refers_to for x in warc.with_first(pages, 0, most=10).collect()}
    assert got == {i: i % 50 if i >= 50 else None for i in range(200)}
