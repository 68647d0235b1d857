import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpuswright.llm import langid
from test_neardup import brute as near
from test_tokens_and_dups import brute_hits

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = langid.fit(langid.learnable(docs))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [r for r, gone in zip(rows, langid.predict(model, [t or "" for _, t in rows])[2]) if not gone]
    seen = {}
    for i, t in rows:
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    rows = sorted(seen.values())
    rows = [r for r, n in zip(rows, near(rows)) if n[3]]
    rows = [r for r in rows if brute_hits(r[1], items)[1] == 0]
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in rows:
        want[i] = [*library.encode(t or "", add_special_tokens=False).ids, 1]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(want) < docs.count() and {p.doc_id for p in pieces} == set(want)
    at = dict.fromkeys(want, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = want[p.doc_id]
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in want.items()}
    assert sum(p.length for p in pieces) == max(p.sequence_id * 2048 + p.offset + p.length for p in pieces)


def test_stages_keep_the_columns(spark):
    rows = [(1, "the of and that this", "en", "s", 1), (2, None, None, None, None), (None, "the of and that", "en", "s", 3), (1, "the of and that this", "en", "s", 1)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, data, SF)
            assert out.schema.simpleString() == docs.schema.simpleString()
            assert out.count() <= data.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"]
