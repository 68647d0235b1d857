import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from corpuswright.llm import common, decontam, exactdup, neardup, packing, tokencount
from corpuswright.llm.tokens import encoder, tokenizer_json

ODD = ["", " ", "a", "don't  stop\n\n\n ok", "²³ ¼x 12½", "日本語 text", "x<|endoftext|>y", "\x1c\x85 z", "é ñ Ünï", "  a", "a_b__c 1_2", "🙂 ok", "tab\t\tend \r\n"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words long, kept string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_library(library):
    enc = encoder(tokenizer_json())
    r = random.Random(1)
    for text in ["".join(r.choices("a b's 1.\n", k=r.randrange(40))) for _ in range(3000)]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    pool = "ab cZ'sté\n\t09._-ßœ“” ² ​<|endoftext|>中"
    for text in ODD + ["".join(r.choices(pool, k=r.randrange(60))) for _ in range(1500)]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_counts(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (50, None), (None, "one two"), (51, "long text, " * 100_000)]
    got = tokencount.count_tokens(docs_of(spark, rows).repartition(3), limit=3, each=4, most=3).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    assert tokencount.count_tokens(docs_of(spark, [])).collect() == []


def test_every_script_goes_through_the_table(spark, library):
    """Texts in other scripts are split too, met in the table, and counted as the library counts them."""
    r = random.Random(9)
    pools = ["привет мир как дела".split(), "長期 照顧 服務法 日本語 テスト".split(), "שלום عربى ไทย ელ €5 😀👍🏽 ²³ Ⅳ ９".split(), "naïve Straße œuvre ǅ ʼn".split()]
    texts = [r.choice(["", " "]).join(r.choices(pool, k=40)) + r.choice(["", "\n\n", "!  "]) for pool in pools for _ in range(40)]
    r.shuffle(texts)
    texts += ["".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x30000)])) for _ in range(30)) for _ in range(2000)] + ["日本<|endoftext|>語", "a\u2028b\u3000c\u200d"]
    got = {x.doc_id: x.n_tokens for x in tokencount.count_tokens(docs_of(spark, list(enumerate(texts)))).collect()}
    assert all(got[i] == len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts))
    enc = encoder(tokenizer_json())
    for text in texts[:160]:
        assert "".join(enc.split(text)) == text
    table = tokencount.frequent_pieces(docs_of(spark, list(enumerate(texts[:120]))).select("text"), spark.sparkContext.broadcast(tokenizer_json()), 4096, 1000)
    held = [p in table for t in texts[:120] for p in enc.split(t)]
    assert sum(held) / len(held) > 0.6
    few = tokencount.count_tokens(docs_of(spark, list(enumerate(texts))), sample=100).collect()  # a table of some rows only
    assert {x.doc_id: x.n_tokens for x in few} == got
    assert all(enc.encode(t) == enc.ids_of(t).tobytes() for t in texts)


def test_packing_round_trip(spark, library):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["alpha", "Beta,", "ñu", "x"], k=r.randrange(70)))) for i in range(40)] + [(90, None), (90, "same"), (90, "same"), (None, "q"), (91, "very long\n" * 20_000)] + list(enumerate(ODD, 100))
    pieces = packing.pack(docs_of(spark, rows).repartition(3), length=16).collect()
    taken = {}
    for p in pieces:
        for k in range(p.length):
            assert taken.setdefault((p.sequence_id, p.offset + k), p) is p
        assert p.offset + p.length <= 16
    last = max(s for s, _ in taken)
    assert all((s, o) in taken for s in range(last) for o in range(16))
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for i, t in rows:
        if [x for x, _ in rows].count(i) == 1:
            ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 1], 0
            for p in sorted(by[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
    assert sum(p.length for p in by[90]) == 1 + 2 * (len(library.encode("same").ids) + 1)
    assert packing.pack(docs_of(spark, [])).collect() == []


def test_long_pieces_are_not_held():
    enc = encoder(tokenizer_json())
    enc.encode("z" * 5000 + " ok")
    assert not any(len(p) > 128 for cache in (enc.pieces, enc.lengths) for p in cache)


def brute_exact(rows):
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), b in zip(rows, norm):
        same = [x for (x, _), c in zip(rows, norm) if b == c]
        keep = min((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), hashlib.sha256(b.encode()).hexdigest()))
    return out


def test_exact_duplicates(spark):
    long = "".join(random.Random(3).choices("abcdefgh \n", k=60_000))
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (4, long), (6, long.replace("\n", " ")), (7, long + "x"), (8, "x" + long), (11, "r"), (11, "r"), (None, "r"), (None, "only"), (12, long[:30000] + "!" + long[30001:])]
    got = exactdup.exact_duplicates(docs_of(spark, rows).repartition(3)).collect()
    none = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=none) == sorted(brute_exact(rows), key=none)
    assert sorted(r.doc_id for r in got if r.kept and r.doc_id) == [1, 3, 4, 7, 8, 9, 11, 12]
    assert sum(r.kept for r in got) == 9
    kept = exactdup.drop_exact_duplicates(docs_of(spark, rows).repartition(3))
    assert kept.columns == ["doc_id", "text", "n_words", "kept"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 7, 8, 9, 11, 12]
    assert exactdup.exact_duplicates(docs_of(spark, [])).collect() == []
    assert max(np.diff([0, *exactdup.cut(exactdup.normalise(long))])) <= exactdup._MAX


def brute_hits(text, items, n=10):
    words = [w.decode() for w in decontam.words_of(text or "")]
    hit, of = set(), set()
    for item, t in items:
        q = [w.decode() for w in decontam.words_of(t or "")]
        k = min(n, len(q))
        for i in range(len(q) - k + 1 if q else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == q[i : i + k]:
                    hit.update(range(j, j + k))
                    of |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(of)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_decontamination(spark, block_bytes):
    r = random.Random(4)
    word = lambda k: " ".join(r.choices(["a", "b", "É", "c1"], k=k))
    items = [(i, word(r.randrange(1, 14))) for i in range(12)] + [(2, "z z"), (None, "n n"), (30, None), (31, "?!"), (31, "Q")]
    rows = [(i, word(r.randrange(0, 60)).replace(" ", r.choice([" ", ", ", "\n"]))) for i in range(60)] + [(70, None), (70, "Q-z Z!"), (71, "n N"), (72, "zz"), (73, "far " * 100_000 + "q z,Z")]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = decontam.find_contamination(docs_of(spark, rows), bench, block_bytes=block_bytes).collect()
    want = sorted((i, *brute_hits(t, items)) for i, t in rows)
    assert sorted((x.doc_id, x.n_words, x.n_hit, x.item_ids) for x in got) == want
    for x in got:
        assert x.items_sha256 == hashlib.sha256(",".join(x.item_ids).encode()).hexdigest()
        assert x.contaminated == (x.n_hit > 0) == bool(x.spans) and x.n_items == len(x.item_ids)
    spans = {x.doc_id: x.spans for x in got if x.doc_id == 71}[71]
    assert [(s.start, s.end) for s in spans] == [(0, 3)]
    assert sum(1 for x in got if not x.contaminated) == decontam.drop_contaminated(docs_of(spark, rows), bench, block_bytes=block_bytes).count()
    assert decontam.find_contamination(docs_of(spark, rows), bench.limit(0)).filter("contaminated").count() == 0


def test_automata_are_built_once_a_pass(monkeypatch):
    """A worker that reads many texts builds each block's automaton once."""
    made = []
    real = decontam.ahocorasick.Automaton
    monkeypatch.setattr(decontam.ahocorasick, "Automaton", lambda: made.append(1) or real())
    for key in ("one", "two", "three"):
        for _ in range(50):
            assert len(decontam.automaton(key, {" a b ": ["1"]})) == 1
    assert len(made) == 3


def test_clashing_fingerprints(spark, monkeypatch):
    """Chunks whose fingerprints agree by chance are told apart by their digests."""
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "bb"), (6, "aaa")]
    recipes = exactdup.chunk_recipes(docs_of(spark, rows).select("doc_id", "text"))
    weak = recipes.select("row_id", "doc_id", "text_sha256", F.transform("chunks", lambda c: F.struct(F.lit(7).cast("long").alias("fp"), c["a"], c["b"], c["c"], c["d"])).alias("chunks"))
    monkeypatch.setattr(exactdup, "chunk_recipes", lambda docs: weak)
    got = {x.doc_id: (x.keep_id, x.group_size) for x in exactdup.exact_duplicates(docs_of(spark, rows)).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 5: (2, 2), 4: (4, 1), 6: (6, 1)}


def test_large_groups_and_odd_column_names(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(4000)] + [(5, "x"), (None, "same"), (None, None)]
    frame = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, __gone int, __id int, __of int, __set int").repartition(5)
    got = exactdup.exact_duplicates(frame)
    assert {(x.keep_id, x.group_size) for x in got.collect() if x.group_size > 1} == {(1, 2667)}
    for drop in (exactdup.drop_exact_duplicates, neardup.drop_near_duplicates):
        kept = drop(frame)
        assert kept.columns == frame.columns
        # one of the group, the rows of their own, the repeated id's other text and, where it counts as alone, the row without an id
        assert sorted(x.doc_id for x in kept.filter("doc_id is not null").collect()) == sorted([1, 5, *range(0, 4000, 3)])
    bench = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert decontam.drop_contaminated(frame, bench).filter("text = 'same'").isEmpty()


@pytest.mark.parametrize("most", [10, 2])
def test_ids_beyond_the_broadcast(spark, most):
    docs = docs_of(spark, [(i, "t") for i in (1, 2, 3, 3, None)])
    gone = spark.createDataFrame([(1,), (3,), (9,)], "doc_id long")
    assert sorted(str(x.doc_id) for x in common.without_ids(docs, gone, most).collect()) == ["2", "None"]
