import random

import numpy as np

from corpuswright.llm import langid

WORDS = {"en": "the of and that with from ing tion this which".split(), "fr": "le la les était être avec pour dans où ça".split(), "de": "der die und nicht für über mit schön groß ich".split()}


def rows_of(n=240, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[lang], k=r.randrange(1, 40))), lang, "s") for i in range(n) for lang in [r.choice(list(WORDS))]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)


def test_held_out_accuracy(spark):
    docs = frame(spark, rows_of() + [(900, None, "en", ""), (901, "12 ?!", "fr", ""), (902, "le la", None, ""), (902, "le la", None, ""), (None, "the of", "en", "")])
    model = langid.fit(docs.filter(~langid.held_out()), per_lang=100)
    assert model.langs == ["de", "en", "fr"]
    got = langid.identify(docs, model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    truth = {i: lang for i, _, lang, _ in rows_of()}
    held = [r[0] for r in docs.filter(langid.held_out()).select("doc_id").collect() if r[0] in truth]
    assert np.mean([by[i][0].lang_pred == truth[i] for i in held]) > 0.95 and len(held) > 20
    for i in (900, 901):
        assert by[i][0].lang_pred == "und" and by[i][0].score == 0 and by[i][0].rejected
    assert len(by[902]) == 2 and by[902][0].lang_pred == "fr" and by[None][0].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)


def test_long_text_equals_its_repeats():
    model = langid.train([t for _, t, _, _ in rows_of()], [x for *_, x, _ in rows_of()])
    unit = "le la les où ça 123 "
    short, long = (langid.logits([unit * k], model.table, model.bias, 16, block=500) for k in (60, 3000))
    assert np.allclose(short, long, atol=1e-2)
    many = [t for _, t, _, _ in rows_of()[:50]]
    one = np.concatenate([langid.logits([t], model.table, model.bias, 16) for t in many])
    assert np.allclose(langid.logits(many, model.table, model.bias, 16), one, atol=1e-5)


def test_nothing_learned(spark):
    empty = frame(spark, [])
    model = langid.fit(empty)
    assert langid.identify(empty, model).collect() == []
    assert [r.lang_pred for r in langid.identify(frame(spark, [(1, "le", None, "")]), model).collect()] == ["und"]


def test_letters():
    for text in ("½", "② ①", "Ⅷ", "x²"[1], "12 ?! _", "", "\u3007"):
        assert not langid.has_letter(text), text
    for text in ("½ a", "é", "я", "中", "ª"):
        assert langid.has_letter(text), text


def slow_logits(model, text):
    """n-gram by n-gram, in plain Python."""
    bits, m32 = 16, 0xFFFFFFFF
    data = list(langid.prepared(text))
    total, n = [0.0] * len(model.langs), 0
    for size, twist in ((2, 0), (3, 0x5BD1E995), (4, 0x1B873593)):
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            if (size == 2 and gram == [32, 32]) or (size > 2 and 32 in gram[1:-1]):
                continue
            h = sum(x * int(k) for x, k in zip(gram, langid._SALTS)) & m32
            h ^= twist
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & m32
            row = model.table[(h ^ h >> 13) >> 32 - bits]
            total, n = [a + float(b) for a, b in zip(total, row)], n + 1
    return [a / max(n, 1) + float(b) for a, b in zip(total, model.bias)]


def test_against_a_slow_predictor(spark):
    r = random.Random(5)
    rows = [*rows_of(120, 9), (500, "Ärger, ça 1 où!", None, ""), (501, "x", None, ""), (502, "½ ② Ⅷ", None, ""), (503, "", None, ""), (504, "le la " * 20_000, None, ""), (505, "\ud83d\ude00 die".encode("utf-16", "surrogatepass").decode("utf-16"), None, "")]
    rows += [(600 + i, "".join(r.choices("abc éß12  .", k=r.randrange(1, 60))), None, "") for i in range(40)]
    docs = frame(spark, rows)
    model = langid.fit(langid.learnable(docs), per_lang=60)
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    for i, text, *_ in rows:
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        z = np.array(slow_logits(model, text)) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(got[i].score - p.max()) < 1e-4 and p[model.langs.index(got[i].lang_pred)] > p.max() - 1e-4


def test_without_an_id(spark):
    docs = frame(spark, [(None, "the of and", "en", ""), (1, "le la les", "fr", ""), (2, "la les", "fr", "")])
    assert [x[0] for x in docs.select(langid.held_out()).collect() if x[0] is None] == []
    assert langid.fit(langid.learnable(docs)).langs == ["fr"]
