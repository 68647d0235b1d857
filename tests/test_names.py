import random

from pyspark.sql import functions as F

from corpuswright.operators import citations, routing
from corpuswright.operators.names import Names, _automaton, places, taken


def replaced(names, text):
    """Longer names first, each taken out wherever it stands."""
    out = []
    for name in sorted(names, key=len, reverse=True):
        out += [name] * text.count(name)
        text = text.replace(name, " ")
    return out, text


def test_names_taken_out_against_replacing():
    r = random.Random(1)
    for _ in range(300):
        names = {"".join(r.choices("甲乙丙", k=r.randrange(1, 5))): "x" for _ in range(r.randrange(1, 9))}
        text = "".join(r.choices("甲乙丙丁", k=r.randrange(25)))
        made = _automaton(names)
        assert [n for _, _, n in taken(made, text)] == replaced(names, text)[0], (names, text)
        assert sorted(places(made, text)) == sorted((i, i + len(n), n) for n in names for i in range(len(text)) if text.startswith(n, i))
    assert taken(_automaton({}), "甲") == [] == places(_automaton({"": "x"}), "甲")


def test_column_functions_equal_the_chained_ones(spark):
    r = random.Random(2)
    laws = list(routing.LAW_ALIASES)
    texts = ["".join(r.choice([*laws, "第 3 條", "第12條之1", "，", "長照", "的"]) for _ in range(r.randrange(9))) for _ in range(200)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    names = Names(spark, routing.LAW_ALIASES)
    for f in (routing.named_laws, routing.first_law, routing.required_articles):
        got, want = (sorted(map(tuple, rows.select("i", f(F.col("t"), a).alias("x")).filter("t is not null").collect())) for a in (names, None))
        assert got == want, f
    assert rows.filter("t is null").select(names.codes(F.col("t")), names.first(F.col("t")), names.bare(F.col("t"))).first()[:] == (None, None, None)


def test_ten_thousand_names(spark):
    codes = {f"第{i}號管理辦法": f"L{i}" for i in range(10_000)}
    names = Names(spark, codes)
    rows = spark.range(3000).select("id", F.concat(F.lit("依"), F.lit("第"), F.col("id").cast("string"), F.lit("號管理辦法及第9號管理辦法")).alias("t"))
    got = {x.id: x.c for x in rows.select("id", names.codes(F.col("t")).alias("c")).collect()}
    assert all(c == ([f"L{i}", "L9"] if len(str(i)) > 1 else ["L9"] if i == 9 else [f"L{i}", "L9"]) for i, c in got.items())
    plan = rows.select(names.codes(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2000  # doesn't grow with the names


def test_resolved_by_automaton_and_by_join(spark):
    laws = spark.createDataFrame([("L1", "老人福利法"), ("L2", "福利法"), ("L3", "身心障礙法"), ("L4", "")], "pcode string, law_name string")
    r = random.Random(3)
    bits = ["老人福利法", "福利法", "身心障礙法", "本法", "第三條", "第5條之1", "、", "很長的一段文字在這裡面沒有名稱"]
    rows = [(f"L{1 + i % 3}-{i}", f"L{1 + i % 3}", str(i), i, "".join(r.choices(bits, k=8))) for i in range(150)]
    articles = spark.createDataFrame(rows, "article_id string, pcode string, article_no string, ord int, content string")
    refs, aliases = citations.article_references(articles), citations.alias_table(laws, "老人福利法", "老")
    got, want = (sorted(map(tuple, citations.resolved(refs, laws, aliases, most).select("article_id", "seq", "step", "no", "target_pcode").collect())) for most in (10, 0))
    assert got == want and {x[-1] for x in got} == {"L1", "L2", "L3"}
