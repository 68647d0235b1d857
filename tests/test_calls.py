import os

import pytest

from corpuswright.operators import calls


def stub(folder, fails=0, bad=()):
    """A model that writes down what it is asked, also in other processes, and fails as it is told."""
    folder = str(folder)

    def model(prompts):
        out = []
        for p in prompts:
            name = os.path.join(folder, p)
            seen = os.path.getsize(name) if os.path.exists(name) else 0
            with open(name, "a") as f:
                f.write("x")
            out.append(None if seen < fails else "" if p in bad else f"re {p}")
        return out

    return model


def asked(folder):
    return {n: os.path.getsize(os.path.join(folder, n)) for n in os.listdir(folder)}


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, f"p{i % 20}") for i in range(50)] + [(90, None)], "item_id long, prompt string")


def statuses(found):
    out = {}
    for x in found.collect():
        out.setdefault(x.status, {})[x.item_id] = x.reply
    return out


def test_equal_prompts_are_sent_once_and_cached(spark, items, tmp_path):
    (tmp_path / "log").mkdir()
    model = stub(tmp_path / "log", fails=1)
    got = statuses(calls.replies(items, str(tmp_path / "c"), model, parts=3, batch=4))
    assert got[calls.MADE] == {i: f"re p{i % 20}" for i in range(50)} and got[calls.PENDING] == {90: None}
    assert asked(tmp_path / "log") == {f"p{k}": 2 for k in range(20)}  # each failed once
    again = statuses(calls.replies(items, str(tmp_path / "c"), model))
    assert again[calls.CACHED] == got[calls.MADE] and asked(tmp_path / "log") == {f"p{k}": 2 for k in range(20)}
    assert calls.missing(items, str(tmp_path / "c")).count() == 1


def test_a_budget_leaves_the_rest_to_the_next_run(spark, items, tmp_path):
    (tmp_path / "log").mkdir()
    model = stub(tmp_path / "log")
    first = statuses(calls.replies(items, str(tmp_path / "c"), model, budget=4, parts=2))
    sent = asked(tmp_path / "log")
    assert len(sent) <= 8 and set(sent.values()) == {1} and len(first[calls.PENDING]) == 51 - len(first[calls.MADE])
    last = statuses(calls.replies(items, str(tmp_path / "c"), model))
    assert set(asked(tmp_path / "log").values()) == {1} and len(asked(tmp_path / "log")) == 20 and len(last[calls.CACHED]) + len(last[calls.MADE]) == 50


def test_invalid_replies_are_asked_again(spark, items, tmp_path):
    (tmp_path / "log").mkdir()
    model = stub(tmp_path / "log", bad=["p3"])
    got = statuses(calls.replies(items, str(tmp_path / "c"), model, tries=3))
    assert got[calls.INVALID] == {3: None, 23: None, 43: None} and asked(tmp_path / "log")["p3"] == 3 and asked(tmp_path / "log")["p4"] == 1
    model = stub(tmp_path / "log")
    then = statuses(calls.replies(items, str(tmp_path / "c"), model))
    assert set(then[calls.MADE]) == {3, 23, 43} and asked(tmp_path / "log")["p3"] == 4 and asked(tmp_path / "log")["p4"] == 1


def test_a_call_that_raises_is_a_try(spark, items, tmp_path):
    def model(prompts):
        raise RuntimeError("no answer")

    got = statuses(calls.replies(items, str(tmp_path / "c"), model, tries=2))
    assert len(got[calls.INVALID]) == 50 and calls.cache_of(spark, str(tmp_path / "c")).filter("tries = 2").count() == 20
    assert calls.replies(items.limit(0), str(tmp_path / "d"), model).collect() == []
