import importlib
import sys

import __spark_entry__ as e


def test_every_query_runs_and_oracles_have_queries(spark):
    from corpuswright.plans import catalogue

    queries = catalogue.queries()
    assert set(catalogue.oracle_sql()) <= set(queries) and len(queries) > 50
    for name in ("chunk_pack", "route_cascade", "threshold_search", "session_quota", "graph_expand"):
        assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
    assert e.entry(spark).columns == ["queries", "recall", "mrr"]


def test_entry_without_the_llm_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("corpuswright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    find = importlib.import_module

    def missing(name, package=None):
        if name.startswith("corpuswright.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return find(name, package)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert "pipeline" not in e.queries() and not any(k.startswith("op1_") for k in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_llm_folder():
    import pathlib
    import re

    root = pathlib.Path(e.ROOT)
    for path in (root / "corpuswright").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_workers_find_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys as system

    code = (
        f"import sys; sys.path.insert(0, {e.ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['sentence_split'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([system.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
