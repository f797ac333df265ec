"""The entry module must be readable without a session."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("hidden", ["lumenframe.llm", "ahocorasick", "regex", "xxhash", "corpus_pipeline"])
def test_queries_where_something_cannot_be_imported(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_workers_import_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["fft_arrow"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, timeout=200, capture_output=True, text=True)
    assert "rows" in made.stdout, made.stderr[-2000:]
