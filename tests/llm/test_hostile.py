"""Repetitive and skewed input: time and memory stay in proportion to it."""

from __future__ import annotations

import resource
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import lines, neardup

CODE = """
import resource, time, numpy as np, pyarrow as pa
from lumenframe.llm import common as C, ctw, decontam, html, licenses, lines, neardup, quality, secrets
text = "a " * (1 << 20)
batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text], "tid": [1]})
base, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
"""
RUNS = {
    "ctw": "k, n, at, own = ctw._distinct(pa.table({'text': [text]})); ctw.Subtree(k, n).bits(ctw.top_of(ctw.Subtree(k, n).upwards()), at, own)",
    "html": "html.content('<p>' + text)",
    "licenses": "assert licenses.Scanner(licenses.NOTICES).scan(text) == []",
    "lines": "[*lines._line_rows(2, 1)([batch])]",
    "short lines": "[*lines._line_rows(2, 1)([pa.RecordBatch.from_pydict({'doc_id': [1], 'text': [text.replace(' ', chr(10))]})])]",
    "quality": "quality.statistics(batch.column('text'), {})",
    "neardup": "[*neardup._signed([batch])]; [*neardup._sets([batch])]",
    "secrets": "assert secrets.secrets(text) == []",
    "decontam": "r = decontam._matches(batch, decontam.Tests([7], ['a ' * 200])); assert [x.tolist() for x in r] == [[0], [0], [200], [0], [0]]",
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_two_megabytes_of_one_word(name):
    """Under 10 seconds and 300 MB above what the imports take."""
    code = CODE + RUNS[name] + "\nprint(time.process_time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024)"
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert made.stdout, made.stderr[-2000:]
    seconds, mb = map(float, made.stdout.split())
    assert seconds < 10 and mb < 300


def test_one_line_in_very_many_documents(spark):
    """A footer of 200,000 rows beside near copies of it: only the first stays."""
    footer = "this footer stands below every page of the whole collection"
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50_000 == 7, F.lit(footer.replace("page", "pace"))).otherwise(F.lit(footer)).alias("text"))
    plan = lines.dropped_lines(docs)
    assert plan.count() == 199_999 and plan.where("doc_id = 0").count() == 0


def test_a_band_of_very_many_texts_and_one_outlier(spark):
    """Members of one root in a bucket are not paired with each other, only with the outlier."""
    members = spark.range(50_001).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("tid"))
    roots = spark.range(1, 50_001).select("id", F.lit(1).cast("long").alias("root"))
    began = time.time()
    pairs = neardup.candidates(members, roots)
    assert pairs.count() == 50_000 and pairs.where("a <> 0").count() == 0
    assert time.time() - began < 60


def test_candidates_are_all_pairs_of_different_roots(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 7)
    root = {i: i % 7 % 3 * 100 for i in range(60)}
    members = spark.createDataFrame([(k, i) for i in root for k in (i % 2, 9)], "key long, tid long")
    got = {tuple(r) for r in neardup.candidates(members, spark.createDataFrame([*root.items()], "id long, root long")).collect()}
    assert got == {(i, j) for i in root for j in root if i < j and root[i] != root[j]}


def test_no_windows_over_lines_segments_or_bands(spark, data):
    """What is known of a line or of a bucket is a partial aggregate."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = []
    kept = lines.C.kept

    def watched(df, name, out=0):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))  # noqa: SLF001
        return kept(df, name, out)

    lines.C.kept = watched
    try:
        lines.dedup(docs).count()
        neardup.dedup(docs).count()
    finally:
        lines.C.kept = kept
    assert len(seen) > 15 and not any("Window" in plan for _, plan in seen)
    assert all("partial_" in plan for name, plan in seen if name in ("first-lines", "shared-segments", "band-members"))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 4 << 20
