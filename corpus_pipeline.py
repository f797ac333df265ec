"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. run() writes each stage's result to the folder that all executors share
and reads it again, so that a lost executor costs one stage's tasks at most;
what a stage kept for itself, and its input, is removed when it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import common, decontam, lines, mixing, neardup, quality

STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
]

#: The discriminant, the signatures and the verification have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages leave of documents, with its columns.

    Nulls, empty and very long texts, ties, repeated rows, an empty table and
    columns of any other names are as each stage defines: null and empty texts
    pass the first four; equal texts with words are copies, one of which
    stays; mixing repeats or drops rows by their source. An empty table gives
    an empty one.
    """
    docs = common.table(spark, sf_dir, "documents")
    with common.scope(spark):
        for k, (name, stage) in enumerate(STAGES, 1):
            with common.scope(spark):
                docs = common.kept(stage(spark, docs, sf_dir), name, out=1 + (k == len(STAGES)))
    return docs
