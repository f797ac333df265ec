"""Mixing sources to target weights by systematic sampling.

A source's target share of the output's characters, over its share of the
input's, gives each of its documents the same expected number of copies. In
each source, documents are laid in order of doc_id on a line, each as long as
its expected copies; with one random offset per source a document is emitted
once for each integer boundary in its stretch. Counts per source are then
within one copy of their expectation, and so are those of every run of
documents, however small the expected copies are.

As all documents of a source are equally long on its line, the prefix sum at a
document is the count of rows up to it, times that length. The counts are
exact integers, taken in two levels (sums of range partitions, then rows in a
partition): a source of any size is spread over all tasks.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm import common as C

#: The offset of a source is one of 2**OFFSET_BITS, by its name and SEED.
OFFSET_BITS, SEED = 20, "mix-1"


def expected(slim: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """(source, rate, offset): expected copies of each document, and the offset, by source.

    Without targets a source's weight is the square root of its characters.
    """
    sizes = slim.groupBy("source").agg(F.sum(F.col("chars") * F.col("same")).cast("double").alias("size"))
    if targets is None:
        weighed = sizes.withColumn("weight", F.sqrt("size"))
        weights = F.round(F.sum("weight"), 6)
    else:
        if not all(isfinite(w) and w >= 0 for w in targets.values()):
            raise ValueError("weights are finite numbers from 0 on")
        most = max(targets.values(), default=0.0) or 1.0
        named = [x for k, w in targets.items() for x in (F.lit(k), F.lit(w / most))]
        given = F.create_map(*named) if named else F.lit(None).cast("map<string,double>")
        weighed = sizes.withColumn("weight", F.try_element_at(given, F.coalesce("source", F.lit(""))))
        weights = F.sum(F.col("weight").cast("decimal(38,24)")).cast("double")  # decimals: a sum in any order
    whole = weighed.where("size > 0").agg(F.sum("size").alias("total"), weights.alias("weights"))
    rate = (F.col("weight") * F.col("total")) / (F.col("weights") * F.col("size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(SEED))), 1, OFFSET_BITS // 4), 16, 10).cast("double") / (1 << OFFSET_BITS)
    rate = F.when(F.coalesce("weight", F.lit(0.0)) <= 0, F.lit(0.0) if targets is not None else F.lit(1.0)).when(F.col("size") > 0, rate).otherwise(1.0)
    return weighed.crossJoin(whole).select("source", rate.alias("rate"), offset.alias("offset"))


def _keys(docs: DataFrame) -> dict[str, Column]:
    """What orders rows and tells them apart."""
    return {"source": C.own(docs, "source"), "doc_id": C.own(docs, "doc_id"), "hash": F.xxhash64(C.own(docs, "text")), "row_hash": C.row_hash(docs)}


def copies(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, doc_id, hash, row_hash, same, copies): how often the `same` equal rows are emitted together; 0 copies are left out."""
    slim = docs.select(*(v.alias(k) for k, v in _keys(docs).items()), F.coalesce(F.length(C.own(docs, "text")), F.lit(0)).alias("chars"))
    slim = slim.groupBy("source", "doc_id", "hash", "row_hash", "chars").agg(F.count("*").alias("same"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("row_hash")]
    ranged = slim.repartitionByRange(C.parts(docs.sparkSession), F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id())
    ranged = C.kept(ranged, "mix-order")
    sums = ranged.groupBy("source", "part").agg(F.sum("same").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rates = expected(ranged, targets).withColumnRenamed("source", "s")
    starts = sums.withColumn("base", before).join(rates, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("part").alias("q"), "base", "rate", "offset")
    inside = F.sum("same").over(Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    run = ranged.withColumn("end", inside).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("q")))
    end = F.col("base") + F.col("end")
    boundary = lambda at: F.floor(F.col("offset") + at * F.col("rate"))
    n = boundary(end) - boundary(end - F.col("same"))
    return run.select("source", "doc_id", "hash", "row_hash", "same", n.alias("copies")).where("copies > 0")


def mix(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as often as it is sampled; columns as in docs, whatever their names.

    Needs doc_id, text and source. targets: weight by source, finite and not
    negative. A source that it doesn't name, or gives no weight, goes; if it
    names none that is there, all go. Without targets a source weighs the
    square root of its characters. The output has about as many characters as
    the input. A null text counts no characters, a null source is a source of
    its own (named '' in targets), null ids come last, and ties are ordered by
    the text's hash, then by that of the whole row. Rows that are equal in all
    columns share one stretch: together they are emitted as often as it says;
    rows that differ in any column are each their own. A source without
    characters that isn't to go is emitted as it is. Empty docs give no rows.
    """
    found, keys = copies(docs, targets), [*_keys(docs)]
    packed = C.rows(docs, **{f"own_{k}": v for k, v in _keys(docs).items()})
    same = [F.col(f"own_{k}").eqNullSafe(F.col(k)) for k in keys]
    joined = packed.join(found.hint("shuffle_hash"), same)
    every = joined.where("same = 1").select("row", "copies").unionByName(joined.where("same > 1").dropDuplicates(keys).select("row", "copies"))
    return C.unpacked(every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")), docs.columns)


def op7_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each emitted copy of a document."""
    found = copies(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them."""
    return mix(docs)


ORACLE = f"""
with d as (select source, doc_id, coalesce(length(text), 0) as chars from documents),
s as (select source, cast(sum(chars) as double) as size, sqrt(cast(sum(chars) as double)) as weight from d group by source),
t as (select sum(size) as total, round(sum(weight), 6) as weights from s where size > 0),
r as (select source, case when size > 0 then (weight * total) / (weights * size) else 1.0::double end as rate,
 cast(cast('0x' || substr(md5(coalesce(source, '') || '{SEED}'), 1, {OFFSET_BITS // 4}) as bigint) as double) / {1 << OFFSET_BITS} as shift from s, t),
p as (select d.doc_id, d.source, r.rate, r.shift, row_number() over (partition by d.source order by d.doc_id) as nth
 from d join r on d.source is not distinct from r.source),
n as (select doc_id, source, cast(floor(shift + nth * rate) - floor(shift + (nth - 1) * rate) as bigint) as copies from p)
select doc_id, source, unnest(range(1, copies + 1)) as copy from n
"""
