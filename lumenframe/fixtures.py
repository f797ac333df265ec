"""Images, rectangles, pixels, lanes and signals derived from the shared tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def img8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, y, x, v): each embedding as an 8 x 8 image of values 0 to 255."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("e").cast("double") * 256 + 128)))
    return e.select("vec_id", "label", F.floor(F.col("pos") / 8).alias("y"), (F.col("pos") % 8).cast("bigint").alias("x"), v.cast("bigint").alias("v"))


IMG8 = """img as (select vec_id, label, cast((i - 1) // 8 as bigint) as y, cast((i - 1) % 8 as bigint) as x,
 cast(greatest(0, least(255, floor(cast(e as double) * 256 + 128))) as bigint) as v
 from (select vec_id, label, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from embeddings))"""


def img8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_id, b_id, y, x, va, vb): each image with the next one of its label."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("b_id")).where("b_id is not null")
    a, b = img8(spark, sf_dir), img8(spark, sf_dir)
    a = a.join(ids, "vec_id").select(F.col("vec_id").alias("a_id"), "b_id", "y", "x", F.col("v").alias("va"))
    return a.join(b.select(F.col("vec_id").alias("b_id"), "y", "x", F.col("v").alias("vb")), ["b_id", "y", "x"]).select("a_id", "b_id", "y", "x", "va", "vb")


PAIRS = f"""{IMG8}, nxt as (select vec_id as a_id, lead(vec_id) over (partition by label order by vec_id) as b_id from embeddings),
pairs as (select n.a_id, n.b_id, a.y, a.x, a.v as va, b.v as vb from nxt n join img a on a.vec_id = n.a_id join img b on b.vec_id = n.b_id and b.y = a.y and b.x = a.x)"""

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pos, x, y, w, h, conf, kind): line items as rectangles; pos numbers those of an image."""
    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)).cast("bigint")
    size = F.col("l_quantity").cast("bigint") + 10
    return li.select(
        F.col("l_orderkey").alias("image_id"), pos.alias("pos"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_suppkey") % 60).alias("y"), size.alias("w"), size.alias("h"),
        F.floor("l_extendedprice").alias("conf"), F.when(F.col("l_returnflag") == "N", "truth").otherwise("det").alias("kind"),
    )


RECTS = f"""rects as (select l_orderkey as image_id, row_number() over (partition by l_orderkey order by {", ".join(_LINE)}) as pos, l_partkey % 60 as x, l_suppkey % 60 as y,
 cast(trunc(l_quantity) as bigint) + 10 as w, cast(trunc(l_quantity) as bigint) + 10 as h, cast(floor(l_extendedprice) as bigint) as conf,
 case when l_returnflag = 'N' then 'truth' else 'det' end as kind from lineitem)"""


def part_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, y, x, r, g, b): parts as the pixels of an image 40 wide."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), F.floor(k / 40).alias("y"), (k % 40).alias("x"), ((k * 37) % 256).alias("r"), ((F.col("p_size").cast("bigint") * 5) % 256).alias("g"), (F.floor("p_retailprice") % 256).alias("b")
    )


PART_RGB = """rgb as (select p_partkey as k, p_partkey // 40 as y, p_partkey % 40 as x, (p_partkey * 37) % 256 as r, (cast(p_size as bigint) * 5) % 256 as g, cast(floor(p_retailprice) as bigint) % 256 as b from part)"""


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, a8, b8, a16, b16): unsigned bytes and signed 16-bit lanes of line items; k and n name a line with its duplicates."""
    li = table(spark, sf_dir, "lineitem")
    k, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)).cast("bigint")
    return li.select(
        o.alias("k"), n.alias("n"), (k % 256).alias("a8"), ((s * 7) % 256).alias("b8"), ((o * 31 + k) % 65536 - 32768).alias("a16"), ((s * 257 + F.col("l_linenumber")) % 65536 - 32768).alias("b16")
    )


LANES = f"""lanes as (select l_orderkey as k, row_number() over (partition by l_orderkey order by {", ".join(_LINE)}) as n, l_partkey % 256 as a8, (l_suppkey * 7) % 256 as b8,
 (l_orderkey * 31 + l_partkey) % 65536 - 32768 as a16, (l_suppkey * 257 + l_linenumber) % 65536 - 32768 as b16 from lineitem)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, v, q): each user's event values in order of time, and quantised to 16 bits."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    q = F.least(F.lit(32767), F.floor(F.col("value") * 64))
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("n"), F.col("value").alias("v"), q.cast("bigint").alias("q"))


SIGNAL = """sig as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value as v, least(32767, cast(floor(value * 64) as bigint)) as q from events)"""
