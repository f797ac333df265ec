"""Queries of array arithmetic, lane moves, colour orders, splits, and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import fixtures as X
from lumenframe.functions import color, lane
from lumenframe.functions import text as T
from lumenframe.functions import vectors as V
from lumenframe.operators import lut as L
from lumenframe.operators import motion as M
from lumenframe.registry import query


def _pairs(spark, d):
    """Each embedding (a) with that of the next id (b)."""
    e = X.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


_E = "e as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), p as (select e.vec_id, e.a, n.a as b from e join e n on n.vec_id = e.vec_id + 1)"


@query(
    "vec_arithmetic",
    f"with {_E}, z as (select vec_id, unnest(a) as a, unnest(b) as b, generate_subscripts(a, 1) as i from p) select vec_id, round(sum(i * (a + b)), 6) + 0 as plus, round(sum(i * (a - b)), 6) + 0 as minus, round(sum(i * a * 2.5), 6) + 0 as times, round(sum(i * a / 3), 6) + 0 as over, round(sum(a * b), 6) + 0 as dot from z group by vec_id",
)
def vec_arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    total = lambda v: F.round(V.dot(v, F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: i.cast("double"))), 6) + 0
    return _pairs(spark, d).select("vec_id", total(V.add(a, b)).alias("plus"), total(V.subtract(a, b)).alias("minus"), total(V.scale(a, 2.5)).alias("times"), total(V.divide(a, 3)).alias("over"), (F.round(V.dot(a, b), 6) + 0).alias("dot"))


_TEXT = "list_aggregate({}, 'string_agg', ',')"
_LANE4 = "l as (select k, list(a8 order by n) as a, list(b8 order by n) as b from lanes group by k)"


@query(
    "lane_interleave_many",
    f"with {X.LANES}, {_LANE4}, i as (select k, a, b, unnest(range(1, len(a) + 1)) as i from l) select k, string_agg(a[i] || ',' || b[i] || ',' || (255 - a[i]), ',' order by i) as three, string_agg(a[i] || ',' || b[i] || ',' || (255 - a[i]) || ',' || (255 - b[i]), ',' order by i) as four from i group by k",
)
def lane_interleave_many(spark, d):
    lanes = X.lanes(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "a8", "b8"))).alias("s"))
    a, b = F.col("s.a8"), F.col("s.b8")
    other = lambda v: F.transform(v, lambda x: 255 - x)
    text = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
    return lanes.select("k", text(V.interleave(a, b, other(a))).alias("three"), text(V.interleave(a, b, other(a), other(b))).alias("four"))


@query(
    "lane_pairwise_add",
    f"with {X.LANES}, {_LANE4} select k, {_TEXT.format('list_transform(range(1, len(a) // 2 + 1), lambda i: a[2 * i - 1] + a[2 * i])')} as sums, {_TEXT.format('a[1:len(a) // 2]')} as low, {_TEXT.format('a[len(a) // 2 + 1:]')} as high from l where len(a) % 2 = 0",
)
def lane_pairwise_add(spark, d):
    lanes = X.lanes(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "a8"))).alias("s")).select("k", F.col("s.a8").alias("a")).where("size(a) % 2 = 0")
    text = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
    return lanes.select("k", text(lane.pairwise_add(F.col("a"))).alias("sums"), text(V.low_half(F.col("a"))).alias("low"), text(V.high_half(F.col("a"))).alias("high"))


@query(
    "arr_products",
    f"with {X.SIGNAL}, s as (select user_id, n, 0.5 + v / 1000 as f from sig where n < 8) select user_id, n, round(product(f) over (partition by user_id order by n), 9) as prefix, round(product(f) over (partition by user_id order by n desc), 9) as suffix from s",
)
def arr_products(spark, d):
    s = X.signal(spark, d).where("n < 8").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", (0.5 + F.col("v") / 1000).alias("f")))).alias("s"))
    f = F.col("s.f")
    each = s.select("user_id", F.posexplode(F.arrays_zip(V.prefix_products(f).alias("prefix"), V.suffix_products(f).alias("suffix"))).alias("n", "p"))
    return each.select("user_id", F.col("n").cast("bigint").alias("n"), F.round("p.prefix", 9).alias("prefix"), F.round("p.suffix", 9).alias("suffix"))


_CLIP = "cast(greatest(0, least(255, {})) as bigint)"


@query(
    "color_yuv_orders",
    f"with {X.PART_RGB} select k, {_CLIP.format('r + 9 + ((681 * (b - 128)) >> 8)')} as blue, {_CLIP.format('r + 9 + ((-274 * (g - 128) - 132 * (b - 128)) >> 8)')} as green, {_CLIP.format('r + 9 + ((538 * (g - 128)) >> 8)')} as red, 255::bigint as alpha, r as grey_r, r as grey_b, round((0.299::double * r + 0.587::double * g) / 0.886::double, 6) as rg, g * 1.0::double as pure_g from rgb",
)
def color_yuv_orders(spark, d):
    made = color.yuv_bytes("r", "g", "b", "vu", "bgra", 1.5, 9)
    grey = color.grey("r")
    px = X.part_rgb(spark, d)
    return px.select("k", *(c.alias(n) for c, n in zip(made, ("blue", "green", "red", "alpha"))), grey[0].alias("grey_r"), grey[2].alias("grey_b"), F.round(color.weighted("r", "g", "b", color.weights("rg")), 6).alias("rg"), color.weighted("r", "g", "b", color.weights("g")).alias("pure_g"))


@query(
    "ml_best_split",
    """with g as (select user_id, value, count(*) as c, sum(t) as t from (select user_id, floor(value / 10) as value, case when event_type = 'click' then 1 else event_id % 3 end as t from events) group by user_id, value),
s as (select user_id, value, sum(c) over w as n, sum(t) over w as s, sum(c) over (partition by user_id) as an, sum(t) over (partition by user_id) as ats from g window w as (partition by user_id order by value desc)),
q as (select user_id, cast(n as bigint) as n, value as threshold, round(s * s / n::double + (ats - s) * (ats - s) / (an - n)::double, 6) as score from s where n < an)
select user_id, n, cast(threshold as bigint) as threshold, score from q qualify row_number() over (partition by user_id order by score desc, n) = 1""",
)
def ml_best_split(spark, d):
    e = X.table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.floor(F.col("value") / 10).alias("feature"), F.when(F.col("event_type") == "click", 1).otherwise(F.col("event_id") % 3).alias("target"))
    return L.best_split(e, "user_id")


@query("ml_repack", f"with {X.IMG8} select y, x, string_agg(v, ',' order by vec_id) as bytes from img group by y, x")
def ml_repack(spark, d):
    made = L.repacked(X.img8(spark, d).select(F.col("vec_id").alias("id"), "y", "x", "v"))
    return made.select("y", "x", F.array_join(F.transform("column", lambda v: v.cast("string")), ",").alias("bytes"))


@query("ml_sample_images", f"with {X.RECTS} select image_id, pos, o_custkey, o_orderstatus from rects left join orders on o_orderkey = image_id where kind = 'truth'")
def ml_sample_images(spark, d):
    images = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), "o_custkey", "o_orderstatus")
    return L.with_images(X.rects(spark, d).where("kind = 'truth'").select("image_id", "pos"), images)


@query(
    "motion_ignored",
    f"with {X.RECTS} select image_id, pos, case when (x + 2 >= 10 and x + 2 < 40 and y + 2 >= 5 and y + 2 < 30) or (x + 2 >= 50 and x + 2 < 55 and y + 2 >= 0 and y + 2 < 60) then 0.0::double else 1.0::double end as weight from rects",
)
def motion_ignored(spark, d):
    blocks = X.rects(spark, d).select("image_id", "pos", "x", "y").withColumn("weight", F.lit(1.0))
    ignored = spark.createDataFrame([(10, 5, 30, 25), (50, 0, 5, 60)], "x int, y int, w int, h int")
    return M.without_ignored(blocks, ignored, 4).select("image_id", "pos", "weight")


@query("str_format_parse", "select p_partkey, printf('%.3f', p_retailprice) as fixed, try_cast(trim(split_part(p_name, ' ', 2)) as bigint) as number, '(' || p_partkey || ', ' || p_size || ')' as shown from part")
def str_format_parse(spark, d):
    p = X.table(spark, d, "part")
    return p.select("p_partkey", T.fixed_decimals(F.col("p_retailprice"), 3).alias("fixed"), T.parsed(F.split_part("p_name", F.lit(" "), F.lit(2)), "bigint").alias("number"), T.shown(F.col("p_partkey"), F.col("p_size")).alias("shown"))


@query("sort_points", "select c_custkey, cast(row_number() over (partition by c_nationkey order by c_acctbal, c_custkey % 360, c_custkey) as int) as nth, cast(row_number() over (partition by c_nationkey order by (c_acctbal < 0)::int desc, c_custkey) as int) as part from customer")
def sort_points(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_nationkey")
    lexical = F.row_number().over(w.orderBy("c_acctbal", F.col("c_custkey") % 360, "c_custkey"))
    parted = F.row_number().over(w.orderBy((F.col("c_acctbal") < 0).desc(), "c_custkey"))
    return X.table(spark, d, "customer").select("c_custkey", lexical.alias("nth"), parted.alias("part"))
