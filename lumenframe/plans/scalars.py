"""Queries of string, CSV, JSON, numeric, sampling and ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe import fixtures as X
from lumenframe.functions import numeric as N
from lumenframe.functions import text as T
from lumenframe.registry import query


@query("str_split_nonempty", "select page_id, len(list_filter(string_split(url, '/'), t -> t <> '')) as n, list_filter(string_split(url, '/'), t -> t <> '')[2] as host from pages".replace("t -> t <> ''", "lambda t: t <> ''").replace("as n", "as n"))
def str_split_nonempty(spark, d):
    parts = T.split_nonempty(F.col("url"), "/")
    return X.table(spark, d, "pages").select("page_id", F.size(parts).cast("bigint").alias("n"), F.element_at(parts, 2).alias("host"))


@query("str_suffix_sample", "select page_id, url, lower(regexp_extract(url, '\\.[^.]*$')) as ext from pages where ends_with(lower(url), '5') and page_id % 3 = 0")
def str_suffix_sample(spark, d):
    return X.table(spark, d, "pages").where(F.lower("url").endswith("5") & (F.col("page_id") % 3 == 0)).select("page_id", "url", T.extension(F.col("url")).alias("ext"))


@query("str_translate", "select page_id, translate(url, ':/\\', '___') as name from pages")
def str_translate(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("fmt_pad", "select p_partkey, case when length(cast(p_partkey as varchar)) >= 4 then cast(p_partkey as varchar) else lpad(cast(p_partkey as varchar), 4, '0') end as key4, printf('%.2f', p_retailprice) as price from part")
def fmt_pad(spark, d):
    return X.table(spark, d, "part").select("p_partkey", T.padded(F.col("p_partkey"), 4).alias("key4"), F.format_string("%.2f", "p_retailprice").alias("price"))


_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"


def _lines(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


@query("csv_quote_filter", f"with {_LINES} select doc_id, line_no, line from lines where length(regexp_replace(line, '[^\"]', '', 'g')) % 2 = 0")
def csv_quote_filter(spark, d):
    return _lines(spark, d).where(T.balanced_quotes(F.col("line"))).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("csv_split", f"with {_LINES} select doc_id, line_no, len(string_split(line, ',')) as n, string_split(line, ',')[1] as head from lines where not contains(line, '\"')")
def csv_split(spark, d):
    f = T.csv_fields(F.col("line"))
    return _lines(spark, d).where(~F.col("line").contains('"')).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.size(f).cast("bigint").alias("n"), F.element_at(f, 1).alias("head"))


@query("json_props", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return X.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(
    "manifest_nested",
    f"with {X.RECTS}, m as (select 'img/' || o_custkey || case when o_orderkey % 3 = 0 then '.JPG' else '.png' end as path, o_orderkey from orders) select path, count(*) as n, cast(sum(w * h) as bigint) as area, cast(min(o_orderkey) as bigint) as first from m join rects on image_id = o_orderkey where ends_with(lower(path), '.jpg') group by path",
)
def manifest_nested(spark, d):
    m = X.table(spark, d, "orders").select(F.concat(F.lit("img/"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, ".JPG").otherwise(".png")).alias("path"), "o_orderkey")
    rows = m.where(T.extension(F.col("path")) == ".jpg").join(X.rects(spark, d), F.col("image_id") == F.col("o_orderkey"))
    nested = rows.groupBy("path").agg(F.collect_list(F.struct("o_orderkey", "pos", "w", "h")).alias("objects"))
    return nested.select(
        "path", F.size("objects").cast("bigint").alias("n"), F.aggregate("objects", F.lit(0).cast("bigint"), lambda s, o: s + o["w"] * o["h"]).alias("area"), F.array_min(F.transform("objects", lambda o: o["o_orderkey"])).alias("first")
    )


_NUM = "round(abs(value - 100) / greatest(abs(100.0::double), 1), 9) as err, sign(value - 250)::double as sgn, round(sign(value - 250) * sqrt(abs(value - 250)), 9) as ssqrt, round(1 / (1 + exp(-0.01::double * (value - 250))), 9) as sigmoid, greatest(50.0, least(400.0, value)) as clamped, cast(round(value) as bigint) as rounded, value * 64 >= -32768 and value * 64 <= 32767 as fits"


@query("num_scalars", f"select event_id, {_NUM} from events".replace("50.0", "50.0::double").replace("400.0", "400.0::double"))
def num_scalars(spark, d):
    v = F.col("value")
    return X.table(spark, d, "events").select(
        "event_id", F.round(N.relative_error(v, F.lit(100.0)), 9).alias("err"), F.signum(v - 250).alias("sgn"), F.round(N.signed_sqrt(v - 250), 9).alias("ssqrt"), F.round(N.logistic(0.01, 250, v), 9).alias("sigmoid"),
        N.clamp(v, 50.0, 400.0).alias("clamped"), F.round(v).cast("bigint").alias("rounded"), N.fits(v * 64, "smallint").alias("fits"),
    )


@query("num_fixed_point", "select event_id, cast(round(value * 256) as bigint) as f8, least(32767, cast(round(value * 128) as bigint)) as s16, (cast(round(value * 256) as bigint) * 77) >> 8 as prod from events")
def num_fixed_point(spark, d):
    v = F.col("value")
    return X.table(spark, d, "events").select("event_id", N.fixed(v, 8).alias("f8"), N.fixed(v, 7, 16).alias("s16"), F.shiftright(N.fixed(v, 8) * 77, 8).alias("prod"))


_POINTS = [(0.0, 1.0), (100.0, 3.0), (250.0, -2.0), (500.0, 4.0)]
_LAG = " + ".join(f"{y} * " + " * ".join(f"(value - {xj}) / ({x} - {xj})" for xj, _ in _POINTS if xj != x) for x, y in _POINTS)


@query("num_lagrange", f"select event_id, round({_LAG}, 6) as v from events".replace(".0", ".0::double"))
def num_lagrange(spark, d):
    return X.table(spark, d, "events").select("event_id", F.round(N.polynomial_through(_POINTS, F.col("value")), 6).alias("v"))


#: The same spline fitted in SQL: curvatures c0 to c3 at the four knots by elimination, then the pieces.
_KNOTS = "select " + ", ".join(f"{x}::double as x{i}, {y}::double as y{i}" for i, (x, y) in enumerate(_POINTS))
_PIECE = "(y{i} + (g{i} * (2 * c{i} + c{h}) / 6 + (y{i} - y{h}) / g{i} + (c{i} / 2 + (c{i} - c{h}) / g{i} / 6 * (value - x{i})) * (value - x{i})) * (value - x{i}))"
_SPL = f"""with k as ({_KNOTS}),
g as (select *, x1 - x0 as g1, x2 - x1 as g2, x3 - x2 as g3 from k),
r as (select *, 6 * ((y2 - y1) / g2 - (y1 - y0) / g1) as f1, 6 * ((y3 - y2) / g3 - (y2 - y1) / g2) as f2, 2 * (g1 + g2) as p1 from g),
e as (select *, -g2 / p1 as u1, f1 / p1 as w1, 2 * (g2 + g3) + g2 * (-g2 / p1) as p2 from r),
l as (select *, -g3 / p2 as u2, (f2 - g2 * w1) / p2 as w2 from e),
m as (select *, (f2 - g2 * w2) / (2 * (g2 + g3) + g2 * u2) as c3 from l),
n as (select *, u2 * c3 + w2 as c2 from m),
s as (select *, u1 * c2 + w1 as c1, 0.0::double as c0 from n)
select event_id, round(case when value <= x0 then y0 when value <= x1 then {_PIECE.format(i=1, h=0)} when value <= x2 then {_PIECE.format(i=2, h=1)} else {_PIECE.format(i=3, h=2)} end, 6) as v from events, s"""


@query("num_spline", _SPL)
def num_spline(spark, d):
    return X.table(spark, d, "events").select("event_id", F.round(N.spline_at(N.spline(_POINTS), F.col("value")), 6).alias("v"))


@query("agg_mse_ce", "select l_returnflag, round(avg((l_quantity - 25) * (l_quantity - 25)), 6) as mse, round(-avg(case when l_linestatus = 'O' then 1 else 0 end * ln(greatest(l_discount * 10, 1e-15)) + (1 - case when l_linestatus = 'O' then 1 else 0 end) * ln(greatest(1 - l_discount * 10, 1e-15))), 6) as ce from lineitem group by l_returnflag")
def agg_mse_ce(spark, d):
    y = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return X.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(N.mean_squared_error(F.col("l_quantity"), F.lit(25)), 6).alias("mse"), F.round(N.cross_entropy(y, F.col("l_discount") * 10), 6).alias("ce"))


@query("agg_weighted_mean", "select l_shipdate::date::varchar[:7] as month, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as price, round(avg(l_extendedprice), 4) as plain, count(*) as n from lineitem group by 1".replace("l_shipdate::date::varchar[:7]", "strftime(l_shipdate, '%Y-%m')"))
def agg_weighted_mean(spark, d):
    return X.table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(N.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("price"), F.round(F.avg("l_extendedprice"), 4).alias("plain"), F.count("*").alias("n"))


@query("agg_circular_mean", "select user_id, round(atan2(avg(sin(radians(value))), avg(cos(radians(value)))), 6) as angle from events group by user_id")
def agg_circular_mean(spark, d):
    return X.table(spark, d, "events").groupBy("user_id").agg(F.round(N.mean_angle(F.radians("value")), 6).alias("angle"))


@query("agg_parallel_reduce", "select l_returnflag, count(*) as n, round(sum(l_tax), 4) as total, max(l_quantity) as top, cast(sum(l_orderkey * 13 % 1000) as bigint) as fold from lineitem group by l_returnflag")
def agg_parallel_reduce(spark, d):
    return X.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("total"), F.max("l_quantity").alias("top"), F.sum(F.col("l_orderkey") * 13 % 1000).alias("fold"))


@query("sample_systematic", "select event_id, n from (select event_id, row_number() over (partition by event_type order by event_id) - 1 as n, from events) where n % 7 = 0")
def sample_systematic(spark, d):
    n = (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).cast("bigint")
    return X.table(spark, d, "events").select("event_id", n.alias("n")).where("n % 7 = 0")


@query("class_balance", "with c as (select toxic, count(*) as n from labels group by toxic), k as (select min(n) as k from c) select doc_id, toxic from labels, k qualify row_number() over (partition by toxic order by doc_id) <= k.k * 2")
def class_balance(spark, d):
    labels = X.table(spark, d, "labels")
    least = labels.groupBy("toxic").count().agg(F.min("count").alias("k"))
    ranked = labels.withColumn("nth", F.row_number().over(Window.partitionBy("toxic").orderBy("doc_id")))
    return ranked.join(F.broadcast(least), F.col("nth") <= F.col("k") * 2).select("doc_id", "toxic")


@query("priority_order", "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderpriority, o_orderdate, o_orderkey) as int) as turn from orders")
def priority_order(spark, d):
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey"))
    return X.table(spark, d, "orders").select("o_custkey", "o_orderkey", turn.alias("turn"))


@query("argmax_first", "select event_type, max(value) as top, arg_max(event_id, value * 1000000 - event_id * 0.0000001) as event_id from events group by event_type".replace("arg_max(event_id, value * 1000000 - event_id * 0.0000001)", "first(event_id order by value desc, event_id)"))
def argmax_first(spark, d):
    best = F.min(F.struct((-F.col("value")).alias("v"), "event_id"))
    return X.table(spark, d, "events").groupBy("event_type").agg(best.alias("b")).select("event_type", (-F.col("b.v")).alias("top"), F.col("b.event_id").alias("event_id"))


@query("set_append", "select event_id as id, 'pos' as kind from events where value >= 250 union all select doc_id, 'doc' from labels where toxic = 1")
def set_append(spark, d):
    a = X.table(spark, d, "events").where("value >= 250").select(F.col("event_id").alias("id"), F.lit("pos").alias("kind"))
    return a.unionByName(X.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind")))


@query("range_reverse", "select p_partkey, list_aggregate(range(p_size % 6), 'string_agg', ',') as up, list_aggregate(list_reverse(range(p_size % 6)), 'string_agg', ',') as down from part where p_size % 6 > 0")
def range_reverse(spark, d):
    n = F.col("p_size") % 6
    up = F.sequence(F.lit(0), n - 1)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return X.table(spark, d, "part").where(n > 0).select("p_partkey", text(up).alias("up"), text(F.reverse(up)).alias("down"))
