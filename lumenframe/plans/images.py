"""Queries of the image and colour operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import fixtures as X
from lumenframe.functions import color
from lumenframe.operators import image as I
from lumenframe.registry import query

K = ["vec_id"]


@query("img_integral", f"with {X.IMG8}, r as (select *, sum(v) over (partition by vec_id, y order by x) as s from img) select vec_id, y, x, cast(sum(s) over (partition by vec_id, x order by y) as bigint) as ii from r")
def img_integral(spark, d):
    return I.integral(X.img8(spark, d), "vec_id").select("vec_id", "y", "x", "ii")


@query("img_crop_flip", f"with {X.IMG8} select vec_id, 3 - (y - 2) as y, x - 1 as x, v from img where y between 2 and 5 and x between 1 and 6")
def img_crop_flip(spark, d):
    return I.turned(I.crop(X.img8(spark, d), 2, 1, 4, 6), "flip", 4, 6).select("vec_id", "y", "x", "v")


for _how, _y, _x in (("90", "x", "7 - y"), ("180", "7 - y", "7 - x"), ("270", "7 - x", "y")):

    @query(f"img_rot{_how}", f"with {X.IMG8} select vec_id, {_y} as y, {_x} as x, v from img")
    def img_rot(spark, d, how=_how):
        return I.turned(X.img8(spark, d), how, 8, 8).select("vec_id", "y", "x", "v")


@query("img_elementwise", f"with {X.PAIRS} select a_id, b_id, y, x, va + vb as add_v, va - vb as sub_v, va * vb as mul_v, cast(case when vb = 0 then null else va // vb end as bigint) as div_v, abs(va - vb) as diff_v from pairs")
def img_elementwise(spark, d):
    p, a, b = X.img8_pairs(spark, d), F.col("va"), F.col("vb")
    return p.select("a_id", "b_id", "y", "x", (a + b).alias("add_v"), (a - b).alias("sub_v"), (a * b).alias("mul_v"), F.when(b != 0, F.floor(a / b)).alias("div_v"), F.abs(a - b).alias("diff_v"))


@query("img_madd", f"with {X.IMG8} select vec_id, y, x, greatest(0, least(255, 2 * v - 40)) as v from img")
def img_madd(spark, d):
    return X.img8(spark, d).select("vec_id", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), 2 * F.col("v") - 40)).alias("v"))


@query("img_clamp_get", f"with {X.IMG8} select a.vec_id, a.y, a.x, b.v from img a join img b on a.vec_id = b.vec_id and b.y = least(7, a.y + 2) and b.x = greatest(0, a.x - 3)")
def img_clamp_get(spark, d):
    a = X.img8(spark, d).select("vec_id", F.col("y").alias("ay"), F.col("x").alias("ax"))
    b = X.img8(spark, d).select("vec_id", "y", "x", "v")
    on = a.withColumns({"y": F.least(F.lit(7).cast("bigint"), F.col("ay") + 2), "x": F.greatest(F.lit(0).cast("bigint"), F.col("ax") - 3)})
    return on.join(b, ["vec_id", "y", "x"]).select("vec_id", F.col("ay").alias("y"), F.col("ax").alias("x"), "v")


_INTERP = f"""with {X.IMG8}, p as (select distinct vec_id, (vec_id % 70) / 10.0 as py, (vec_id % 61) / 10.0 as px from img),
q as (select *, cast(floor(py) as bigint) as y0, cast(floor(px) as bigint) as x0 from p)
select q.vec_id, round(sum(i.v * case when i.y = y0 then 1 - (py - y0) else py - y0 end * case when i.x = x0 then 1 - (px - x0) else px - x0 end), 6) as value
from q join img i on i.vec_id = q.vec_id and i.y in (y0, y0 + 1) and i.x in (x0, x0 + 1) group by q.vec_id"""


@query("img_interpolate", _INTERP)
def img_interpolate(spark, d):
    img = X.img8(spark, d)
    py, px = (F.col("vec_id") % 70) / 10.0, (F.col("vec_id") % 61) / 10.0
    dy, dx = F.abs(F.col("y") - py), F.abs(F.col("x") - px)
    near = img.where((dy < 1) & (dx < 1))
    return near.groupBy("vec_id").agg(F.round(F.sum(F.col("v") * (1 - dy) * (1 - dx)), 6).alias("value"))


@query("img_block_mean2", f"with {X.IMG8} select vec_id, y // 2 as y, x // 2 as x, cast(floor(sum(v) / 4.0) as bigint) as v from img group by vec_id, y // 2, x // 2")
def img_block_mean2(spark, d):
    return I.block_mean(X.img8(spark, d), K, 2)


def _tap(n: int) -> str:
    at = ", ".join(f"max(case when y % {n} = {i} and x % {n} = {j} then v end) as p{i}{j}" for i in range(n) for j in range(n))
    return f"with {X.IMG8}, t as (select vec_id, y // {n} as y, x // {n} as x, {at} from img group by vec_id, y // {n}, x // {n})"


def _m(a: str, b: str) -> str:
    return f"(({a} + {b} + 1) >> 1)"


_ROW4 = [_m(_m(f"p{i}0", f"p{i}1"), _m(f"p{i}2", f"p{i}3")) for i in range(4)]
_S3 = _m(_m(_m("p00", "p01"), _m("p02", "p10")), _m(_m("p20", "p21"), _m("p22", "p12")))
_DOWN = {2: _m(_m("p00", "p01"), _m("p10", "p11")), 3: _m(_m(_m("p11", _S3), _S3), _S3), 4: _m(_m(_ROW4[0], _ROW4[1]), _m(_ROW4[2], _ROW4[3]))}
for _n in (2, 3, 4):

    @query(f"img_down{_n}_avg", f"{_tap(_n)} select vec_id, y, x, {_DOWN[_n]} as v from t where p{_n - 1}{_n - 1} is not null")
    def img_down(spark, d, n=_n):
        return I.downscale_average(X.img8(spark, d), K, n)


@query("img_down_rows", f"{_tap(2)} select vec_id, y, x, {_m('p00', 'p01')} as v from t")
def img_down_rows(spark, d):
    return I.downscale_rows(X.img8(spark, d), K)


@query(
    "img_nn_scale",
    f"with {X.IMG8}, g as (select n, i, j, i * 8 // n as sy, j * 8 // n as sx from (values (5), (12)) t(n), generate_series(0, 11) a(i), generate_series(0, 11) b(j) where i < n and j < n) select cast(n as int) as size, vec_id, cast(i as bigint) as y, cast(j as bigint) as x, v from g join img on img.y = sy and img.x = sx",
)
def img_nn_scale(spark, d):
    img = X.img8(spark, d)
    return I.scale_nearest(img, K, 8, 8, 5, 5).withColumn("size", F.lit(5)).unionByName(I.scale_nearest(img, K, 8, 8, 12, 12).withColumn("size", F.lit(12)))


def _bilinear_sql(n: int) -> str:
    return f"""with {X.IMG8}, s as (select i, greatest((i + 0.5::double) * (8::double / {n}) - 0.5, 0.0) as s from generate_series(0, {n - 1}) a(i)),
w as (select i, least(cast(floor(s) as bigint), 7) as i0, least(cast(floor(s) as bigint) + 1, 7) as i1, cast(round((s - floor(s)) * 1024) as bigint) as d from s),
t as (select i, i0 as at, 1024 - d as k from w union all select i, i1, d from w)
select vec_id, a.i as y, b.i as x, cast(sum(v * a.k * b.k) as bigint) >> 20 as v from t a, t b, img where img.y = a.at and img.x = b.at group by vec_id, a.i, b.i"""


@query("img_bilinear_fixed", _bilinear_sql(5))
def img_bilinear_fixed(spark, d):
    return I.scale_bilinear(X.img8(spark, d), K, 8, 8, 5, 5)


@query("img_bilinear_up", _bilinear_sql(12))
def img_bilinear_up(spark, d):
    return I.scale_bilinear(X.img8(spark, d), K, 8, 8, 12, 12)


@query("img_scale_hq", f"with {X.IMG8} select vec_id, i as y, j as x, cast(floor(sum(v) / 4.0) as bigint) as v from generate_series(0, 2) a(i), generate_series(0, 2) b(j), img where img.y - cast(floor(i * 8 / 3.0) as bigint) between 0 and 1 and img.x - cast(floor(j * 8 / 3.0) as bigint) between 0 and 1 group by vec_id, i, j")
def img_scale_hq(spark, d):
    return I.scale_hq(X.img8(spark, d), K, 8, 8, 3, 3)


def _side(c: str) -> str:
    return f"case when {c} < 0 then -({c}) when {c} > 7 then 15 - ({c}) else {c} end"


_BLUR = f"""with {X.IMG8}, d as (select unnest([-1, 0, 1]) as d),
a as (select t.vec_id, t.y, t.x, cast(floor(sum(s.v) / 3.0) as bigint) as v from img t, d join img s on s.vec_id = t.vec_id and s.y = t.y and s.x = {_side('t.x + d')} group by t.vec_id, t.y, t.x)
select t.vec_id, t.y, t.x, cast(floor(sum(s.v) / 3.0) as bigint) as v from a t, d join a s on s.vec_id = t.vec_id and s.x = t.x and s.y = {_side('t.y + d')} group by t.vec_id, t.y, t.x"""


@query("img_box_blur_r1", _BLUR)
def img_box_blur_r1(spark, d):
    return I.box_blur(X.img8(spark, d), K, 8, 8, 1)


_TOP = int(0.1 * 6**0.5 * 255)
_BILATERAL = f"""with {X.IMG8}, d as (select unnest([-1, 0, 1]) as d),
n as (select t.vec_id, t.y, t.x, s.v, greatest(0, {_TOP} * 100 - abs(s.v - t.v) * 25400) // 100 as k from img t, d dy, d dx, img s where s.vec_id = t.vec_id and s.y = t.y + dy.d and s.x = greatest(0, least(7, t.x + dx.d)))
select vec_id, y, x, cast((sum(v * k) + sum(k) // 2) // sum(k) as bigint) as v from n group by vec_id, y, x"""


@query("img_bilateral", _BILATERAL)
def img_bilateral(spark, d):
    return I.bilateral(X.img8(spark, d), K, 8, 8, 1.0, 0.1)


_LBP = f"""with {X.IMG8}, m as (select *, v & 248 as m from img),
lb as (select c.vec_id, c.label, c.y, c.x, {" + ".join(f"max(case when n.y - c.y = {dy} and n.x - c.x = {dx} and n.m > c.m then {1 << (7 - i)} else 0 end)" for i, (dy, dx) in enumerate(I.LBP_ORDER))} as code
 from m c join m n on n.vec_id = c.vec_id and abs(n.y - c.y) <= 1 and abs(n.x - c.x) <= 1 where c.y between 1 and 6 and c.x between 1 and 6 group by c.vec_id, c.label, c.y, c.x)"""


@query("img_lbp", f"{_LBP} select vec_id, y, x, cast(code as bigint) as code from lb")
def img_lbp(spark, d):
    return I.lbp(X.img8(spark, d), K)


@query("lbp_hist_by_label", f"{_LBP} select label, cast(code as bigint) as code, count(*) as n from lb group by label, code")
def lbp_hist_by_label(spark, d):
    return I.lbp(X.img8(spark, d), ["vec_id", "label"]).groupBy("label", "code").agg(F.count("*").alias("n"))


@query("img_draw_rect", f"with {X.IMG8} select vec_id, y, x, case when y between 1 and 5 and x between 2 and 6 and (y in (1, 5) or x in (2, 6)) then cast(floor(v * 0.5 + 100) as bigint) else v end as v from img")
def img_draw_rect(spark, d):
    return I.draw_rect(X.img8(spark, d), 1, 2, 5, 5, 200, 0.5).select("vec_id", "y", "x", "v")


_ROT = f"""with {X.IMG8}, g as (select i, j, cast(greatest(0, least(7, floor(3.5 + (j - 1.5) * sin(0.3) + (i - 1.5) * cos(0.3) + 0.5))) as bigint) as sy,
 cast(greatest(0, least(7, floor(3.5 + (j - 1.5) * cos(0.3) - (i - 1.5) * sin(0.3) + 0.5))) as bigint) as sx from generate_series(0, 3) a(i), generate_series(0, 3) b(j))
select vec_id, i as y, j as x, v from g join img on img.y = sy and img.x = sx"""


@query("img_rotate_crop", _ROT)
def img_rotate_crop(spark, d):
    return I.rotate_crop_nearest(X.img8(spark, d), K, 8, 8, 3.5, 3.5, 0.3, 4, 4)


@query("color_luma", f"with {X.PART_RGB} select k, (76 * r + 150 * g + 29 * b) >> 8 as luma, round(0.299 * r + 0.587 * g + 0.114 * b, 6) as y, round(0.5 * (b - (0.299 * r + 0.587 * g + 0.114 * b)) / 0.886, 6) as cb, round(0.5 * (r - (0.299 * r + 0.587 * g + 0.114 * b)) / 0.701, 6) as cr from rgb".replace("0.299", "0.299::double").replace("0.587", "0.587::double").replace("0.114", "0.114::double").replace("0.886", "0.886::double").replace("0.701", "0.701::double"))
def color_luma(spark, d):
    return X.part_rgb(spark, d).select("k", color.luma("r", "g", "b").alias("luma"), *(F.round(c, 6).alias(n) for n, c in zip(("y", "cb", "cr"), color.ycbcr("r", "g", "b"))))


_HSV = f"""with {X.PART_RGB}, m as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as d from rgb),
h as (select k, hi, d, case when d = 0 then -1.0 when r = hi then (g - b) / d::double when g = hi then 2 + (b - r) / d::double else 4 + (r - g) / d::double end as h from m)
select k, round(case when d = 0 then -1 when h < 0 then h * 60 + 360 else h * 60 end, 6) as h, round(case when d = 0 then 0 else d / hi::double end, 6) as s, cast(hi as double) as v from h"""


@query("color_hsv", _HSV)
def color_hsv(spark, d):
    return X.part_rgb(spark, d).select("k", *(F.round(c, 6).alias(n) for n, c in zip("hsv", color.hsv("r", "g", "b"))))


def _clip(s: str) -> str:
    return f"cast(greatest(0, least(255, {s})) as bigint)"


_YUV = f"""with {X.PART_RGB}, uv as (select y // 2 as uy, x // 2 as ux, max(g) as u, max(b) as w from rgb group by y // 2, x // 2)
select k, {_clip('r + ((359 * (w - 128)) >> 8)')} as r, {_clip('r + ((-183 * (w - 128) - 88 * (u - 128)) >> 8)')} as g, {_clip('r + ((454 * (u - 128)) >> 8)')} as b from rgb join uv on uy = y // 2 and ux = x // 2"""


@query("color_yuv420", _YUV)
def color_yuv420(spark, d):
    rgb = X.part_rgb(spark, d)
    uv = rgb.groupBy(F.floor(F.col("y") / 2).alias("uy"), F.floor(F.col("x") / 2).alias("ux")).agg(F.max("g").alias("u"), F.max("b").alias("w"))
    both = rgb.select("k", F.col("r").alias("luma"), F.floor(F.col("y") / 2).alias("uy"), F.floor(F.col("x") / 2).alias("ux")).join(uv, ["uy", "ux"])
    return both.select("k", *(c.alias(n) for n, c in zip("rgb", color.yuv_to_rgb("luma", "u", "w"))))


@query("color_pixel_ops", f"with {X.PART_RGB} select k, r + 10 as sum_r, g * 2 as mul_g, b >> 1 as half_b, least(255, r + g) as sat_rg, 76 * abs(r - g) + 150 * abs(g - b) + 29 * abs(b - r) as dist from rgb")
def color_pixel_ops(spark, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return X.part_rgb(spark, d).select("k", (r + 10).alias("sum_r"), (g * 2).alias("mul_g"), F.shiftright(b, 1).alias("half_b"), color.clamp_byte(r + g).alias("sat_rg"), color.distance((r, g, b), (g, b, r)).alias("dist"))


@query("color_bgr_export", f"with {X.PART_RGB} select y, string_agg(lpad(hex(b), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(r), 2, '0'), '' order by x) as bgr from rgb group by y".replace("hex(", "printf('%02X', "))
def color_bgr_export(spark, d):
    px = color.packed(("b", "g", "r"))
    return X.part_rgb(spark, d).groupBy("y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", px.alias("px")))), lambda s: s["px"]), "").alias("bgr"))


_LBP2 = f"""with {X.IMG8}, m as (select vec_id, y, x, v & 248 as m from img),
g as (select i, j, i // 2 + 2 as cy, j + 2 as cx, i % 2 + 1 as k from generate_series(0, 7) a(i), generate_series(0, 3) b(j)),
n as (select * from (values {", ".join(f"({dy}, {dx}, {1 << (7 - i)})" for i, (dy, dx) in enumerate(I.LBP_ORDER))}) t(dy, dx, bit))
select c.vec_id, g.i as y, g.j as x, cast(sum(case when o.m > c.m then n.bit else 0 end) as bigint) as code
from g join m c on c.y = g.cy and c.x = g.cx cross join n join m o on o.vec_id = c.vec_id and o.y = g.cy + n.dy * g.k and o.x = g.cx + n.dx * g.k
group by c.vec_id, g.i, g.j"""


@query("img_lbp_radii", _LBP2)
def img_lbp_radii(spark, d):
    return I.lbp_radii(X.img8(spark, d), K, 2)


_FLOAT = f"""with {X.IMG8}, s as (select i, greatest((i + 0.5::double) * (8::double / 5) - 0.5, 0.0) as s from generate_series(0, 4) a(i)),
t as (select i, least(cast(floor(s) as bigint), 7) as at, 1 - (s - floor(s)) as k from s union all select i, least(cast(floor(s) as bigint) + 1, 7), s - floor(s) from s)
select vec_id, a.i as y, b.i as x, round(sum(v * a.k * b.k), 6) as v from t a, t b, img where img.y = a.at and img.x = b.at group by vec_id, a.i, b.i"""


@query("img_bilinear_float", _FLOAT)
def img_bilinear_float(spark, d):
    return I.scale_bilinear_float(X.img8(spark, d), K, 8, 8, 5, 5).withColumn("v", F.round("v", 6))


_UV = ", ".join(f"max(case when y % 2 = {i} and x % 2 = {j} then {c} end) as {c}{i}{j}" for c in ("va", "vb") for i in (0, 1) for j in (0, 1))


@query(
    "img_halve_uv",
    f"with {X.PAIRS}, t as (select a_id, y // 2 as y, x // 2 as x, {_UV} from pairs group by a_id, y // 2, x // 2) select a_id, y, x, {_m(_m('va00', 'va01'), _m('va10', 'va11'))} as va, {_m(_m('vb00', 'vb01'), _m('vb10', 'vb11'))} as vb from t",
)
def img_halve_uv(spark, d):
    return I.halve_planes(X.img8_pairs(spark, d), ["a_id"], ("va", "vb"))


_ANGLE = "(select 8 / 2.0::double as c, sin(-0.4::double) as sn, cos(-0.4::double) as cs) k"
_PLACE = f"""g as (select i, j, c + sn * (j + 3 - r) + cs * (i + 2 - r) as ty, c + cs * (j + 3 - r) - sn * (i + 2 - r) as tx
 from generate_series(0, 4) a(i), generate_series(0, 4) b(j), (select *, abs(c * cs) + abs(c * sn) as r from {_ANGLE}))"""


@query("img_rotate_nearest", f"with {X.IMG8}, {_PLACE} select vec_id, i as y, j as x, v from g join img on img.y = greatest(0, least(7, cast(trunc(ty + 0.5) as bigint))) and img.x = greatest(0, least(7, cast(trunc(tx + 0.5) as bigint)))")
def img_rotate_nearest(spark, d):
    return I.rotate_crop(X.img8(spark, d), K, 8, 8, 0.4, 3, 2, 5, 5)


@query(
    "img_rotate_bilinear",
    f"""with {X.IMG8}, {_PLACE}, q as (select *, cast(trunc(ty) as bigint) as y0, cast(trunc(tx) as bigint) as x0 from g)
select vec_id, i as y, j as x, cast(trunc(round(sum(v * (case when e.e = 1 then ty - y0 else 1 - (ty - y0) end) * (case when f.f = 1 then tx - x0 else 1 - (tx - x0) end)), 6)) as bigint) as v
from q, (values (0), (1)) e(e), (values (0), (1)) f(f), img where img.y = greatest(0, least(7, y0 + e.e)) and img.x = greatest(0, least(7, x0 + f.f)) group by vec_id, i, j""",
)
def img_rotate_bilinear(spark, d):
    return I.rotate_crop(X.img8(spark, d), K, 8, 8, 0.4, 3, 2, 5, 5, bilinear=True)


_MOTION = "select distinct vec_id, (vec_id % 5 - 2) * 0.5::double as shift_x, (vec_id % 3 - 1) * 0.75::double as shift_y, 1 + (vec_id % 7) / 100.0::double as scale, (vec_id % 11 - 5) * 0.01::double as alpha from"
_WARP = f"""with {X.IMG8}, m as ({_MOTION} img), t as (select vec_id, i, j, sin(alpha) * scale * (j - 3.5) + cos(alpha) * scale * (i - 3.5) + 3.5 + shift_y as ty,
 cos(alpha) * scale * (j - 3.5) - sin(alpha) * scale * (i - 3.5) + 3.5 + shift_x as tx from m, generate_series(0, 7) a(i), generate_series(0, 7) b(j))"""


def motions(spark, d):
    k = F.col("vec_id")
    parts = ((k % 5 - 2) * 0.5).alias("shift_x"), ((k % 3 - 1) * 0.75).alias("shift_y"), (1 + (k % 7) / 100.0).alias("scale"), ((k % 11 - 5) * 0.01).alias("alpha")
    return X.table(spark, d, "embeddings").select("vec_id", *parts)


@query("img_warp_nearest", f"{_WARP} select t.vec_id, t.i as y, t.j as x, v from t join img on img.vec_id = t.vec_id and img.y = greatest(0, least(7, cast(trunc(ty + 0.5) as bigint))) and img.x = greatest(0, least(7, cast(trunc(tx + 0.5) as bigint)))")
def img_warp_nearest(spark, d):
    return I.warp(X.img8(spark, d), "vec_id", motions(spark, d), nearest=True)


@query(
    "img_warp",
    f"""{_WARP}, c as (select vec_id, i, j, greatest(0, least(7, ty)) as ty, greatest(0, least(7, tx)) as tx from t),
q as (select *, cast(floor(ty) as bigint) as y0, cast(floor(tx) as bigint) as x0 from c)
select q.vec_id, q.i as y, q.j as x, cast(floor(sum(v * (case when e.e = 1 then ty - y0 else 1 - (ty - y0) end) * (case when f.f = 1 then tx - x0 else 1 - (tx - x0) end)) + 1e-9) as bigint) as v
from q, (values (0), (1)) e(e), (values (0), (1)) f(f), img where img.vec_id = q.vec_id and img.y = least(7, y0 + e.e) and img.x = least(7, x0 + f.f) group by q.vec_id, q.i, q.j""",
)
def img_warp(spark, d):
    return I.warp(X.img8(spark, d), "vec_id", motions(spark, d))


_CORNERS = f"""with m as ({_MOTION} embeddings), c as (select vec_id, cos(alpha) * scale * x - sin(alpha) * scale * y + shift_x as cx, sin(alpha) * scale * x + cos(alpha) * scale * y + shift_y as cy
 from m, (values (-4), (4)) a(x), (values (-4), (4)) b(y))"""


@query("motion_coverage", f"{_CORNERS} select vec_id, round(least(0, min(cx)), 6) + 0 as x_min, round(greatest(0, max(cx)), 6) as x_max, round(least(0, min(cy)), 6) + 0 as y_min, round(greatest(0, max(cy)), 6) as y_max, round(greatest(1, max(abs(cx)) / 4, max(abs(cy)) / 4), 6) as fill from c group by vec_id")
def motion_coverage(spark, d):
    from lumenframe.operators.motion import coverage

    return coverage(motions(spark, d), 8, 8).select("vec_id", *((F.round(c, 6) + 0).alias(c) for c in ("x_min", "x_max", "y_min", "y_max", "fill")))
