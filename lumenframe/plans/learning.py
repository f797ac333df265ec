"""Queries of table regression, detection and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import fixtures as X
from lumenframe.operators import lut as L
from lumenframe.operators import motion as M
from lumenframe.registry import query

_SAMPLES = f"{X.IMG8}, s as (select vec_id as id, y, x, v // 16 as bin, cast(label % 2 as double) as target from img)"


def samples(spark, d):
    img = X.img8(spark, d)
    return img.select(F.col("vec_id").alias("id"), "y", "x", F.floor(F.col("v") / 16).alias("bin"), (F.col("label") % 2).cast("double").alias("target"))


@query("lut_hist", f"with {_SAMPLES} select y, x, bin, count(*) as n, sum(target) as sum from s group by y, x, bin")
def lut_hist(spark, d):
    return L.histogram(samples(spark, d))


_STEP1 = f"{_SAMPLES}, w1 as (select y, x, bin, sum(target) / count(*) / 64 as weight from s group by y, x, bin)"
_F1 = f"{_STEP1}, f1 as (select id, sum(weight) as f from s join w1 using (y, x, bin) group by id)"


@query("lut_train_step", f"with {_F1} select y, x, bin, round(any_value(w1.weight) + (sum(target) - sum(f)) / count(*) / 64, 9) as weight from s join f1 using (id) join w1 using (y, x, bin) group by y, x, bin")
def lut_train_step(spark, d):
    s = samples(spark, d)
    return L.train(s, 64, 2).select(*L.CELL, F.round("weight", 9).alias("weight"))


@query("lut_predict", f"with {_F1} select id, round(f, 9) as f from f1")
def lut_predict(spark, d):
    s = samples(spark, d)
    return L.predict(s, L.train(s, 64, 1)).withColumn("f", F.round("f", 9))


_SMALL = f"{_SAMPLES}, w as (select y, x, bin as b, sum(target) / count(*) / 16 as weight from s where y < 4 and x < 4 group by y, x, bin), p as (select i.vec_id, i.y - w.y as wy, i.x - w.x as wx, weight from img i join w on i.v // 16 = w.b)"


@query("lut_predict_sliding", f"with {_SMALL} select vec_id, wy, wx, round(sum(weight), 9) as f from p where wy between 0 and 4 and wx between 0 and 4 group by vec_id, wy, wx")
def lut_predict_sliding(spark, d):
    return _windows(spark, d).withColumn("f", F.round("f", 9))


def _windows(spark, d):
    s = samples(spark, d)
    model = L.train(s.where("y < 4 and x < 4"), 16, 1)
    img = X.img8(spark, d).select("vec_id", "y", "x", F.floor(F.col("v") / 16).alias("v"))
    return L.predict_windows(img, "vec_id", model, 4, 4)


@query("det_windows", f"with {_SMALL}, f as (select vec_id, wy, wx, sum(weight) as f from p where wy between 0 and 4 and wx between 0 and 4 group by vec_id, wy, wx) select vec_id as image_id, wx / 0.5::double as x, wy / 0.5::double as y, 8.0::double as w, 8.0::double as h, round(f * f / 0.25::double, 9) as conf from f where f * f > 0.27")
def det_windows(spark, d):
    return L.detections(_windows(spark, d), "vec_id", 0.27, 4, 4, 0.5).withColumn("conf", F.round("conf", 9))


@query("det_jitter", f"with {X.RECTS}, j as (select image_id, pos, x + dx as x, y + dy as y, w, h, dx, dy from rects, (select unnest([-1, 0, 1]) as dx), (select unnest([-1, 0, 1]) as dy)) select image_id, pos, x, y, w, h, cast(dx as int) as dx, cast(dy as int) as dy from j where x >= 0 and y >= 0 and x + w <= 100 and y + h <= 100")
def det_jitter(spark, d):
    return L.jittered(X.rects(spark, d).select("image_id", "pos", "x", "y", "w", "h"), 1, F.lit(100), F.lit(100)).select("image_id", "pos", "x", "y", "w", "h", "dx", "dy")


_MATCH = f"""{X.PAIRS}, dd as (select unnest([-1, 0, 1]) as d),
px as (select a.a_id, a.b_id, a.y // 4 * 4 as y0, a.x // 4 * 4 as x0, dy.d as dy, dx.d as dx, a.va, b.vb from pairs a, dd dy, dd dx, pairs b where b.a_id = a.a_id and b.y = a.y + dy.d and b.x = a.x + dx.d),
sm as (select a_id, b_id, y0, x0, dy, dx, cast(floor((sum(va) + 8) / 16.0) as bigint) as ma, cast(floor((sum(vb) + 8) / 16.0) as bigint) as mb from px group by all having count(*) = 16),
df as (select a_id, b_id, y0, x0, dy, dx, cast(sum(abs(least(255, va + greatest(mb - ma, 0)) - least(255, vb + greatest(ma - mb, 0)))) as bigint) as diff from px join sm using (a_id, b_id, y0, x0, dy, dx) group by all),
hs as (select *, (((((((((y0 + 10007) * 10009) & 4095) + dy) * 10037) & 4095) + x0) * 10039 & 4095) + dx) * 10061 & 4095 as h from df),
bs as (select *, row_number() over (partition by a_id, y0, x0 order by diff * 4096 + h) as nth from hs),
best as (select * from bs where nth = 1),
match as (select b.a_id, b.b_id, b.y0 as y, b.x0 as x, cast(b.dy as int) as dy, cast(b.dx as int) as dx, b.diff, 1 - max((b.diff + 16) / (t.diff + 16)::double * least(0.05::double * ((t.dy - b.dy) * (t.dy - b.dy) + (t.dx - b.dx) * (t.dx - b.dx)), 1)) as weight from best b join hs t on t.a_id = b.a_id and t.y0 = b.y0 and t.x0 = b.x0 group by all)"""


def _blocks(spark, d):
    return M.match_blocks(X.img8_pairs(spark, d), ["a_id", "b_id"], 4, 1)


@query("block_match", f"with {_MATCH} select a_id, b_id, y, x, dy, dx, diff, round(weight, 9) as weight from match".replace("b.diff, 1 - max(", "b.diff, 1 - max("))
def block_match(spark, d):
    return _blocks(spark, d).withColumn("weight", F.round("weight", 9))


_GLOBAL = f"""{_MATCH}, sh as (select a_id, sum(dx * weight) / sum(weight) as shift_x, sum(dy * weight) / sum(weight) as shift_y, avg(weight) as confidence from match group by a_id),
mv as (select m.a_id, weight, x + 2.0::double as sx, y + 2.0::double as sy, x + 2 + dx - shift_x as tx, y + 2 + dy - shift_y as ty from match m join sh using (a_id)),
rr as (select *, sqrt((sx - 3.5) * (sx - 3.5) + (sy - 3.5) * (sy - 3.5)) as ra, sqrt((tx - 3.5) * (tx - 3.5) + (ty - 3.5) * (ty - 3.5)) as rb from mv),
sc as (select a_id, greatest(1 / 1.05::double, least(1.05::double, sum(rb * weight) / sum(ra * weight))) as scale from rr group by a_id),
an as (select a_id, asin(sum(greatest(-sin(0.003), least(sin(0.003), ((sx - 3.5) * (ty * scale - 3.5) - (sy - 3.5) * (tx * scale - 3.5)) / (ra * ra))) * weight * ra) / sum(weight * ra)) as alpha from rr join sc using (a_id) group by a_id)
select a_id, round(shift_x, 6) as shift_x, round(shift_y, 6) as shift_y, round(scale, 6) as scale, round(alpha, 6) + 0 as alpha, round(confidence, 6) as confidence from sh join sc using (a_id) join an using (a_id)"""


def _motion(spark, d):
    return M.global_motion(_blocks(spark, d), ["a_id"], 4, 8, 8)


@query("global_motion", f"with {_GLOBAL}")
def global_motion(spark, d):
    m = _motion(spark, d)
    return m.select("a_id", *(F.round(c, 6).alias(c) for c in ("shift_x", "shift_y", "scale")), (F.round("alpha", 6) + 0).alias("alpha"), F.round("confidence", 6).alias("confidence"))


_STATE = "xs, ys, ss, rs, mx, my, ms, mr, tx, ty, ts, tr, conf"
_STILL = "[]::double[], []::double[], []::double[], []::double[], 0.0::double, 0.0::double, 1.0::double, 0.0::double, 0.0::double, 0.0::double, 1.0::double, 0.0::double, 1.0::double"
_RESET = dict(zip(_STATE.split(", "), _STILL.split(", ")))
_NEXT = {
    "xs": "list_append(xs, x)[-50:]", "ys": "list_append(ys, y)[-50:]", "ss": "list_append(ss, scale)[-50:]", "rs": "list_append(rs, alpha)[-50:]", "mx": "ax", "my": "ay", "ms": "as_", "mr": "ar",
    "tx": "(cos(nr) * tx - sin(nr) * ty) * ns + nx", "ty": "(sin(nr) * tx + cos(nr) * ty) * ns + ny", "ts": "ts * ns", "tr": "tr + nr", "conf": "confidence",
}
_STABLE = f"""with recursive {_GLOBAL[: _GLOBAL.index("select a_id, round(shift_x")]},
mo as (select label as video, a_id as frame, shift_x as x, shift_y as y, scale, alpha, confidence, row_number() over (partition by label order by a_id) as k
 from sh join sc using (a_id) join an using (a_id) join embeddings on vec_id = a_id),
st(video, frame, k, {_STATE}) as (select video, null::bigint, 0::bigint, {_STILL} from mo where k = 1
 union all select video, frame, k, {", ".join(f"case when confidence < 0.1 then {_RESET[c]} else {v} end" for c, v in _NEXT.items())}
 from (select *, x - ax - (mx - ax) as nx, y - ay - (my - ay) as ny, scale / as_ / (ms / as_) as ns, alpha - ar - (mr - ar) as nr
 from (select st.video, mo.frame, mo.k, {_STATE}, x, y, scale, alpha, confidence, coalesce(list_avg(xs[-25:]), 0) as ax, coalesce(list_avg(ys[-25:]), 0) as ay, coalesce(list_avg(rs[-50:]), 0) as ar,
 coalesce(power(2, list_avg(list_transform(ss[-25:], lambda v: log2(greatest(v, 1e-9))))), 1) as as_ from st join mo on mo.video = st.video and mo.k = st.k + 1)))
select cast(video as bigint) as video, frame, round(tx, 4) + 0 as x, round(ty, 4) + 0 as y, round(ts, 5) as scale, round(tr, 5) + 0 as alpha, round(conf, 5) as confidence from st where k > 0"""


@query("stabilize_batch", _STABLE)
def stabilize_batch(spark, d):
    label = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("a_id"), F.col("label").cast("long").alias("video"))
    motions = _motion(spark, d).join(label, "a_id").select("video", F.col("a_id").alias("frame"), F.col("shift_x").alias("x"), F.col("shift_y").alias("y"), "scale", "alpha", "confidence")
    return M.stabilised(motions).select("video", "frame", *((F.round(c, n) + 0).alias(c) for c, n in (("x", 4), ("y", 4), ("scale", 5), ("alpha", 5), ("confidence", 5))))


_ROUNDS = "".join(
    f", f{k} as (select id, sum(weight) as f from s join w{k} using (y, x, bin) group by id), w{k + 1} as (select y, x, bin, any_value(w{k}.weight) + (sum(target) - sum(f)) / count(*) / 64 as weight from s join f{k} using (id) join w{k} using (y, x, bin) group by y, x, bin)"
    for k in (1, 2, 3)
)


@query("ml_train_loop", f"with {_STEP1}{_ROUNDS}, f4 as (select id, sum(weight) as f from s join w4 using (y, x, bin) group by id) select round(avg((f - target) * (f - target)), 9) as mse from f4 join (select distinct id, target from s) using (id)")
def ml_train_loop(spark, d):
    s = samples(spark, d)
    f = L.predict(s, L.train(s, 64, 4))
    return f.join(s.select("id", "target").distinct(), "id").agg(F.round(F.avg((F.col("f") - F.col("target")) ** 2), 9).alias("mse"))


def shape_samples(spark, d):
    """Images with three landmarks: the brightest pixels of their left and right halves, and the middle between them."""
    img = X.img8(spark, d)
    one = img.groupBy("vec_id").agg(F.min(F.when(F.col("x") < 4, F.struct(-F.col("v"), "y", "x"))).alias("hi"), F.min(F.when(F.col("x") >= 4, F.struct(-F.col("v"), "y", "x"))).alias("lo"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("px"))
    ax, ay, bx, by = ((F.col(c) + 0.5) / 8 for c in ("hi.x", "hi.y", "lo.x", "lo.y"))
    data = F.unhex(F.array_join(F.transform("px", lambda p: F.format_string("%02X", p["v"])), ""))
    return one.select(F.col("vec_id").alias("id"), F.lit(8).alias("h"), F.lit(8).alias("w"), data.alias("data"), F.array(*(F.lit(float(v)) for v in (0, 0, 8, 8))).alias("rect"), F.array(ax, ay, bx, by, (ax + bx) / 2, (ay + by) / 2).alias("shape"))


@query("ml_shape_forest")
def ml_shape_forest(spark, d):
    from lumenframe.operators import shape
    from lumenframe.session import cut

    s = cut(shape_samples(spark, d))
    flat = shape.predict(s, shape.train(s, 0, 2, 1)).agg(F.avg("error").alias("before"))
    return shape.predict(s, shape.train(s, 3, 3, 40)).agg(F.avg("error").alias("after")).crossJoin(flat).select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))
