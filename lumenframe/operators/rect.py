"""Rectangles: overlap joins, grouping, merging, and detection metrics.

A rectangle is x, y, w, h, half open. Joins are within an image, which is the
equi-join key; the predicates prune the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(a: str, b: str) -> Column:
    """Area of the intersection of two rectangles, named by prefix; touching or apart: 0."""
    w = F.least(F.col(f"{a}x") + F.col(f"{a}w"), F.col(f"{b}x") + F.col(f"{b}w")) - F.greatest(f"{a}x", f"{b}x")
    h = F.least(F.col(f"{a}y") + F.col(f"{a}h"), F.col(f"{b}y") + F.col(f"{b}h")) - F.greatest(f"{a}y", f"{b}y")
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(a: str) -> Column:
    return F.col(f"{a}w") * F.col(f"{a}h")


def iou(a: str, b: str) -> Column:
    """Intersection over union; null for two empty rectangles."""
    i = overlap(a, b)
    return F.try_divide(i.cast("double"), (area(a) + area(b) - i).cast("double"))


def contains(a: str, px: Column, py: Column) -> Column:
    """Whether a point lies in a rectangle, half open."""
    return (px >= F.col(f"{a}x")) & (px < F.col(f"{a}x") + F.col(f"{a}w")) & (py >= F.col(f"{a}y")) & (py < F.col(f"{a}y") + F.col(f"{a}h"))


def prefixed(rects: DataFrame, p: str) -> DataFrame:
    return rects.select("image_id", *(F.col(c).alias(f"{p}{c}") for c in rects.columns if c != "image_id"))


def pairs(rects: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """All pairs of an image's rectangles (a before b), or of its rectangles and another table's."""
    a, b = prefixed(rects, "a_"), prefixed(rects if other is None else other, "b_")
    joined = a.join(b, "image_id")
    return joined.where("a_pos < b_pos") if other is None else joined


def alike(a: str = "a_", b: str = "b_") -> Column:
    """The relation of rectangles that merge: areas within a factor of 4, and an overlap above 0.8 of the smaller."""
    lo, hi = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    return (hi < lo * 4) & (overlap(a, b) * 10 > lo * 8)


#: Pairs of rectangles that are compared at once.
_PAIRS = 1 << 22


def _roots(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first rectangle of each one's component under alike(). end: where each one's image ends."""
    n, area_ = len(x), w * h
    root, at = np.arange(n), 0
    left = end - np.arange(n) - 1
    upto = np.cumsum(left)
    links = []
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
        k = left[at:to]
        a = np.repeat(np.arange(at, to), k)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        over = np.maximum(np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b]), 0) * np.maximum(np.minimum(y[a] + h[a], y[b] + h[b]) - np.maximum(y[a], y[b]), 0)
        lo, hi = np.minimum(area_[a], area_[b]), np.maximum(area_[a], area_[b])
        fine = (hi < lo * 4) & (over * 10 > lo * 8)
        links.append(np.stack([a[fine], b[fine]]))
        at = to
    a, b = np.concatenate(links, 1) if links else np.zeros((2, 0), np.int64)
    while len(a):
        old = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == old).all():
            break
    return root


def rooted(rects: DataFrame) -> DataFrame:
    """rects with root: the least pos of each rectangle's component under alike().

    One shuffle by image gathers its rectangles; components never leave an
    image, and are found there by spreading least labels in numpy. Of a very
    large image only so many pairs are held at a time.
    """
    names = [c for c in rects.columns if c not in ("image_id", "pos")]
    rows = rects.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("rows")).select("image_id", *(F.col("rows")[c].alias(c) for c in ("pos", *names)))
    kinds = {f.name: f.dataType.simpleString() for f in rects.schema.fields}

    def run(batches):
        for b in batches:
            lists = {c: b.column(c).flatten() for c in ("pos", *names)}
            size = b.column("pos").value_lengths().to_numpy()
            end = np.repeat(np.cumsum(size), size)
            root = _roots(*(lists[c].to_numpy() for c in "xywh"), end)
            image = b.column("image_id").take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([image, *lists.values(), lists["pos"].take(pa.array(root))], names=["image_id", *lists, "root"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("image_id", "pos", *names)) + f", root {kinds['pos']}")


def components(rects: DataFrame) -> DataFrame:
    """(image_id, pos, root): each rectangle with the least pos of its component under alike()."""
    return rooted(rects.select("image_id", "pos", "x", "y", "w", "h")).select("image_id", "pos", "root")


def merged(rects: DataFrame) -> DataFrame:
    """One rectangle for each component: the mean of its rectangles weighted by confidence, and their summed confidence."""
    both = rooted(rects.select("image_id", "pos", "x", "y", "w", "h", "conf"))
    mean = lambda c: (F.sum(F.col(c) * F.col("conf")) / F.sum("conf")).alias(c)
    return both.groupBy("image_id", "root").agg(*(mean(c) for c in "xywh"), F.sum("conf").alias("conf"), F.count("*").alias("n"))


def cleaned(rects: DataFrame) -> DataFrame:
    """Detections (image_id, x, y, w, h, conf) merged by component, without weak and dominated ones."""
    order = Window.partitionBy("image_id").orderBy(F.col("conf").desc(), "x", "y", "w", "h")
    named = merged(rects.withColumn("pos", F.row_number().over(order).cast("bigint"))).withColumnRenamed("root", "pos").drop("n")
    return without_dominated(confident(named).drop("rank"))


def scaled_around_centre(a: str, k: float) -> dict[str, Column]:
    """A rectangle, named by prefix, scaled about its centre."""
    x, y, w, h = (F.col(f"{a}{c}") for c in "xywh")
    return {"x": x + w / 2 - w * (k / 2), "y": y + h / 2 - h * (k / 2), "w": w * k, "h": h * k}


def confident(rects: DataFrame, factor: int = 10) -> DataFrame:
    """Rectangles whose confidence is at least a factor-th of their image's largest, the most confident first."""
    over = Window.partitionBy("image_id")
    order = over.orderBy(F.col("conf").desc(), "pos")
    return rects.withColumns({"top": F.max("conf").over(over), "rank": F.row_number().over(order)}).where(F.col("conf") * factor >= F.col("top")).drop("top")


def without_dominated(rects: DataFrame) -> DataFrame:
    """Drop rectangles that a kept and more confident one of the image holds: both shrunk to 0.8, or in its middle half.

    Dropping depends on what was kept before, so that each image is one group.
    """

    names = rects.columns
    part = lambda r, dx, dy, w, h: (r["x"] + dx * r["w"], r["y"] + dy * r["h"], w * r["w"], h * r["h"])

    def inside(p: tuple, q: tuple) -> Column:
        return (p[0] >= q[0]) & (p[1] >= q[1]) & (p[0] + p[2] <= q[0] + q[2]) & (p[1] + p[3] <= q[1] + q[3])

    def held(r: Column, k: Column) -> Column:
        small = part(r, 0.1, 0.1, 0.8, 0.8)
        return inside(small, part(k, 0.1, 0.1, 0.8, 0.8)) | inside(small, part(k, 0.25, 0.0, 0.5, 1.0))

    row = F.struct((-F.col("conf")).alias("order"), "pos", *(F.col(c) for c in names if c != "pos"))
    rows = rects.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.slice("rows", 1, 0)
    kept = F.aggregate("rows", none, lambda kept, r: F.when(F.exists(kept, lambda k: held(r, k)), kept).otherwise(F.concat(kept, F.array(r))))
    return rows.select(F.explode(kept).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in names))


def matched(truth: DataFrame, found: DataFrame, min_iou: float) -> DataFrame:
    """(image_id, tp, fn, fp): each truth in order takes the free detection of the largest IoU above min_iou, the first of equals.

    The overlap join makes the candidates; only those go through the greedy
    step, one group for each image.
    """
    t, f = prefixed(truth, "a_"), prefixed(found, "b_")
    cand = t.join(f, "image_id").withColumn("iou", iou("a_", "b_")).where(F.col("iou") > min_iou).select("image_id", "a_pos", "b_pos", "iou")

    row = F.struct("a_pos", (-F.col("iou")).alias("worse"), "b_pos")
    rows = cand.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.struct(F.array().cast("array<long>").alias("a"), F.array().cast("array<long>").alias("b"))
    both = lambda s, r: F.struct(F.concat(s["a"], F.array(r["a_pos"])).alias("a"), F.concat(s["b"], F.array(r["b_pos"])).alias("b"))
    used = lambda s, r: F.array_contains(s["a"], r["a_pos"]) | F.array_contains(s["b"], r["b_pos"])
    done = F.aggregate("rows", empty, lambda s, r: F.when(used(s, r), s).otherwise(both(s, r)))
    hits = rows.select("image_id", F.size(done["a"]).cast("bigint").alias("tp"))
    counts = truth.groupBy("image_id").agg(F.count("*").alias("truths")).join(found.groupBy("image_id").agg(F.count("*").alias("found")), "image_id", "full").na.fill(0, ["truths", "found"])
    return counts.join(hits, "image_id", "left").na.fill(0, ["tp"]).select("image_id", "tp", (F.col("truths") - F.col("tp")).alias("fn"), (F.col("found") - F.col("tp")).alias("fp"))


def metrics(counts: DataFrame) -> DataFrame:
    """Summed counts with recall and precision; null where nothing is counted."""
    s = counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp")))
    return s.withColumns({"recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), "precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))})
