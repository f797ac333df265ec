"""Additive look-up-table regression on byte features, and detection with it.

A model is a table (y, x, bin, weight): one weight for each cell and byte. It
has at most 256 rows a cell, whatever the number of samples, and joins by
(y, x, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut

CELL = ["y", "x", "bin"]


def histogram(samples: DataFrame) -> DataFrame:
    """(y, x, bin, n, sum): counts and summed targets. samples: (id, y, x, bin, target)."""
    return samples.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("target").alias("sum"))


def predict(samples: DataFrame, model: DataFrame) -> DataFrame:
    """(id, f): summed weights; bytes that the model hasn't seen add 0."""
    return samples.join(model, CELL, "left").groupBy("id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("f"))


def step(samples: DataFrame, model: DataFrame, area: int) -> DataFrame:
    """One round of averaged backfitting: each weight moves by its mean residual over the number of cells."""
    f = predict(samples, model)
    moved = samples.join(f, "id").groupBy(*CELL).agg(((F.sum("target") - F.sum("f")) / F.count("*") / area).alias("d"))
    return moved.join(model, CELL, "left").select(*CELL, (F.coalesce("weight", F.lit(0.0)) + F.col("d")).alias("weight"))


def train(samples: DataFrame, area: int, rounds: int, every: int = 2) -> DataFrame:
    """The model after some rounds; its lineage is cut now and then."""
    if rounds > 2:
        samples = cut(samples)  # each round reads them twice
    model = samples.select(*CELL).distinct().withColumn("weight", F.lit(0.0))
    for k in range(rounds):
        model = step(samples, model, area)
        if k % every == every - 1:
            model = cut(model)
    return model


def predict_windows(img: DataFrame, key: str, model: DataFrame, h: int, w: int, step_y: int = 1) -> DataFrame:
    """(key, wy, wx, f): the model at every window of its size that lies in the image.

    Each pixel meets the model's cells of its byte, and adds to the windows
    that this places.
    """
    cells = model.select(F.col("y").alias("i"), F.col("x").alias("j"), F.col("bin").alias("v"), "weight")
    at = img.join(cells, "v").select(key, (F.col("y") - F.col("i")).alias("wy"), (F.col("x") - F.col("j")).alias("wx"), "weight")
    inside = F.col("wy").between(0, h) & F.col("wx").between(0, w) & (F.col("wy") % step_y == 0)
    return at.where(inside).groupBy(key, "wy", "wx").agg(F.sum("weight").alias("f"))


def detections(windows: DataFrame, key: str, threshold: float, h: int, w: int, scale: float = 1.0) -> DataFrame:
    """Windows whose squared value is above a threshold, as rectangles of the unscaled image."""
    conf = F.col("f") * F.col("f")
    return windows.where(conf > threshold).select(
        F.col(key).alias("image_id"), (F.col("wx") / scale).alias("x"), (F.col("wy") / scale).alias("y"), F.lit(w / scale).alias("w"), F.lit(h / scale).alias("h"), (conf / (scale * scale)).alias("conf")
    )


def jittered(rects: DataFrame, k: int, width: Column, height: Column) -> DataFrame:
    """(2 k + 1)^2 moved copies of each rectangle, those that lie wholly in the image."""
    d = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    moved = rects.select("*", d.alias("dy")).select("*", d.alias("dx")).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    return moved.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= width) & (F.col("y") + F.col("h") <= height))


def detect_pyramid(img: DataFrame, key: str, model: DataFrame, h0: int, w0: int, h: int, w: int, threshold: float, step: float, start: float = 1.0) -> DataFrame:
    """(image_id, x, y, w, h, conf): windows of the image and of its smaller scales, in the image's own size.

    The scales go down by a factor as long as the model fits; their number is
    logarithmic in the image's size, and all of them are one plan.
    """
    from lumenframe.operators.image import scale_hq

    out, scale = None, start
    while int(h0 * scale) >= h and int(w0 * scale) >= w:
        sh, sw = int(h0 * scale), int(w0 * scale)
        small = img if (sh, sw) == (h0, w0) else scale_hq(img, [key], h0, w0, sh, sw)
        found = detections(predict_windows(small, key, model, sh - h, sw - w), key, threshold, h, w, scale)
        out = found if out is None else out.unionByName(found)
        scale *= step
    if out is None:
        raise ValueError("the model is larger than the image")
    return out


def detect(img: DataFrame, key: str, model: DataFrame, h0: int, w0: int, h: int, w: int, threshold: float, step: float, start: float = 1.0) -> DataFrame:
    """(image_id, pos, x, y, w, h, conf): the detections of all scales, merged, without weak and dominated ones."""
    from lumenframe.operators.rect import cleaned

    return cleaned(detect_pyramid(img, key, model, h0, w0, h, w, threshold, step, start))


#: Tries whose hits go in one number.
_BITS = 62


def _windows(images: DataFrame, h: int, w: int) -> DataFrame:
    """b_y, b_x, b_h, b_w of each image (image_id, height, width, ...) and try: from a fixed stream of both."""
    draw = lambda k: ((F.col("image_id") % 1000003 * 7919 + F.col("try") * 104729 + k * 15485863) * 69069 + 12345) % 1000003
    most = F.least((F.col("height") - 1) / h, (F.col("width") - 1) / w)
    sized = images.withColumn("scale", 1 + (most - 1) * (draw(1) / 1000003.0)).withColumns({"b_h": F.floor(h * F.col("scale")), "b_w": F.floor(w * F.col("scale"))})
    return sized.withColumns({"b_y": draw(2) % (F.col("height") - F.col("b_h")), "b_x": draw(3) % (F.col("width") - F.col("b_w"))})


def negatives(images: DataFrame, truth: DataFrame, wanted: Column, h: int, w: int, tries: int) -> DataFrame:
    """(image_id, nth, x, y, w, h): random windows of an image that overlap each true rectangle by an IoU under 0.5, the first `wanted` of so many tries.

    images: (image_id, height, width), each once, of which those larger than
    h x w by two or more give samples, and columns for wanted. The windows have
    the model's shape, 1 to as many times its size as fit, and come from a fixed
    stream of each image and try, so that a lost task gives the same ones again.
    """
    t = truth.select(F.col("image_id").alias("a_image"), *(F.col(c).alias(f"a_{c}") for c in "xywh"))
    each = images.select("image_id", "height", "width", wanted.alias("wanted"))
    return negatives_beside(each.join(t, F.col("image_id") == F.col("a_image"), "left"), F.max("wanted"), h, w, tries)


def negatives_beside(truth: DataFrame, wanted: Column, h: int, w: int, tries: int) -> DataFrame:
    """negatives() of rows (image_id, height, width, a_x, a_y, a_w, a_h) that have each true rectangle with its image's size; an image without one has a row of nulls.

    wanted aggregates an image's rows, each of which is there with every `try`
    from 0 on. A rectangle's hits are bits, of which an image has the union: the
    tries themselves are neither shuffled nor sorted, and an image with very
    many rectangles is no more than one row from each task.
    """
    from lumenframe.operators.rect import iou

    size, words = ["image_id", "height", "width"], range(-(-tries // _BITS))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tries - 1).cast("bigint"))).alias("try")
    word, bit = F.floor(F.col("try") / _BITS), F.expr(f"shiftleft(1L, cast(try % {_BITS} as int))")
    fits = truth.where((F.col("height") - 1 > h) & (F.col("width") - 1 > w))
    tried = _windows(fits.select("*", numbers), h, w)
    hits = [F.bit_or(F.when((word == i) & (iou("a_", "b_") >= 0.5), bit).otherwise(0)).alias(f"hit{i}") for i in words]
    each = tried.groupBy(*size).agg(wanted.alias("wanted"), *hits).select("*", numbers)
    hit, before = F.lit(False), F.lit(0)
    for i in words:
        own = F.col(f"hit{i}")
        hit = hit | ((word == i) & (own.bitwiseAND(bit) != 0))
        before = before + F.bit_count(F.when(word > i, own).when(word == i, own.bitwiseAND(bit - 1)).otherwise(0))
    free = each.where(~hit).withColumn("nth", (F.col("try") + 1 - before).cast("int")).where("nth <= wanted")
    return _windows(free, h, w).select("image_id", "nth", *(F.col(f"b_{c}").alias(c) for c in "xywh"))


def best_split(samples: DataFrame, key: str) -> DataFrame:
    """(key, n, threshold, score): where the samples (key, id, feature, target) of each key are cut in two, those of the larger features first.

    The score is the sum over both sides of the squared target sum over the
    number of samples, which is largest where the spread within the sides is
    least. Equal features stay together; of equal scores the first counts.
    """
    from pyspark.sql.window import Window

    each = samples.groupBy(key, "feature").agg(F.count("*").alias("c"), F.sum("target").alias("t"))
    order = Window.partitionBy(key).orderBy(F.col("feature").desc())
    over = Window.partitionBy(key)
    sums = each.select(key, "feature", F.sum("c").over(order).alias("n"), F.sum("t").over(order).alias("s"), F.sum("c").over(over).alias("all_n"), F.sum("t").over(over).alias("all_s"))
    rest = F.col("all_s") - F.col("s")
    scored = sums.where("n < all_n").select(key, "n", F.col("feature").alias("threshold"), F.round(F.col("s") * F.col("s") / F.col("n") + rest * rest / (F.col("all_n") - F.col("n")), 6).alias("score"))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("worse"), "n", "threshold")).alias("b"))
    return best.select(key, F.col("b.n").alias("n"), F.col("b.threshold").alias("threshold"), (-F.col("b.worse")).alias("score"))


def repacked(samples: DataFrame) -> DataFrame:
    """(y, x, column): of each cell the bytes of all samples (id, y, x, v) in order of id."""
    return samples.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("s")).select("y", "x", F.transform("s", lambda r: r["v"]).alias("column"))


def with_images(samples: DataFrame, images: DataFrame) -> DataFrame:
    """Samples (image_id, ...) with their images' columns; a sample whose image isn't there is an error to be seen, so that it stays with nulls."""
    return samples.join(images, "image_id", "left")
