"""Motion between frames: block matching, global motion, and its smoothing over a video."""

from __future__ import annotations

from collections import deque
from math import cos, log2, sin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import frames

MAX_SCALE, MAX_ANGLE = 1.05, 0.003


def match_blocks(pairs: DataFrame, keys: list[str], size: int, reach: int) -> DataFrame:
    """(keys, y, x, dy, dx, diff, weight): for each block of frame a its best place in frame b.

    pairs: (keys, y, x, va, vb). Blocks are compared by absolute differences
    after their mean brightness is made equal; ties are broken by a fixed hash
    of the place. The weight falls with how well far shifts do, too. Shifts
    that leave the frame are not tried.
    """
    rows = frames.gathered(pairs, keys, ("va", "vb"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def run(batches):
        for b in batches:
            sizes = np.column_stack([b.column(c).to_numpy() for c in ("h", "w")])
            for h, w in np.unique(sizes, axis=0).tolist():
                some = b.take(pa.array(np.flatnonzero((sizes == (h, w)).all(1))))
                made = frames.matched_blocks(*(some.column(c).flatten().to_numpy().reshape(-1, h, w) for c in ("va", "vb")), size, reach)
                n, down, across = made["dy"].shape
                each = pa.array(np.repeat(np.arange(n), down * across))
                y, x = np.tile(np.repeat(np.arange(down) * size, across), n), np.tile(np.arange(across) * size, n * down)
                out = [y, x, made["dy"].astype(np.int32), made["dx"].astype(np.int32), made["diff"], made["weight"]]
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(each) for k in keys), *(pa.array(v.reshape(-1)) for v in out)], names=[*keys, "y", "x", "dy", "dx", "diff", "weight"])

    return rows.mapInArrow(run, f"{head}, y long, x long, dy int, dx int, diff long, weight double")


def without_ignored(blocks: DataFrame, ignored: DataFrame, size: int) -> DataFrame:
    """Weight 0 for blocks whose centre lies in an ignored rectangle (x, y, w, h) of all frames; a short list."""
    cy, cx = F.col("y") + size / 2, F.col("x") + size / 2
    hit = F.exists("ignored", lambda r: (cx >= r["x"]) & (cx < r["x"] + r["w"]) & (cy >= r["y"]) & (cy < r["y"] + r["h"]))
    every = ignored.agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("ignored"))
    return blocks.crossJoin(every).withColumn("weight", F.when(hit, 0.0).otherwise(F.col("weight"))).drop("ignored")


def global_motion(blocks: DataFrame, keys: list[str], size: int, h: int, w: int) -> DataFrame:
    """(keys, shift_x, shift_y, scale, alpha, confidence): weighted mean shift, then scale, then angle about the centre.

    Without any weight the scale is 0 and nothing moves.
    """
    cx, cy = (w - 1) / 2, (h - 1) / 2
    b = blocks.select(*keys, (F.col("x") + size / 2).alias("sx"), (F.col("y") + size / 2).alias("sy"), "dx", "dy", "weight")
    shift = b.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("dx") * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias("shift_x"), F.coalesce(F.try_divide(F.sum(F.col("dy") * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias("shift_y"), F.avg("weight").alias("confidence"))
    moved = b.join(shift, keys).withColumns({"tx": F.col("sx") + F.col("dx") - F.col("shift_x"), "ty": F.col("sy") + F.col("dy") - F.col("shift_y")})
    far = lambda x, y: F.sqrt((F.col(x) - cx) * (F.col(x) - cx) + (F.col(y) - cy) * (F.col(y) - cy))
    moved = moved.withColumns({"ra": far("sx", "sy"), "rb": far("tx", "ty")})
    on = F.col("ra") >= 1e-6
    ratio = F.try_divide(F.sum(F.when(on, F.col("rb") * F.col("weight"))), F.sum(F.when(on, F.col("ra") * F.col("weight"))))
    scale = moved.groupBy(*keys).agg(F.coalesce(F.greatest(F.lit(1 / MAX_SCALE), F.least(F.lit(MAX_SCALE), ratio)), F.lit(0.0)).alias("scale"))
    turned = moved.join(scale, keys)
    ax, ay = F.col("sx") - cx, F.col("sy") - cy
    bx, by = F.col("tx") * F.col("scale") - cx, F.col("ty") * F.col("scale") - cy
    most = sin(MAX_ANGLE)
    s = F.greatest(F.lit(-most), F.least(F.lit(most), (ax * by - ay * bx) / (F.col("ra") * F.col("ra"))))
    k = F.col("weight") * F.col("ra")
    angle = turned.groupBy(*keys).agg(F.coalesce(F.asin(F.try_divide(F.sum(F.when(on, s * k)), F.sum(F.when(on, k)))), F.lit(0.0)).alias("alpha"))
    return shift.join(scale, keys).join(angle, keys).select(*keys, "shift_x", "shift_y", "scale", "alpha", "confidence")


def combine(a: tuple, b: tuple) -> tuple:
    """First motion a, then b: (x, y, scale, alpha, confidence)."""
    c, s = cos(b[3]), sin(b[3])
    return (c * a[0] - s * a[1]) * b[2] + b[0], (s * a[0] + c * a[1]) * b[2] + b[1], a[2] * b[2], a[3] + b[3], min(a[4], b[4])


def coverage(motions: DataFrame, h: int, w: int) -> DataFrame:
    """Adds x_min, x_max, y_min, y_max and fill of the moved frame's corners about its centre: how far it reaches (0 at least), and the scale that would cover it all (1 at least)."""
    c, s = F.cos("alpha") * F.col("scale"), F.sin("alpha") * F.col("scale")
    corners = [(c * x - s * y + F.col("shift_x"), s * x + c * y + F.col("shift_y")) for x in (-w / 2, w / 2) for y in (-h / 2, h / 2)]
    xs, ys = zip(*corners)
    fill = F.greatest(F.lit(1.0), *(F.abs(x) / (w / 2) for x in xs), *(F.abs(y) / (h / 2) for y in ys))
    ends = {"x_min": F.least(F.lit(0.0), *xs), "x_max": F.greatest(F.lit(0.0), *xs), "y_min": F.least(F.lit(0.0), *ys), "y_max": F.greatest(F.lit(0.0), *ys), "fill": fill}
    return motions.withColumns(ends)


class Stabiliser:
    """One video's state: the last motions, what they came to, and their last mean.

    A frame whose motion has too little confidence is a cut: the state starts anew.
    """

    STILL = (0.0, 0.0, 1.0, 0.0, 1.0)
    LENGTHS = (25, 25, 25, 50)  # of shift x and y, scale, and angle

    def __init__(self, least: float = 0.1, state: dict | None = None):
        self.least = least
        s = state or {}
        self.last, self.total, self.mean = deque(map(tuple, s.get("last", []))), tuple(s.get("total", self.STILL)), tuple(s.get("mean", self.STILL))

    def state(self) -> dict:
        return {"last": [list(m) for m in self.last], "total": list(self.total), "mean": list(self.mean)}

    def average(self) -> tuple:
        """Mean of the last motions, each part over its own number of them; the scale's is geometric."""
        if not self.last:
            return self.STILL
        take = lambda i: [m[i] for m in list(self.last)[-self.LENGTHS[i] :]]
        mean = lambda v: sum(v) / len(v)
        return mean(take(0)), mean(take(1)), 2 ** mean([log2(max(v, 1e-9)) for v in take(2)]), mean(take(3)), 1.0

    def step(self, m: tuple) -> tuple:
        if m[4] < self.least:
            self.last.clear()
            self.total = self.mean = self.STILL
            return self.STILL
        avg = self.average()
        err = (self.mean[0] - avg[0], self.mean[1] - avg[1], self.mean[2] / avg[2], self.mean[3] - avg[3])
        self.mean = avg
        self.last.append(tuple(m))
        while len(self.last) > max(self.LENGTHS):
            self.last.popleft()
        now = (m[0] - avg[0] - err[0], m[1] - avg[1] - err[1], m[2] / avg[2] / err[2], m[3] - avg[3] - err[3], m[4])
        self.total = (*combine(self.total, now)[:4], now[4])
        return self.total


_OUT = "video long, frame long, x double, y double, scale double, alpha double, confidence double"


def stabilised(motions: DataFrame, least: float = 0.1) -> DataFrame:
    """(video, frame, x, y, scale, alpha, confidence): the correction of each frame. motions: the same columns, of each frame against the last."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        s = Stabiliser(least)
        rows = [s.step(tuple(r)) for r in pdf[["x", "y", "scale", "alpha", "confidence"]].itertuples(index=False)]
        out = pd.DataFrame(rows, columns=["x", "y", "scale", "alpha", "confidence"])
        out.insert(0, "frame", pdf["frame"].to_numpy())
        out.insert(0, "video", pdf["video"].to_numpy())
        return out

    return motions.groupBy("video").applyInPandas(run, _OUT)
