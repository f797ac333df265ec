"""Whole images as arrays: one shuffle gathers an image's pixels, and numpy works on stacks of equally large images.

For operators whose windows or searches would multiply pixel rows. An image
is one row, so that images spread over the cluster; it must be complete.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stack = np.ndarray  # images, rows, columns


def gathered(img: DataFrame, keys: list[str], values: tuple[str, ...] = ("v",), **with_: Column) -> DataFrame:
    """(keys, h, w, values): each image's size, its values in order of (y, x), and aggregates with_."""
    pixels = F.array_sort(F.collect_list(F.struct("y", "x", *values)))
    size = [(F.max(c) + 1).cast("int").alias(n) for c, n in (("y", "h"), ("x", "w"))]
    rows = img.groupBy(*keys).agg(*size, pixels.alias("pixels"), *(v.alias(k) for k, v in with_.items()))
    return rows.select(*keys, "h", "w", *(F.col("pixels")[c].alias(c) for c in values), *with_)


def mapped(rows: DataFrame, keys: list[str], run: Callable[..., np.ndarray], out: str, values: tuple[str, ...] = ("v",), more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, out): run(stacks of values..., columns more...) gives a stack for all images of one size in a batch."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    kind = "double" if out.endswith("_f") else "long"

    def each(batches):
        for b in batches:
            sizes = np.column_stack([b.column(c).to_numpy() for c in ("h", "w")])
            for h, w in np.unique(sizes, axis=0).tolist():
                at = pa.array(np.flatnonzero((sizes == (h, w)).all(1)))
                some = b.take(at)
                flat = [some.column(v).flatten().to_numpy() for v in values]
                if any(len(v) != h * w * len(at) for v in flat):
                    raise ValueError("an image lacks pixels, or has some twice")
                made = run(*(v.reshape(-1, h, w) for v in flat), *(some.column(c).to_numpy() for c in more))
                n, h2, w2 = made.shape
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (h2 * w2))
                values_ = pa.array(np.ascontiguousarray(made).reshape(-1).astype(float if kind == "double" else np.int64))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keys), pa.array(np.full(n, w2, np.int32)), pa.ListArray.from_arrays(offsets, values_)], names=[*keys, "lf_w", "lf_v"])

    made = rows.mapInArrow(each, f"{head}, lf_w int, lf_v array<{kind}>")
    pixel = made.select(*keys, "lf_w", F.posexplode("lf_v").alias("lf_at", out))
    return pixel.select(*keys, F.floor(F.col("lf_at") / F.col("lf_w")).alias("y"), (F.col("lf_at") % F.col("lf_w")).cast("long").alias("x"), out)


def _blurred(a: Stack, r: int) -> Stack:
    """Along the last axis: mirrored on the left without the edge pixel, on the right with it."""
    n = a.shape[-1]
    if n < r + 1:
        raise ValueError("the image is smaller than the window")
    wide = np.concatenate([a[..., r:0:-1], a, a[..., : n - r - 1 : -1][..., :r]], -1)
    sums = np.cumsum(np.concatenate([np.zeros((*a.shape[:-1], 1), a.dtype), wide], -1), -1)
    return (sums[..., 2 * r + 1 :] - sums[..., : -2 * r - 1]) // (2 * r + 1)


def box_blur(a: Stack, r: int) -> Stack:
    """Box blur along rows, then along columns, rounded down after each."""
    if not r:
        return a
    return _blurred(_blurred(a, r).swapaxes(1, 2), r).swapaxes(1, 2)


def bilateral(a: Stack, sd: float, sr: float) -> Stack:
    """A flat window of radius sqrt(3) sd, cut at the upper and lower border and repeating the outer columns; range weights fall linearly to 0 at sqrt(6) * 255 * sr."""
    r, top = int(3**0.5 * sd), int(sr * 6**0.5 * 255)
    h = a.shape[1]
    wide = np.pad(a, ((0, 0), (0, 0), (r, r)), mode="edge")
    s, k = np.zeros_like(a), np.zeros_like(a)
    for dy in range(-r, r + 1):
        to, of = slice(max(0, -dy), h - max(0, dy)), slice(max(0, dy), h - max(0, -dy))
        for dx in range(2 * r + 1):
            near = wide[:, of, dx : dx + a.shape[2]]
            weight = np.maximum(0, top - np.abs(near - a[:, to]) * 254)
            s[:, to] += near * weight
            k[:, to] += weight
    return (s + k // 2) // k


ORDER = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def patterns(a: Stack, n: int, mask: int = 0xF8) -> Stack:
    """Local binary patterns of radii 1 to n of the inner pixels: n rows, one for each radius, for each row of the image."""
    m = a & mask
    h, w = a.shape[1] - 2 * n, a.shape[2] - 2 * n
    at = lambda dy, dx: m[:, n + dy : n + dy + h, n + dx : n + dx + w]
    rows = [sum((at(k * dy, k * dx) > at(0, 0)).astype(np.int64) << (7 - i) for i, (dy, dx) in enumerate(ORDER)) for k in range(1, n + 1)]
    return np.stack(rows, 2).reshape(len(a), h * n, w)


def warped(a: Stack, sx: np.ndarray, sy: np.ndarray, scale: np.ndarray, alpha: np.ndarray, nearest: bool = False) -> Stack:
    """Each image at the places where its motion takes the pixels, turned and scaled about the centre, clamped to the edge: bilinear, cut to whole numbers, or the nearest pixel."""
    n, h, w = a.shape
    sn, cs = (np.sin(alpha) * scale)[:, None, None], (np.cos(alpha) * scale)[:, None, None]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    y, x = np.mgrid[:h, :w].astype(float)
    ty, tx = sn * (x - cx) + cs * (y - cy) + cy + sy[:, None, None], cs * (x - cx) - sn * (y - cy) + cx + sx[:, None, None]
    each = np.arange(n)[:, None, None]
    if nearest:
        return a[each, np.clip((ty + 0.5).astype(np.int64), 0, h - 1), np.clip((tx + 0.5).astype(np.int64), 0, w - 1)]
    ty, tx = np.clip(ty, 0, h - 1), np.clip(tx, 0, w - 1)
    i, j = ty.astype(np.int64), tx.astype(np.int64)
    di, dj = ty - i, tx - j
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    upper, lower = a[each, i, j] * (1 - dj) + a[each, i, j1] * dj, a[each, i1, j] * (1 - dj) + a[each, i1, j1] * dj
    return np.floor(upper * (1 - di) + lower * di + 1e-9).astype(np.int64)


def matched_blocks(a: Stack, b: Stack, size: int, reach: int) -> dict[str, np.ndarray]:
    """For each whole block of a its best place in b: arrays (images, blocks down, blocks across) of dy, dx, diff and weight.

    Blocks are compared by absolute differences after their mean brightness is
    made equal; ties are broken by a fixed hash of the place. The weight falls
    with how well far shifts do, too. Shifts that leave the frame aren't tried.
    """
    n, h, w = a.shape
    down, across, area = h // size, w // size, size * size
    a = a[:, : down * size, : across * size]
    blocks = lambda v: v.reshape(len(v), down, size, across, size).swapaxes(2, 3)
    own = blocks(a)
    mean_a = (own.sum((3, 4)) + area // 2) // area
    wide = np.pad(b, ((0, 0), (reach, reach), (reach, reach)))
    y, x = np.arange(down)[:, None] * size, np.arange(across)[None, :] * size
    tried = []
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            other = blocks(wide[:, reach + dy : reach + dy + down * size, reach + dx : reach + dx + across * size])
            mean_b = (other.sum((3, 4)) + area // 2) // area
            lift = (mean_b - mean_a)[..., None, None]
            diff = np.abs(np.minimum(own + np.maximum(lift, 0), 255) - np.minimum(other + np.maximum(-lift, 0), 255)).sum((3, 4))
            inside = (y + dy >= 0) & (y + dy + size <= h) & (x + dx >= 0) & (x + dx + size <= w)
            mixed = ((((((y + 10007) * 10009 & 4095) + dy) * 10037 & 4095) + x) * 10039 & 4095) + dx
            tried.append((dy, dx, np.where(inside, diff, -1), np.where(inside, diff * 4096 + (mixed * 10061 & 4095), np.iinfo(np.int64).max)))
    order = np.stack([t[3] for t in tried])
    best = order.argmin(0)
    dys, dxs = (np.array([t[k] for t in tried])[best] for k in (0, 1))
    diffs = np.stack([t[2] for t in tried])
    least = np.take_along_axis(diffs, best[None], 0)[0]
    rival = np.zeros((n, down, across))
    for (dy, dx, *_), diff in zip(tried, diffs):
        apart = (dy - dys) ** 2 + (dx - dxs) ** 2
        rival = np.where(diff >= 0, np.maximum(rival, (least + area) / (diff + area) * np.minimum(0.05 * apart, 1.0)), rival)
    return {"dy": dys, "dx": dxs, "diff": least, "weight": 1 - rival}
