"""Small hand-made cases of the operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import lane, numeric, pcm, text
from lumenframe.operators import image, motion, rect, signal


def picture(spark, rows):
    return spark.createDataFrame([(1, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "id long, y long, x long, v long")


def grid(df, value="v"):
    rows = sorted((r.y, r.x, r[value]) for r in df.collect())
    h = max(r[0] for r in rows) + 1
    return [[v for y, _, v in rows if y == k] for k in range(h)]


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (4, 1), (3, 3), (5, 7)])
def test_integral(spark, shape):
    a = np.random.default_rng(1).integers(0, 256, shape)
    assert grid(image.integral(picture(spark, a.tolist()), "id"), "ii") == a.cumsum(0).cumsum(1).tolist()


def test_turned(spark):
    a = np.arange(6).reshape(2, 3)
    p = picture(spark, a.tolist())
    for how, want in (("90", np.rot90(a, -1)), ("180", np.rot90(a, 2)), ("270", np.rot90(a)), ("flip", a[::-1])):
        assert grid(image.turned(p, how, 2, 3)) == want.tolist()


def test_box_blur(spark):
    a = np.random.default_rng(2).integers(0, 256, (6, 7))

    def line(v, r):
        n = len(v)
        at = lambda i: v[-i] if i < 0 else v[2 * n - 1 - i] if i >= n else v[i]
        return [sum(int(at(i)) for i in range(j - r, j + r + 1)) // (2 * r + 1) for j in range(n)]

    for r in (1, 2):
        rows = [line(v, r) for v in a]
        want = [list(c) for c in zip(*(line(c, r) for c in zip(*rows)))]
        assert grid(image.box_blur(picture(spark, a.tolist()), ["id"], 6, 7, r)) == want


def test_flat_pictures_stay_flat(spark):
    p = picture(spark, [[200] * 8] * 8)
    for made in (image.box_blur(p, ["id"], 8, 8, 1), image.bilateral(p, ["id"], 8, 8, 1.0, 0.1), image.scale_bilinear(p, ["id"], 8, 8, 5, 5), image.block_mean(p, ["id"], 2), image.downscale_average(p, ["id"], 2)):
        assert {r.v for r in made.collect()} == {200}
    assert {r.code for r in image.lbp(p, ["id"]).collect()} == {0}


def test_rectangles(spark):
    rows = [(1, 1, 0, 0, 10, 10, 5), (1, 2, 1, 0, 10, 10, 15), (1, 3, 2, 0, 10, 10, 10), (1, 4, 50, 50, 4, 4, 1), (2, 1, 0, 0, 0, 0, 1), (2, 2, 10, 0, 5, 5, 2)]
    r = spark.createDataFrame(rows, "image_id long, pos long, x long, y long, w long, h long, conf long")
    assert {(c.image_id, c.pos): c.root for c in rect.components(r).collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (2, 1): 1, (2, 2): 2}
    m = {(c.image_id, c.root): (c.x, c.conf, c.n) for c in rect.merged(r).collect()}
    assert m[1, 1] == (pytest.approx(35 / 30), 30, 3)
    assert {(c.image_id, c.pos) for c in rect.without_dominated(r).where("image_id = 1").collect()} == {(1, 2), (1, 1), (1, 3), (1, 4)}
    inner = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 9), (1, 2, 2, 2, 5, 5, 3)], r.schema)
    assert [c.pos for c in rect.without_dominated(inner).collect()] == [1]


def test_greedy_matching(spark):
    names = "image_id long, pos long, x long, y long, w long, h long"
    truth = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 1, 0, 10, 10), (2, 1, 0, 0, 5, 5)], names)
    found = spark.createDataFrame([(1, 1, 1, 0, 10, 10), (1, 2, 30, 0, 10, 10), (3, 1, 0, 0, 5, 5)], names)
    got = {r.image_id: (r.tp, r.fn, r.fp) for r in rect.matched(truth, found, 0.3).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 1, 0), 3: (0, 0, 1)}  # the first truth takes the only match
    m = rect.metrics(rect.matched(truth.limit(0), found.limit(0), 0.3)).first()
    assert m.recall is None and m.precision is None


def test_lanes(spark):
    a = np.arange(-128, 128).astype(np.int8)
    df = spark.createDataFrame([(int(x),) for x in a], "v long")
    got = df.select(lane.wrap(F.col("v") * 3, 8, True).alias("w"), lane.saturate(F.col("v") * 3, 8, True).alias("s"), lane.clz(lane.wrap(F.col("v"), 8, False), 8).alias("z")).collect()
    with np.errstate(over="ignore"):
        assert [r.w for r in got] == (a * np.int8(3)).tolist()
    assert [r.s for r in got] == np.clip(a.astype(int) * 3, -128, 127).tolist()
    assert [r.z for r in got] == [8 - int(x).bit_length() for x in a.astype(np.uint8)]


def test_codes_decode_to_known_values():
    assert pcm.mulaw_table()[0] == -32124 and pcm.mulaw_table()[255] == 0 and pcm.mulaw_table()[128] == 32124
    assert pcm.alaw_table()[0x55] == -8 and pcm.alaw_table()[0xD5] == 8 and pcm.alaw_table()[0xAA] == 32256


def test_csv(spark):
    df = spark.createDataFrame([('a,"b,c",d',), ('"x""y",,',), ("plain",), ('odd"',)], "line string")
    got = df.where(text.balanced_quotes(F.col("line"))).select(text.csv_fields(F.col("line")).alias("f")).collect()
    assert [r.f for r in got] == [["a", "b,c", "d"], ['x""y', "", ""], ["plain"]]


def test_spline_passes_through_its_knots(spark):
    knots = [(0.0, 1.0), (1.0, 3.0), (2.5, -2.0), (4.0, 4.0)]
    df = spark.createDataFrame(knots, "x double, y double")
    for r in df.withColumn("v", numeric.spline_at(numeric.spline(knots), F.col("x"))).collect():
        assert r.v == pytest.approx(r.y)
    with pytest.raises(ValueError, match="three"):
        numeric.spline(knots[:2])


def test_spline_ends(spark):
    """Values of the knots (0, 1), (100, 3), (250, -2), (500, 4), worked out by hand; the last piece goes on to the right."""
    pieces = numeric.spline([(0.0, 1.0), (100.0, 3.0), (250.0, -2.0), (500.0, 4.0)])
    got = [r.v for r in spark.createDataFrame([(x,) for x in (-5.0, 180.0, 400.0)], "x double").select(numeric.spline_at(pieces, F.col("x")).alias("v")).collect()]
    assert got == pytest.approx([1.0, 0.7303, -1.4113], abs=5e-5)
    assert [p[0] for p in pieces] == [0.0, 100.0, 250.0, 500.0] and pieces[1][3] - 3 * pieces[1][4] * 100 == pytest.approx(0)


@pytest.mark.parametrize("period", [2, 4, 8, 16])
def test_dft_of_a_sine(spark, period):
    n = 16
    rows = [(1, 0, i, math.cos(2 * math.pi * i / period)) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, frame long, i int, v double")
    got = {r.k: math.hypot(r.re, r.im) for r in signal.dft(df, ["user_id", "frame"], n).collect()}
    assert got[n // period] == pytest.approx(n if period == 2 else n / 2, abs=1e-9)
    assert sum(got.values()) == pytest.approx(n, abs=1e-6)
    z = signal.fft(df, ["user_id", "frame"]).first()
    assert all(math.hypot(z.re[k], z.im[k]) == pytest.approx(got[k], abs=1e-9) for k in got)


def test_filters(spark):
    df = spark.createDataFrame([(1, n, 1.0) for n in range(400)], "user_id long, n long, v double")
    low = sorted((r.n, r.v) for r in signal.biquad(df, "user_id", 5.0, 50.0).collect())
    high = sorted((r.n, r.v) for r in signal.biquad(df, "user_id", 5.0, 50.0, True).collect())
    assert low[-1][1] == pytest.approx(1) and high[-1][1] == pytest.approx(0, abs=1e-9)


def test_stabiliser_stream_is_the_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(v, f, *rng.normal(0, 2, 2).tolist(), float(1 + rng.normal(0, 0.01)), float(rng.normal(0, 0.001)), 0.05 if f == 7 else 0.9) for v in range(3) for f in range(20)]
    df = spark.createDataFrame(rows, "video long, frame long, x double, y double, scale double, alpha double, confidence double")
    want = {(r.video, r.frame): tuple(r) for r in motion.stabilised(df).collect()}
    from lumenframe.streaming.stabilise import stabilised_stream

    for part in range(4):
        df.where(F.floor(F.col("frame") / 5) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stabilised_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    got = {(r.video, r.frame): tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert want[0, 7][2:] == motion.Stabiliser.STILL


def test_stabiliser_steadies():
    s = motion.Stabiliser()
    out = [s.step((3.0, 0.0, 1.0, 0.0, 1.0)) for _ in range(30)]
    assert out[-1][0] == pytest.approx(out[5][0])  # an even pan is left to move
    assert isinstance(pd.DataFrame(out), pd.DataFrame)


def test_stream_of_numbers_and_search():
    from lumenframe.functions.rand import Stream, minimise

    a, b = Stream(0), Stream(0)
    assert [a.next() for _ in range(5)] == [b.next() for _ in range(5)] and len({Stream(k).next() for k in range(100)}) > 90
    s = Stream(1)
    v = np.array([s.normal() for _ in range(4000)])
    assert abs(v.mean()) < 0.1 and abs(v.std() - 1) < 0.1
    s, t = Stream(3), Stream(3)
    while True:
        u, v = t.uniform(-1, 1), t.uniform(-1, 1)
        if u * u + v * v <= 1:
            break
    k = math.sqrt(-2 * math.log(u * u + v * v) / (u * u + v * v))
    assert [s.normal(), s.normal()] == [v * k, u * k]  # the second coordinate comes first
    x, best = minimise([-10, -10], [10, 10], [5, -7], lambda p: (p[0] - 1.5) ** 2 + (p[1] + 2) ** 2)
    assert best < 1e-9 and x == pytest.approx([1.5, -2], abs=1e-4)


def test_drawing_and_pyramid(spark):
    from lumenframe.operators import lut

    p = picture(spark, [[0] * 5] * 5)
    assert grid(image.draw_line(p, 0, 0, 4, 4, 9)) == [[9 if y == x else 0 for x in range(5)] for y in range(5)]
    assert sum(map(sum, grid(image.draw_cross(p, 2, 2, 1, 1)))) == 5
    model = spark.createDataFrame([(y, x, 7, 0.25) for y in range(2) for x in range(2)], "y long, x long, bin long, weight double")
    hot = picture(spark, [[7 if y < 4 and x < 4 else 0 for x in range(8)] for y in range(8)])
    got = lut.detect_pyramid(hot, "id", model, 8, 8, 2, 2, 0.9, 0.5).collect()
    assert (0.0, 0.0, 4.0, 4.0) in {(r.x, r.y, r.w, r.h) for r in got} and sum(r.w == 2 for r in got) == 9


def test_shape_forest_learns(spark, data):
    from lumenframe.registry import QUERIES

    r = QUERIES["ml_shape_forest"](spark, data).first()
    assert r.after < 0.97 * r.before


def test_piano(spark):
    from lumenframe.operators import piano

    notes = spark.createDataFrame([(1, 1, 0, 400, 49), (1, 2, 100, 300, 52)], "track long, id long, start long, length long, note long")
    dry = {r.n: r.v for r in piano.play(notes, 4000).collect()}
    a, b = piano.voice(49, 400, 4000), piano.voice(52, 300, 4000)
    assert dry[150] == pytest.approx(a[150] + b[50]) and max(dry) == len(a) - 1
    wet = {r.n: r.v for r in piano.echoed(piano.play(notes, 4000), 4000).collect()}
    delays = [int(t * 4000) for t in piano.TAPS]
    y = np.zeros(max(dry) + 1)
    for n in range(len(y)):
        y[n] = dry.get(n, 0) + sum(piano.ECHO * y[n - k] for k in delays if n >= k)
    assert all(wet[n] == pytest.approx(y[n]) for n in wet)
    with pytest.raises(ValueError, match="keys"):
        piano.frequency(0)


def test_frames_at_full_size(spark):
    """Blocks of 32 pixels and shifts up to 16, of a picture that has moved by (5, -9)."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (256, 256))
    b = np.roll(a, (5, -9), (0, 1))
    rows = spark.createDataFrame(pd.DataFrame({"id": 1, "y": np.repeat(np.arange(256), 256), "x": np.tile(np.arange(256), 256), "va": a.ravel(), "vb": b.ravel()}))
    got = {(r.y, r.x): r for r in motion.match_blocks(rows, ["id"], 32, 16).collect()}
    assert len(got) == 64 and all((r.dy, r.dx, r.diff) == (5, -9, 0) and r.weight > 0.9 for r in got.values() if r.y < 224 and r.x >= 32)
    m = motion.global_motion(spark.createDataFrame([r for r in got.values() if r.y < 224 and r.x >= 32]), ["id"], 32, 256, 256).first()
    assert (m.shift_x, m.shift_y) == (pytest.approx(-9), pytest.approx(5))


def test_frames_keep_to_their_size(spark):
    from lumenframe.operators import frames

    a = np.random.default_rng(1).integers(0, 256, (3, 9, 11))
    still = np.zeros(3)
    for nearest in (False, True):
        assert (frames.warped(a, still, still, still + 1, still, nearest) == a).all()
    assert (frames.warped(a, still + 2, still, still + 1, still)[:, :, :9] == a[:, :, 2:]).all()
    assert frames.patterns(a, 3).shape == (3, 9, 5) and (frames.box_blur(a, 0) == a).all()
    with pytest.raises(Exception, match="lacks pixels"):
        image.box_blur(picture(spark, [[1, 2], [3, 4]]).where("y + x < 2"), ["id"], 2, 2, 1).collect()


def test_components_of_many_pairs(monkeypatch):
    """Against labels that spread until nothing changes, with few and with many pairs at a time."""
    rng = np.random.default_rng(2)
    n = 300
    x, y, w, h = rng.integers(0, 40, n), rng.integers(0, 40, n), rng.integers(8, 14, n), rng.integers(8, 14, n)
    end = np.repeat([100, 120, 300], [100, 20, 180])
    want = list(range(n))
    before = None
    while want != before:
        before = list(want)
        for i in range(n):
            for j in range(i + 1, end[i]):
                over = max(min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j]), 0) * max(min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j]), 0)
                lo, hi = sorted((w[i] * h[i], w[j] * h[j]))
                if hi < 4 * lo and over * 10 > lo * 8:
                    want[i] = want[j] = min(want[i], want[j])
    for pairs in (1, 50, 1 << 22):
        monkeypatch.setattr(rect, "_PAIRS", pairs)
        assert rect._roots(x, y, w, h, end).tolist() == want


def test_detector_end_to_end(spark):
    from lumenframe.operators import lut

    model = spark.createDataFrame([(y, x, 7, 0.25) for y in range(4) for x in range(4)], "y long, x long, bin long, weight double")
    hot = picture(spark, [[7 if 2 <= y < 6 and 9 <= x < 13 else 0 for x in range(16)] for y in range(16)])
    got = [(r.x, r.y, r.w, r.h) for r in lut.detect(hot, "id", model, 16, 16, 4, 4, 15.9, 0.5).collect()]
    assert got == [(9.0, 2.0, 4.0, 4.0)]


def test_negatives_keep_away(spark):
    from lumenframe.operators import lut

    truth = spark.createDataFrame([(1, 1, 0, 0, 60, 60)], "image_id long, pos long, x long, y long, w long, h long")
    images = spark.createDataFrame([(1, 64, 64), (2, 200, 100), (3, 24, 24)], "image_id long, height long, width long")
    got = lut.negatives(images, truth, F.lit(7), 24, 24, 200).collect()
    assert {r.image_id for r in got} == {1, 2} and all(sorted(r.nth for r in got if r.image_id == i) == [*range(1, 8)] for i in (1, 2))
    for r in got:
        side = (64, 64) if r.image_id == 1 else (200, 100)
        assert 0 <= r.y and r.y + r.h <= side[0] and 0 <= r.x and r.x + r.w <= side[1]
        if r.image_id == 1:
            both = max(0, min(60, r.x + r.w) - r.x) * max(0, min(60, r.y + r.h) - r.y)
            assert both / (3600 + r.w * r.h - both) < 0.5


@pytest.mark.parametrize("tries", [20, 62, 130])
def test_negatives_against_each_pair(spark, tries):
    """The first free tries of each image by plain loops; one image has most of the rectangles, one none, one no id and one a negative id."""
    from lumenframe.operators import lut

    rng = np.random.default_rng(tries)
    ids = [3, -8, 1000004, *[5] * 300]
    cut = lambda a, m: int(math.fmod(a, m))
    truth = [(i, *map(int, rng.integers(0, 60, 2)), *map(int, rng.integers(11, 70, 2))) for i in ids] + [(3, 0, 0, None, 30), (None, 1, 1, 50, 50)]
    images = [(i, 100, 120, n) for i, n in ((3, 4), (-8, 200), (1000004, 0), (5, 9), (6, 2), (None, 2))]
    want = []
    for i, high, wide, wanted in images:
        nth = 0
        for t in range(tries):
            if i is None:
                y = x = s = None
            else:
                draw = [cut((cut(i, 1000003) * 7919 + t * 104729 + k * 15485863) * 69069 + 12345, 1000003) for k in (1, 2, 3)]
                s = math.floor(24 * (1 + (99 / 24 - 1) * (draw[0] / 1000003)))
                y, x = cut(draw[1], high - s), cut(draw[2], wide - s)
            hit = False
            for j, a, b, w, h in truth:
                if i is not None and j == i and w is not None:
                    over = max(0, min(a + w, x + s) - max(a, x)) * max(0, min(b + h, y + s) - max(b, y))
                    hit = hit or over / (w * h + s * s - over) >= 0.5
            if not hit and nth < wanted:
                nth += 1
                want.append((i, nth, x, y, s, s))
    got = lut.negatives(spark.createDataFrame(images, "image_id long, height long, width long, n long"), spark.createDataFrame(truth, "image_id long, x long, y long, w long, h long"), F.col("n"), 24, 24, tries)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_negatives_move_no_tries(spark, data):
    """One shuffle, of a row for each image and task; no tries are sorted."""
    import __spark_entry__ as entry

    plan = entry.queries()["det_negatives"](spark, data)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert plan.count("Exchange ") == 1 and not any(x in plan for x in ("Window", "Sort", "Join")) and plan.index("partial_bit_or") > plan.index("Exchange ")


def test_piano_by_whole_tracks(spark):
    """The same as voices one by one, added up and echoed, also of a track of over a million samples, of one without a sample and of one without a name."""
    from lumenframe.operators import piano

    rng = np.random.default_rng(3)
    notes = [(int(t), i, int(rng.integers(0, 3000)), int(rng.integers(1, 400)), int(rng.integers(1, 89))) for t in range(7) for i in range(9)]
    notes += [(9, 1, 1_300_000, 50, 40), (9, 2, 0, 50, 40), (9, 2, 0, 50, 40), (10, 1, 5, -900, 3), (None, 1, 0, 10, 88)]
    rows = spark.createDataFrame(notes, "track long, id long, start long, length long, note long")
    got = {k: g.sort_values("n") for k, g in piano.performed(rows, 4000).toPandas().groupby("track", dropna=False)}
    dry = {}
    for t, _, start, length, note in notes:
        v = piano.voice(note, length, 4000)
        if len(v):
            old = dry.get(t, np.zeros(0))
            dry[t] = np.zeros(max(len(old), start + len(v)))
            dry[t][: len(old)] += old
            dry[t][start : start + len(v)] += v
    assert len(got) == len(dry) and 10 not in got
    for t, y in dry.items():
        if t != 9:
            for n in range(len(y)):
                y[n] += sum(piano.ECHO * y[n - k] for k in (int(x * 4000) for x in piano.TAPS) if n >= k)
        else:
            piano._echo(y, 4000)  # noqa: SLF001
        mine = next(g for k, g in got.items() if k == t or (t is None and k != k))
        assert mine["n"].tolist() == list(range(len(y))) and np.allclose(mine["v"], y, rtol=0, atol=1e-9)
    for bad in ((1, 1, -1, 10, 5), (1, 1, 0, 10, 89), (1, 1, 0, None, 5)):
        with pytest.raises(Exception, match="starts at 0|keys are|a start, a length"):
            piano.performed(spark.createDataFrame([bad], rows.schema), 4000).collect()


def test_piano_moves_no_samples(spark, data):
    """Events are shuffled once, and no samples."""
    import __spark_entry__ as entry

    plan = entry.queries()["sig_piano"](spark, data)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert plan.count("Exchange ") == 1 and plan.index("MapInArrow") < plan.index("Exchange ") and "InPandas" not in plan
