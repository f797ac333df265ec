"""Codecs and file sources."""

from __future__ import annotations

import json
import math
import random
import struct

import numpy as np
import pytest

from lumenframe.sources import archive, files, jpeg, pictures, ulz, wav


@pytest.mark.parametrize("container", ["riff", "w64"])
@pytest.mark.parametrize(("bits", "form"), [(8, wav.PCM), (16, wav.PCM), (24, wav.PCM), (32, wav.PCM), (32, wav.IEEE), (64, wav.IEEE)])
def test_wav_round_trip(container, bits, form):
    top = 1 << (bits - 1)
    v = np.array([[-top, top - 1], [0, 1], [-1, top // 2]]) if form == wav.PCM else np.array([[-1.0, 1.0], [0.0, 0.25], [-0.5, 0.75]])
    data = wav.write(v, 8000, bits, form, container)
    assert len(data) == wav.size_of(3, 2, bits, container)
    h, got = wav.samples(data)
    assert (h["rate"], h["channels"], h["frames"], h["container"]) == (8000, 2, 3, container)
    want = (v << (16 - bits) if bits < 16 else v >> (bits - 16)) if form == wav.PCM else np.trunc(v * 32767)
    assert got.tolist() == want.astype(int).tolist()


def test_wav_errors():
    for bad in (b"", b"RIFF", wav.write(np.zeros((1, 1), int), 1)[:30]):
        with pytest.raises(ValueError):
            wav.samples(bad)


def test_ima_adpcm_follows_a_ramp():
    block = struct.pack("<hBB", 100, 0, 0) + bytes([0x77] * 8)
    head = struct.pack("<HHIIHHHH", wav.ADPCM_IMA, 1, 8000, 4000, len(block), 4, 2, 17)
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(block)) + block
    _, v = wav.samples(data)
    assert v[0, 0] == 100 and len(v) == 17 and (np.diff(v[:, 0].astype(int)) >= 0).all() and v[-1, 0] == 32767


@pytest.mark.parametrize("shape", [(1, 1, 3), (3, 5, 3), (4, 4, 3), (2, 7)])
def test_pictures(shape):
    v = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    rgb = np.repeat(v[:, :, None], 3, 2) if v.ndim == 2 else v
    assert (pictures.read_bmp(pictures.write_bmp(v)) == rgb).all()
    assert (pictures.read_pnm(pictures.write_pnm(v)) == v).all()
    assert (pictures.from_raw(pictures.to_raw(rgb, "bgra"), *shape[:2], "bgra") == rgb).all()


def test_exif():
    def jpeg(order, value):
        e = "<" if order == b"II" else ">"
        tiff = order + struct.pack(e + "HIH", 42, 8, 1) + struct.pack(e + "HHIHH", 0x112, 3, 1, value, 0)
        return b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xd9"

    assert [pictures.exif_orientation(jpeg(o, v)) for o in (b"II", b"MM") for v in (1, 6, 9)] == [1, 6, None, 1, 6, None]
    assert pictures.exif_orientation(b"\xff\xd8\xff\xda") == 0 and pictures.exif_orientation(b"no") is None


def test_ulz_round_trip():
    rng = random.Random(0)
    for data in (b"", b"a", b"abcabcabcabcabc" * 50, bytes(rng.randrange(256) for _ in range(3000)), b"x" * 70_000 + b"yz" * 9 + b"x" * 70_000):
        packed = ulz.compress(data)
        assert ulz.decompress(packed) == data
    assert len(ulz.compress(b"abc" * 10_000)) < 100
    for bad in (b"", b"ULZ?", ulz.MAGIC + struct.pack("<I", 2) + b"\x00\x01"):
        with pytest.raises(ulz.UlzError):
            ulz.decompress(bad)


def test_files(spark, tmp_path):
    v = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.bmp").write_bytes(pictures.write_bmp(v))
    (tmp_path / "img/b.ppm").write_bytes(pictures.write_pnm(v))
    (tmp_path / "img/c.txt").write_bytes(b"no")
    got = files.images(spark, f"{tmp_path}/img/*")
    assert sorted((r.error is None, r.data == v.tobytes() if r.data else None) for r in got.collect()) == [(False, None), (True, True), (True, True)]
    long = files.pixels(got.where("path like '%a.bmp'")).collect()
    assert {(r.y, r.x, r.c): r.v for r in long} == {k: int(x) for k, x in np.ndenumerate(v)}
    assert bytes(files.jpegs(spark, f"{tmp_path}/img/a.bmp").first().data) == v.tobytes()
    (tmp_path / "a.wav").write_bytes(wav.write(np.array([[1], [-2]]), 8000))
    (r,) = files.audio(spark, f"{tmp_path}/a.wav").collect()
    assert r.samples == [1, -2] and r.rate == 8000
    (tmp_path / "m.json").write_text(json.dumps({"images": [{"filename": f"{i}.{e}", "boxes": [{"left": 1, "top": 2, "width": 3, "height": 4, "landmarks": [{"x": 1, "y": 2}]}]} for i, e in enumerate(["jpg", "JPG", "png"])]}))
    assert sorted(r.path for r in files.json_manifest(spark, f"{tmp_path}/m.json", "root/").collect()) == ["root/0.jpg", "root/1.JPG"]
    (tmp_path / "m.csv").write_text("n,a,b,c,d,e,f,g,h,i,j\np,0,0,2,0,0,2,2,2,1,1\np,0,0,4,0,0,4,4,4,2,2\nq,0,0,2,0,0,2,2,2,1,1\n")
    m = {r.path: r.objects for r in files.csv_manifest(spark, f"{tmp_path}/m.csv").collect()}
    assert len(m["p.jpg"]) == 2 and tuple(m["q.jpg"][0].rect) == (0, 0, 3, 3)
    (tmp_path / "l.csv").write_text('a,"b,c"\nodd"\n')
    assert [r.fields for r in files.csv_lines(spark, f"{tmp_path}/l.csv").collect()] == [["a", "b,c"]]


@pytest.mark.parametrize("shape", [(1, 1, 3), (16, 24, 3), (13, 21, 3), (17, 9)])
def test_jpeg_is_read_by_another_decoder(spark, tmp_path, shape):
    y, x = np.mgrid[: shape[0], : shape[1]]
    v = np.stack([(y * 9 + 40) % 256, (x * 7 + 30) % 256, (x + y) * 4 % 256], 2).astype(np.uint8)
    v = v if len(shape) == 3 else v[:, :, 0]
    for quality, most in ((100, 3), (75, 16)):
        (tmp_path / "p.jpg").write_bytes(jpeg.encode(v, quality))
        r = files.jpegs(spark, f"{tmp_path}/p.jpg").first()
        got = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
        want = v if v.ndim == 3 else np.repeat(v[:, :, None], got.shape[2], 2)
        assert got.shape[:2] == v.shape[:2] and np.abs(got.astype(int) - want).mean() < most
    assert jpeg.encode(v, 50, flip=True) == jpeg.encode(v[::-1], 50)


def test_archive():
    import pandas as pd

    m = pd.DataFrame({"y": [0, 1], "x": [1, 0], "bin": [3, 2], "weight": [0.5, -2.0]})
    data = archive.dump(m, 2, 2, 4)
    got = archive.load(data)
    assert len(data) == 12 + 64 and len(got) == 16
    assert got[got.weight != 0].reset_index(drop=True).equals(m.astype({"y": "int64", "x": "int64", "bin": "int64"}))


def test_frames_and_dump(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for k in (3, 11):
        (tmp_path / f"in/{k:03d}.bmp").write_bytes(pictures.write_bmp(np.full((2, 2, 3), k, np.uint8)))
    got = files.frames(spark, f"{tmp_path}/in", ".bmp").orderBy("frame").collect()
    assert [(r.frame, pictures.read_bmp(r.content)[0, 0, 0]) for r in got] == [(3, 3), (11, 11)]
    q = files.frames(spark, f"{tmp_path}/in", ".bmp", True).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("frames").count() == 2
    assert files.dump_images(files.images(spark, f"{tmp_path}/in"), f"{tmp_path}/out", "t") == 2 == len(list((tmp_path / "out").iterdir()))


def test_boxes_from_landmarks(spark, tmp_path):
    marks = [{"x": 0, "y": 0}] * 68
    for k, (x, y) in {30: (50, 50), 36: (35, 40), 39: (45, 40), 42: (55, 40), 45: (65, 40), 48: (42, 60), 54: (58, 60)}.items():
        marks[k] = {"x": x, "y": y}
    box = {"left": 1, "top": 2, "width": 3, "height": 4, "landmarks": marks}
    (tmp_path / "m.json").write_text(json.dumps({"images": [{"filename": "a.JPG", "boxes": [box]}, {"filename": "b.png", "boxes": []}]}))
    (plain,) = files.json_manifest(spark, str(tmp_path / "m.json")).collect()
    assert (plain.objects[0].left, plain.objects[0].height) == (1.0, 4.0)
    (r,) = files.json_manifest(spark, str(tmp_path / "m.json"), from_landmarks=True, scale=1.5).collect()
    cy, side = 50.0, math.hypot(10, 10) * 1.5
    o = r.objects[0]
    assert (o.left, o.top, o.width, o.height) == (int(50 - side + 0.5), int(cy - side + 0.5), int(2 * side + 0.5), int(2 * side + 0.5)) and len(o.landmarks) == 68
    bad = {"images": [{"filename": "a.jpg", "boxes": [{**box, "landmarks": marks[:50]}]}]}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="lacks landmarks"):
        files.json_manifest(spark, str(tmp_path / "bad.json"), from_landmarks=True).collect()


def test_every_nth_in_order(spark):
    names = [f"p{i * 7919 % 1000:04d}" for i in range(200)]
    got = files.every_nth(spark.createDataFrame([(n,) for n in names], "path string").repartition(5), "path", 7).collect()
    assert sorted(r.path for r in got) == sorted(names)[::7]
