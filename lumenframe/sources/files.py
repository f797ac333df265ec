"""DataFrames from media and manifest files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import text
from lumenframe.session import cut
from lumenframe.sources import pictures, wav

IMAGE = "path string, height int, width int, channels int, data binary, error string"
AUDIO = "path string, container string, format int, channels int, rate int, bits int, frames long, samples array<smallint>, error string"


def csv_lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(fields): the fields of each line with balanced quotes."""
    return spark.read.text(path).where(text.balanced_quotes(F.col("value"))).select(text.csv_fields(F.col("value"), delimiter).alias("fields"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """BMP, PPM and PGM files as byte blobs; a file that can't be read has an error instead."""

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    v = pictures.decode(p, c)
                    rows.append((p, *v.shape[:2], v.shape[2] if v.ndim == 3 else 1, v.tobytes(), None))
                except (pictures.PictureError, ValueError) as e:
                    rows.append((p, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["path", "height", "width", "channels", "data", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, IMAGE)


def jpegs(spark: SparkSession, path: str) -> DataFrame:
    """JPEG (and other) files by Spark's image source; its bytes are in BGR order and are turned to RGB."""
    raw = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")

    def run(batches):
        for b in batches:
            made = [np.frombuffer(d, np.uint8).reshape(-1, c)[:, ::-1].tobytes() if c == 3 else d for d, c in zip(b.column("data").to_pylist(), b.column("channels").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("origin", "height", "width", "channels")), pa.array(made, pa.binary())], names=["path", "height", "width", "channels", "data"])

    return raw.mapInArrow(run, "path string, height int, width int, channels int, data binary")


def pixels(blobs: DataFrame) -> DataFrame:
    """(path, y, x, c, v): blobs as one row for each value."""
    values = F.posexplode(F.transform(F.sequence(F.lit(0), F.length("data") - 1), lambda i: F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10).cast("int")))
    long = blobs.where("data is not null").select("path", "width", "channels", values.alias("i", "v"))
    row = F.col("width") * F.col("channels")
    return long.select("path", F.floor(F.col("i") / row).alias("y"), F.floor(F.col("i") % row / F.col("channels")).alias("x"), (F.col("i") % F.col("channels")).alias("c"), "v")


def audio(spark: SparkSession, path: str) -> DataFrame:
    """WAV and W64 files as 16-bit samples, frame by frame; a file that can't be read has an error instead."""

    def run(batches):
        names = ["path", "container", "format", "channels", "rate", "bits", "frames", "samples", "error"]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int16()), pa.string())
        for b in batches:
            rows = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    h, v = wav.samples(c)
                    rows.append((p, *(h[k] for k in names[1:7]), v.reshape(-1).tolist(), None))
                except ValueError as e:
                    rows.append((p, *[None] * 7, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, AUDIO)


_BOX = "struct<left:double,top:double,width:double,height:double,landmarks:array<struct<x:double,y:double>>>"


def json_manifest(spark: SparkSession, path: str, root: str = "", sample: int = 1, from_landmarks: bool = False, scale: float = 1.0) -> DataFrame:
    """(path, objects): every sample-th .jpg of a JSON manifest {images: [{filename, boxes: [...]}]}.

    from_landmarks: boxes are made anew of five points of the 68 of a face: the
    nose, the middles of both eyes, and the corners of the mouth. A box without
    them all is an error.
    """
    raw = spark.read.schema(f"images array<struct<filename:string,boxes:array<{_BOX}>>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("images").alias("i", "m")).where((F.col("i") % sample == 0) & (text.extension(F.col("m.filename")) == ".jpg"))
    boxes = F.col("m.boxes")
    if from_landmarks:
        point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

        def face(box: Column) -> Column:
            at = lambda k: F.element_at(box["landmarks"], k + 1)
            middle = lambda j, k: point((at(j)["x"] + at(k)["x"]) / 2, (at(j)["y"] + at(k)["y"]) / 2)
            five = F.array(point(at(30)["x"], at(30)["y"]), middle(36, 39), middle(42, 45), *(point(at(k)["x"], at(k)["y"]) for k in (48, 54)))
            r = landmark_rect(five, scale)
            sides = (r[c].cast("double").alias(n) for c, n in zip("yxwh", ("top", "left", "width", "height")))
            top, left, width, height = sides
            return F.when(F.size(box["landmarks"]) > 54, F.struct(left, top, width, height, box["landmarks"].alias("landmarks"))).otherwise(F.raise_error(F.lit("a box lacks landmarks")))

        boxes = F.transform(boxes, face)
    return rows.select(F.concat(F.lit(root), F.col("m.filename")).alias("path"), boxes.alias("objects"))


def landmark_rect(landmarks: Column, scale: float = 1.0) -> Column:
    """The square around landmarks: their centre, and the largest distance from it, times a scale, rounded half up."""
    n = F.size(landmarks)
    total = lambda c: F.aggregate(landmarks, F.lit(0.0), lambda s, p: s + p[c])
    cx, cy = total("x") / n, total("y") / n
    r = F.lit(scale) * F.array_max(F.transform(landmarks, lambda p: F.sqrt((p["x"] - cx) * (p["x"] - cx) + (p["y"] - cy) * (p["y"] - cy))))
    whole = lambda v: (v + 0.5).cast("bigint")
    return F.struct(whole(cx - r).alias("x"), whole(cy - r).alias("y"), whole(2 * r).alias("w"), whole(2 * r).alias("h"))


def csv_manifest(spark: SparkSession, path: str, root: str = "", sample: int = 1) -> DataFrame:
    """(path, objects): a CSV of one header row and 11 columns (name, five landmarks), grouped by path; of the paths in order every sample-th."""
    cols = ", ".join(["name string", *(f"{a}{i} double" for i in range(1, 6) for a in "xy")])
    rows = spark.read.schema(cols).option("header", True).option("mode", "FAILFAST").csv(path)
    marks = F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(1, 6)))
    rows = rows.select(F.concat(F.lit(root), F.col("name"), F.lit(".jpg")).alias("path"), marks.alias("landmarks")).withColumn("rect", landmark_rect(F.col("landmarks")))
    grouped = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("rect", "landmarks"))).alias("objects"))
    if sample == 1:
        return grouped
    return grouped.join(every_nth(grouped.select("path"), "path", sample), "path", "left_semi")


def every_nth(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Every n-th row in the order of a column, from the first on: numbered in ranges, whose sizes are added up first."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, column).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    nth = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    numbered = ranged.withColumn("nth", nth).join(sizes.select("part", before.alias("before")), "part")
    return numbered.where((F.col("nth") + F.col("before")) % n == 0).select(*rows.columns)


def frames(spark: SparkSession, folder: str, extension: str, stream: bool = False) -> DataFrame:
    """(frame, path, content): numbered files such as 007.bmp, at once or as a stream."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile")
    raw = reader.option("pathGlobFilter", f"*{extension}").load(folder)
    return raw.select(F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("bigint").alias("frame"), "path", "content")


def dump_images(blobs: DataFrame, folder: str, title: str) -> int:
    """Debug sink: write each blob as NN-title-row.bmp from the executors; the number of files. The folder, a path or a URI, must be shared."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        from lumenframe.sources.pictures import write_bmp

        task, n = TaskContext.get().partitionId(), 0
        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            for h, w, c, d in zip(*(b.column(k).to_pylist() for k in ("height", "width", "channels", "data"))):
                v = np.frombuffer(d, np.uint8).reshape((h, w, c) if c == 3 else (h, w))
                with files.open_output_stream(f"{base}/{task:02d}-{title}-{n}.bmp") as f:
                    f.write(write_bmp(v))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return blobs.where("data is not null").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
