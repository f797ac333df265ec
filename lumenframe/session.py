"""What operators need of their session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the session's spark.checkpoint.dir; in local mode a folder of our own serves where it is unset."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: send it to the executors once, unless the session's workers find it by PYTHONPATH or in the working directory."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    found = root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))) or (sc.master.startswith("local[") and os.getcwd() == root)
    if found or sc.applicationId in _SHIPPED or not os.path.isdir(root):
        return
    folder = os.path.join(SparkFiles.getRootDirectory(), "own")
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, "lumenframe.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(os.path.join(root, "lumenframe")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), root))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)
