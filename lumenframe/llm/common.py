"""Shared pieces of the training-data operators: byte buffers, word hashes, shared tables.

All text work runs on whole Arrow batches: the texts of a batch lie in one byte
buffer, and word boundaries, hashes and statistics are numpy passes over it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import ship

#: Rows and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of text that one numpy pass takes, unless a single text is longer.
BLOCK_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random 64-bit values of bytes and of places in a word (multilinear hashing).
BYTE_R = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
PLACE_R = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
WORD_R = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: Masks of the first 0 to 8 bytes of a little-endian word.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, as documents may be long, and let the workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths of the tables written in each open scope, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Tables kept within are removed at the end, unless they are kept with out=1 or more: those belong to a scope around, if any."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def kept(df: DataFrame, name: str, out: int = 0) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again. out: of how many scopes the table is to outlive the end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe/{name}-{uuid.uuid4().hex}"
    open_scopes = _SCOPES[: max(len(_SCOPES) - out, 0)]
    if open_scopes:
        open_scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows(docs: DataFrame, **added: Column) -> DataFrame:
    """docs as one column of structs, named row, beside others: joins and aggregates on these can't clash with columns of docs."""
    return docs.select(F.struct(*(own(docs, c).alias(c) for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in added.items()))


def unpacked(made: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows()."""
    return made.select(*(F.col("row").getField(c).alias(c) for c in columns))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""

    def plain(f: T.StructField) -> Column:
        return F.to_json(F.struct(own(docs, f.name).alias("c"))) if "map<" in f.dataType.simpleString() else own(docs, f.name)

    return F.xxhash64(*(plain(f) for f in docs.schema.fields))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own(df: DataFrame, name: str) -> Column:
    """The column of that exact name, also where a name holds dots."""
    return df[f"`{name}`"]


def mapped(df: DataFrame, run, added: str = "") -> DataFrame:
    """df.mapInArrow(run) for a function that returns all columns of df and those added, also where names hold dots."""
    names = df.columns
    plain = df.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)))
    extra = schema(added).fields if added else []
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *extra])).toDF(*names, *(f.name for f in extra))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES):
    """Slices of the batch whose texts in column have about size bytes together; a null counts none."""
    lens = np.nan_to_num(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.cumsum(lens)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets in them; a null is an empty text."""
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        kind = np.int64
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()
    off = np.frombuffer(raw[1], kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_table(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), hash and text number of each word; a word never spans two texts."""
    none = np.zeros(0, np.int64)
    if not len(buf):
        return none, none, none.astype(np.uint64), none
    inside = np.zeros(len(buf) + 1, bool)
    np.take(IS_WORD, buf, out=inside[:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # starts and ends in turn
    if inside[0]:
        turns = np.concatenate([[0], turns])
    edge = off[1:-1]
    edge = np.unique(edge[(edge > 0) & (edge < len(buf))])
    edge = edge[inside[edge] & inside[edge - 1]]  # a word goes on over the end of a text: cut it there
    if len(edge):
        turns = np.sort(np.concatenate([turns, edge, edge]))
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return none, none, none.astype(np.uint64), none
    lens = ends - starts
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eights = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    left = np.minimum(lens, 8)
    hashes = (eights[starts] & KEEP[left]) * WORD_R[0] + lens.astype(np.uint64) * WORD_R[63]
    more, t = np.flatnonzero(lens > 8), 1
    while len(more):
        hashes[more] = mixed(hashes[more]) + (eights[starts[more] + 8 * t] & KEEP[np.minimum(lens[more] - 8 * t, 8)]) * WORD_R[t % 62]
        t += 1
        more = more[lens[more] > 8 * t]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
    return starts, ends, mixed(hashes), doc


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of k words; a text of fewer words gives one run of all its words."""
    n = len(hashes)
    if not n:
        return hashes, doc
    _, first, count = np.unique(doc, return_index=True, return_counts=True)
    total = np.zeros(n, np.uint64)
    for t in range(k):
        total[: n - t] += hashes[t:] * WORD_R[t] if n > t else 0
    ok = np.zeros(n, bool)
    if n >= k:
        ok[: n - k + 1] = doc[: n - k + 1] == doc[k - 1 :]
    out, where = mixed(total[ok]), doc[ok]
    short = np.flatnonzero(count < k)
    if len(short):
        extra = np.array([(hashes[first[i] : first[i] + count[i]] * WORD_R[: count[i]]).sum() for i in short], np.uint64)
        out, where = np.concatenate([out, mixed(extra + np.uint64(1))]), np.concatenate([where, doc[first[short]]])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b, bigints): (id, root), root the least id of the component.

    Alternating large-star and small-star steps (Kiverics et al., "Connected
    Components in MapReduce and Beyond"), each written to the shared folder;
    the number of rounds is logarithmic and nothing is gathered on the driver.
    Least neighbours are partial aggregates, joined back, so that a node with
    very many neighbours is no single task's group.
    """
    least = lambda e: e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
    with scope(edges.sparkSession):
        now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
        seen = None
        while True:
            both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            down = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
            now = kept(least(large).select(down.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), f"{name}-star")
            sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if sign == seen:
                break
            seen = sign
        roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
        return kept(now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots), f"{name}-roots", out=1)
