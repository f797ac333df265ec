"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, components.

A document's elements are its runs of SHINGLE words. SuperMinHash (Ertl, 2017)
gives each element ranks that are correlated over the signature's components:
at level j an element takes the place that step j of its own Fisher-Yates
shuffle names, with the value j plus a random fraction, and a document is
done as soon as the level exceeds the largest value in its signature. Bands of
equal signature parts name candidates, exact Jaccard similarity of the element
sets verifies them, and connected components of verified pairs are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common as C

#: Near copies share 0.4 of their runs of 4 words, counted once each: about what is left when every eighth word is another.
SHINGLE, THRESHOLD = 4, 0.4
#: BANDS * ROWS components: a pair of similarity 0.4 meets in a band with probability 0.92, one of 0.5 with 0.998.
BANDS, ROWS = 96, 4
#: As many distinct ids are sent to all executors at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a large bucket that one task compares with those left apart.
TILE = 4096
#: From this level on an element's whole permutation is held, before it is traced through its swaps.
TRACED = 6

_LEVEL = C._rng.integers(1, 2**64, BANDS * ROWS, dtype=np.uint64)
_BAND = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, BANDS, dtype=np.uint64)


def superminhash(elements: np.ndarray, doc: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n, m): level in the upper and fraction in the lower 32 bits. doc: each element's text number."""
    sign = np.full(n * m, m << 32, np.uint64)
    h, d, swaps, perm = elements, doc, [], None
    for j in range(m):
        x = C.mixed(h + _LEVEL[j])
        k = (j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if j < TRACED:
            place = k
            for i in range(j - 1, -1, -1):
                place = np.where(place == swaps[i], i, place)
            swaps.append(k)
        else:
            every = np.arange(len(h))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int16), (len(h), 1))
                for i, s in enumerate(swaps):
                    old = perm[every, s]
                    perm[every, s] = perm[:, i]
                    perm[:, i] = old
            place = perm[every, k].astype(np.int64)
            perm[every, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(sign, d * m + place, np.uint64(j << 32) | (x >> np.uint64(32)))
        open_docs = np.zeros(n, bool)
        some = np.unique(d)
        open_docs[some] = (sign.reshape(n, m)[some].max(1) >> np.uint64(32)) > j
        go = open_docs[d]
        if not go.any():
            break
        if not go.all():
            h, d = h[go], d[go]
            swaps = [s[go] for s in swaps] if perm is None else swaps
            perm = None if perm is None else perm[go]
    return sign.reshape(n, m)


def distinct(elements: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each element of a text once."""
    order = np.lexsort((elements, doc))
    elements, doc = elements[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (doc[1:] != doc[:-1])
    return elements[new], doc[new]


def band_keys(sign: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys of the signatures' bands."""
    return C.mixed((sign.reshape(len(sign), BANDS, ROWS) * C.WORD_R[:ROWS]).sum(2, dtype=np.uint64) + _BAND)


def _signed(batches):
    for batch in batches:
        for part in C.blocks(batch, "text", 1 << 19):
            buf, off = C.text_buffer(part.column("text"))
            _, _, words, doc = C.word_table(buf, off)
            if not len(words):
                continue
            elements, where = distinct(*C.shingle_hashes(words, doc, SHINGLE))
            has, where = np.unique(where, return_inverse=True)
            keys = band_keys(superminhash(elements, where, len(has)))
            raw = buf.tobytes()
            ids = np.array([xxhash.xxh64_intdigest(raw[off[i] : off[i + 1]], 42) for i in has], np.uint64).view(np.int64)
            offsets = pa.array((np.arange(len(has) + 1) * BANDS).astype(np.int32))
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(has)), pa.array(ids), bands], names=["doc_id", "tid", "bands"])


def _sets(batches):
    for batch in batches:
        for part in C.blocks(batch, "text"):
            buf, off = C.text_buffer(part.column("text"))
            _, _, words, doc = C.word_table(buf, off)
            elements, where = C.shingle_hashes(words, doc, SHINGLE)
            cut = np.searchsorted(where, np.arange(part.num_rows + 1))
            made = [np.unique(elements[cut[i] : cut[i + 1]]).tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("tid"), pa.array(made, pa.binary())], names=["tid", "elements"])


def _alike(threshold: float):
    def run(batches):
        known, a_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, sets_a, sets_b = batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b")
            keep = []
            for i, name in enumerate(a):
                if name != known:
                    known, a_set = name, np.frombuffer(sets_a[i].as_buffer(), np.uint64)
                b_set = np.frombuffer(sets_b[i].as_buffer(), np.uint64)
                small, large = (a_set, b_set) if len(a_set) < len(b_set) else (b_set, a_set)
                if len(small) < threshold * len(large):
                    keep.append(False)
                    continue
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                keep.append(both >= threshold * (len(small) + len(large) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose element sets have at least that Jaccard similarity."""
    with_b = pairs.join(sets.select(F.col("tid").alias("b"), F.col("elements").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("tid").alias("a"), F.col("elements").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_alike(threshold), "a long, b long")


def candidates(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: of each bucket (key, tid) the pairs of texts with different roots, all that are to be told apart still.

    The members outside the bucket's most common root are paired with all
    others, in tiles of TILE members: work grows with the pairs themselves,
    and no task holds a whole bucket.
    """
    placed = members.select("key", "tid").join(roots.select(F.col("id").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("all")).where("roots > 1")
    apart = C.kept(placed.join(mixed.select("key", F.col("most.root").alias("main"), F.ceil(F.col("all") / TILE).alias("tiles")), "key"), "apart")
    p = apart.where("root <> main").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"), F.col("tid").alias("p"), F.col("root").alias("root_p"))
    q = apart.select("key", F.pmod(F.xxhash64("tid"), F.col("tiles")).alias("tile"), F.col("tid").alias("q"), F.col("root").alias("root_q"), (F.col("root") == F.col("main")).alias("in_main"))
    return p.join(q, ["key", "tile"]).where("root_p <> root_q and (in_main or p < q)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def grouped(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid) of every document with words; (tid, root) of each text that has near copies among other texts.

    First each band's members are compared with its most connected member.
    Members that this leaves in different components are then compared with
    each other, so that every candidate pair is either verified, found unlike,
    or already joined by others: the components are those of all candidates.
    What is known of a bucket (its size, its hub, its roots) is a partial
    aggregate, joined back to its members.
    """
    spark = docs.sparkSession
    C.arrow_batches(spark)
    docs = docs.select(C.own(docs, "doc_id").alias("doc_id"), C.own(docs, "text").alias("text")).where("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with C.scope(spark):
        signed = C.kept(docs.mapInArrow(_signed, f"doc_id {kind}, tid long, bands array<long>"), "signatures", out=1)
        rows = signed.select("tid", "bands").dropDuplicates(["tid"]).select("tid", F.explode("bands").alias("key"))
        shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        members = C.kept(rows.join(shared, "key"), "band-members")
        wanted = C.kept(members.groupBy("tid").agg(F.sum(F.col("n") - 1).alias("degree")), "band-texts")
        few = wanted.count() <= BROADCAST_IDS
        some = F.broadcast(wanted.select("tid")) if few else wanted.select("tid")
        full = docs.select(F.xxhash64("text").alias("tid"), "text").join(some, "tid", "left_semi").dropDuplicates(["tid"])
        sets = C.kept(full.mapInArrow(_sets, "tid long, elements binary"), "element-sets")
        ranked = members.select("key", "tid").join(F.broadcast(wanted) if few else wanted, "tid")
        hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "tid")).alias("hub")).select("key", F.col("hub.tid").alias("hub"))
        stars = members.select("key", "tid").join(hubs, "key").where("tid <> hub").select(F.least("tid", "hub").alias("a"), F.greatest("tid", "hub").alias("b")).distinct()
        stars = C.kept(stars, "star-pairs")
        edges = C.kept(verified(stars, sets, threshold), "star-edges")
        rest = candidates(members, C.components(edges, "star")).join(stars, ["a", "b"], "left_anti")
        edges = edges.unionByName(C.kept(verified(rest, sets, threshold), "rest-edges"))
        return signed.select("doc_id", "tid"), C.kept(C.components(edges, "all"), "all-roots", out=1)


def _copies(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, tid, same, group_id, group_size, first): the documents of groups of two rows or more; of each group one is the first."""
    signed, roots = grouped(docs, threshold)
    named = signed.join(roots.select(F.col("id").alias("tid"), "root"), "tid", "left").select("doc_id", "tid", F.coalesce("root", "tid").alias("root"))
    named = named.groupBy("root", "doc_id", "tid").agg(F.count("*").alias("same"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid")
    stats = named.groupBy("root").agg(F.sum("same").alias("group_size"), F.min(place).alias("least")).where("group_size > 1")
    return named.join(stats, "root").select("doc_id", "tid", "same", F.col("least.doc_id").alias("group_id"), "group_size", place.eqNullSafe(F.col("least")).alias("first"))


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tid, group_id, group_size, kept): every document that has exact or near copies.

    Needs doc_id and text. group_id is the least doc_id of the group; kept
    marks the one document that stays, the first by (doc_id, text hash), null
    ids last. Nulls, empty texts and texts without words are never grouped.
    Texts of fewer than SHINGLE words have one element, all their words.
    Repeated rows are copies of each other: one of them is kept. Long texts
    are taken whole; empty docs give no rows; other columns are ignored.
    """
    every = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("same"))).alias("nth")
    made = _copies(docs, threshold).select("*", every)
    return made.select("doc_id", "tid", "group_id", "group_size", (F.col("first") & (F.col("nth") == 1)).alias("kept"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs of each group, and all rows that have no copies; columns as in docs, whatever their names.

    Groups, nulls and short texts are as in groups(). Of the kept document's
    rows, if several share its doc_id and text, the one of the least hash over
    all columns stays. Empty docs give no rows.
    """
    marks = C.kept(_copies(docs, threshold).select(F.col("doc_id").alias("marked_id"), F.col("tid").alias("marked_tid"), "same", "first"), "copies")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks.hint("shuffle_hash")
    packed = C.rows(docs, doc_id=C.own(docs, "doc_id"), tid=F.xxhash64(C.own(docs, "text")), row_hash=C.row_hash(docs))
    marked = packed.join(marks, F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("tid") == F.col("marked_tid")), "left")
    single = marked.where("first is null or (first and same = 1)").select("row")
    repeated = marked.where("first and same > 1").groupBy("doc_id", "tid").agg(F.min_by("row", "row_hash").alias("row")).select("row")
    return C.unpacked(single.unionByName(repeated), docs.columns)


def op8_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that have exact or near copies, by group, and which one stays."""
    return groups(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tid")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; nulls, ties, repeated rows and the like are as in dedup()."""
    return dedup(docs)
