"""Line dedup: segment-partition edit join over all lines of the corpus.

Two lines are near copies if so many byte edits turn one into the other as
allowed() has for the shorter one. Lengths fall into buckets; in each bucket a
line has one segment more than edits, all disjoint and of one length, the
first ones placed from its start and the last ones from its end. If two lines
are near copies, some segment i of the shorter lies unchanged in the other
line, moved by at most min(i, edits - i) bytes from the same anchor (the
multi-match-aware selection of pass-join), so that probing these few
substrings of every line in the bucket's segment index finds every pair.
Pairs are then pruned by a signature of byte parities, which no edit changes
in more than two bits, and verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common as C

#: Edits (bytes) of lines of MIN_BYTES to 4 * STEP_BYTES - 1 bytes; one more for each fourfold length.
EDITS, STEP_BYTES = 2, 48
#: Shorter lines (bytes) have no near copies, only exact ones: an edit may make another line of them.
MIN_BYTES = 24
#: In keys with more entries than this the pairs are looked up by signature parts, too.
DENSE = 32
#: As many distinct ids are sent to all executors at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_BIT = np.zeros(256, np.uint64)
for _b in range(256):
    _at = _b - 97 if 97 <= _b <= 122 else _b - 65 + 26 if 65 <= _b <= 90 else 52 + (_b * 7 + (_b >> 3)) % 12
    _BIT[_b] = np.uint64(1) << np.uint64(_at * 5 % 64)  # 5 and 64 are coprime: neighbours spread out


def allowed(size: int, edits: int = EDITS) -> int:
    """Edits of near copies of a line of so many bytes, the shorter of the two."""
    return 0 if size < MIN_BYTES else edits + max(0, (size // STEP_BYTES).bit_length() - 1) // 2


def bucket_starts(longest: int) -> list[int]:
    """Least lengths of the buckets up to longest; all lines of a bucket may have equally many edits."""
    out = [MIN_BYTES]
    while out[-1] <= longest:
        to, turn = max(out[-1] + 8, out[-1] * 23 // 20), 4 * STEP_BYTES
        while turn <= out[-1]:
            turn *= 4
        out.append(turn if out[-1] < turn < to + 8 else to)
    return out


def _line_rows(edits: int, least: int):
    x = lambda b: xxhash.xxh64_intdigest(b, 42)  # noqa: E731  equals Spark's xxhash64
    y = lambda b, s: xxhash.xxh3_64_intdigest(b, s)

    def keys(line: bytes, n: int, k: int, base: int) -> tuple[list[int], list[int]]:
        """Index and probe keys of a line in bucket k, whose lines have base bytes at least; their last four bits are the edits."""
        e = allowed(base, edits)
        g = base // (e + 1)
        index, probes = [], []
        for i in range(e + 1):
            at, reach = (i * g, i) if i <= e // 2 else (n - (e - i + 1) * g, e - i)
            seed = k * 64 + i
            for shift in range(-reach, reach + 1):
                if 0 <= at + shift <= n - g:
                    (probes if shift else index).append(y(line[at + shift : at + shift + g], seed) & ~15 | e)
        return index, probes

    def run(batches):
        bounds = bucket_starts(1 << 16)
        for batch in batches:
            for part in C.blocks(batch, "text", 1 << 20):
                part = part.filter(pa.compute.is_valid(part.column("text")))
                buf, off = C.text_buffer(part.column("text"))
                cut = np.flatnonzero(buf == 10)
                # line starts and ends over all texts
                starts = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
                ends = np.sort(np.concatenate([off[1:], cut]), kind="stable")
                doc = np.searchsorted(cut, off[:-1]) + np.arange(len(off) - 1)  # number of each text's first line
                owner = np.repeat(np.arange(len(off) - 1), np.diff(np.append(doc, len(starts))))
                number = np.arange(len(starts)) - doc[owner]
                size = ends - starts
                long = np.flatnonzero(size >= least)
                if not len(long):
                    continue
                flat = np.sort(np.concatenate([starts[long], np.minimum(ends[long], len(buf) - 1)]))
                marks = np.unique(flat)
                signs = np.bitwise_xor.reduceat(_BIT[buf], marks)[np.searchsorted(marks, starts[long])]
                tail = ends[long] == len(buf)  # the last byte has its own mark there
                if tail.any():
                    signs[tail] ^= np.where(starts[long][tail] < len(buf) - 1, _BIT[buf[-1]], np.uint64(0))
                raw = buf.tobytes()
                tids = [x(raw[a:b]) for a, b in zip(off[:-1], off[1:])]
                while bounds[-1] <= size.max() + 16:
                    bounds = bucket_starts(2 * bounds[-1])
                at_bucket = np.searchsorted(bounds, size[long], "right") - 1
                # each distinct line once: its number, ids and keys
                known: dict[bytes, int] = {}
                which, n_index, n_probes = np.empty(len(long), np.int64), np.zeros(len(long), np.int32), np.zeros(len(long), np.int32)
                ids, ids2, indexed, probed = [], [], [], []
                for i, at in enumerate(long):
                    s, e = int(starts[at]), int(ends[at])
                    line, n, k = raw[s:e], e - s, int(at_bucket[i])
                    which[i] = known.setdefault(line, len(ids))
                    if which[i] < len(ids):
                        continue
                    ids.append(x(line))
                    ids2.append(y(line, 7))
                    if k < 0:  # no near copies
                        continue
                    index, probes = keys(line, n, k, bounds[k])
                    if k and n < bounds[k] + allowed(bounds[k - 1], edits):
                        a, b = keys(line, n, k - 1, bounds[k - 1])
                        probes += a + b
                    indexed += index
                    probed += probes
                    n_index[i], n_probes[i] = len(index), len(probes)
                to64 = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                listed = lambda n, v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), to64(v))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(owner[long])), to64(tids).take(pa.array(owner[long])), pa.array(number[long].astype(np.int32)), to64(ids).take(pa.array(which)), to64(ids2).take(pa.array(which)),
                        pa.array(size[long].astype(np.int32)), pa.array(signs.view(np.int64)), listed(n_index, indexed), listed(n_probes, probed),
                    ],
                    names=["doc_id", "tid", "line_no", "id", "id2", "size", "sign", "indexed", "probed"],
                )

    return run


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether at most edits insertions, deletions and substitutions turn a into b.

    Row e of the state has bit d + edits set if the prefix of a so far and the
    prefix of b that is d longer are within e edits: only the 2 * edits + 1
    diagonals of the band are kept, and one step moves them all.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # the common prefix, then the common suffix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    places: dict[int, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (j + edits)
    band = (1 << (2 * edits + 1)) - 1
    # diagonal d is column d of b: columns before 0 don't exist, columns after len(b) don't either
    rows = [((1 << (e + 1)) - 1) << edits & band for e in range(edits + 1)]
    limit = len(b) + edits
    for i, c in enumerate(a):
        same = places.get(c, 0) >> i & band  # bit d + edits: a[i] == b[i + d]
        valid = band
        if i + 1 < edits:
            valid &= band << (edits - i - 1)
        if (top := limit - i - 1) < 2 * edits:
            valid &= (1 << max(top + 1, 0)) - 1
        before, now = 0, 0
        fresh = []
        for e, row in enumerate(rows):
            # a match keeps the diagonal, as does a substitution; a deletion from a lowers it; an insertion raises it
            now = ((row & same) | before | before >> 1 | (now << 1 if e else 0)) & valid
            fresh.append(now)
            before = row
        rows = fresh
        if not rows[-1]:
            return False
    last = len(b) - len(a) + edits
    return bool(rows[-1] >> last & 1)


def _verified(edits: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            both = [(p.encode(), q.encode()) for p, q in zip(a, b)]
            keep = [within(p, q, allowed(min(len(p), len(q)), edits)) for p, q in both]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _signature_parts(sign: Column, edits: Column, most: int) -> Column:
    """Hashes of 2 * edits + 1 parts of a signature."""
    out = F.lit(None).cast("array<long>")
    for e in range(most + 1):
        masks = [sum(1 << b for b in range(64) if b % (2 * e + 1) == j) for j in range(2 * e + 1)]
        masks = [m - (1 << 64) if m >> 63 else m for m in masks]
        out = F.when(edits == e, F.array(*(F.xxhash64(F.lit(j), sign.bitwiseAND(F.lit(m))) for j, m in enumerate(masks)))).otherwise(out)
    return out


def near_pairs(lines: DataFrame, docs: DataFrame, edits: int) -> DataFrame:
    """(a, b) with a < b: ids of all pairs of different lines that are near copies. lines: some rows of each id, one with its keys at least.

    Of each key its least and largest id are partial aggregates; only keys
    that different lines share go on to the join, so that no key, however
    common, is gathered in one task before that.
    """
    each = lambda c, indexed: lines.select(F.explode(c).alias("key"), "id", "size", "sign", F.lit(indexed).alias("indexed"))
    keyed = each("indexed", True).unionByName(each("probed", False))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("indexed").alias("any")).where("low <> high and any")
    shared = C.kept(keyed.join(shared.select("key", "n"), "key").distinct().withColumn("edits", F.col("key").bitwiseAND(F.lit(15))), "shared-segments")
    most = shared.agg(F.max("edits")).first()[0] or 0
    # signatures of near copies differ in at most 2 * edits bits: of one bit more parts, one is equal
    sub = F.when(F.col("n") > DENSE, _signature_parts(F.col("sign"), F.col("edits"), most)).otherwise(F.array(F.lit(0).cast("long")))
    shared = shared.withColumn("sub", F.explode(sub))
    p = shared.where("indexed").select("key", "sub", "edits", F.col("id").alias("p"), F.col("size").alias("p_size"), F.col("sign").alias("p_sign"))
    q = shared.select("key", "sub", F.col("id").alias("q"), F.col("size").alias("q_size"), F.col("sign").alias("q_sign"))
    alike = F.abs(F.col("p_size") - F.col("q_size")) <= F.col("edits")
    near = F.bit_count(F.col("p_sign").bitwiseXOR(F.col("q_sign"))) <= 2 * F.col("edits")
    pairs = p.join(q, ["key", "sub"]).where((F.col("p") != F.col("q")) & alike & near).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    pairs = C.kept(pairs, "line-pairs")
    wanted = C.kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-ids")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.where("text is not null").select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.octet_length("line") >= MIN_BYTES).select(F.xxhash64("line").alias("id"), "line")
    texts = C.kept(texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")), "line-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("text_b")), "b")
    return both.mapInArrow(_verified(edits), "a long, b long")


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = 1) -> DataFrame:
    """(doc_id, tid, line_no): the lines that a copy or near copy comes before; tid is the hash of their text.

    Occurrences are ordered by (doc_id, line_no), null ids last. Of equal
    lines the first stays. If a near copy has an earlier first occurrence, all
    occurrences go, whether or not that near copy itself stays: of A, B and C,
    in this order, where B is near to A and C to B but not to A, only A stays.
    """
    spark = docs.sparkSession
    C.arrow_batches(spark)
    docs = docs.select(C.own(docs, "doc_id").alias("doc_id"), C.own(docs, "text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    with C.scope(spark):
        found = docs.mapInArrow(_line_rows(edits, least), f"doc_id {kind}, tid long, line_no int, id long, id2 long, size int, sign long, indexed array<long>, probed array<long>")
        found = C.kept(found, "lines")
        firsts = C.kept(found.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first-lines")
        pairs = C.kept(near_pairs(found.where("size(indexed) > 0"), docs, edits), "near-lines")
        first = firsts.select("id", "first")
        ends = pairs.join(first.withColumnsRenamed({"id": "a", "first": "first_a"}), "a").join(first.withColumnsRenamed({"id": "b", "first": "first_b"}), "b")
        later = ends.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct().withColumn("near", F.lit(True))
        hits = firsts.join(later, "id", "left").where("n > 1 or near").select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near"))
        gone = found.select("doc_id", "tid", "line_no", "id", "id2").join(hits, ["id", "id2"]).where(F.col("near") | ~place.eqNullSafe(F.col("first")))
        return C.kept(gone.select("doc_id", "tid", "line_no"), "gone-lines", out=1)


def dedup(docs: DataFrame, edits: int = EDITS, least: int = 1) -> DataFrame:
    """docs with text cleaned, and lf_judged and lf_gone: counts of judged and of removed lines.

    Needs doc_id and text. Lines are what newlines separate; a line under
    least bytes (by default an empty one) is not judged and stays; one under
    MIN_BYTES bytes goes as an exact repeat only. Edits are counted in bytes
    of UTF-8. A null text stays null and an empty one empty, with 0 judged
    lines; null ids come last in the order; rows that repeat a doc_id and a
    text get equal results; where different texts share a doc_id, equal line
    numbers count as equal places. Long texts and lines are taken whole; empty
    docs give no rows. Other columns pass unchanged, whatever their names;
    columns named lf_judged or lf_gone are replaced.
    """
    docs = docs.drop("lf_judged", "lf_gone")
    marks = dropped_lines(docs, edits, least).groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))
    # a flag for each line up to the last one that goes
    flag = lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get("lines", i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
    marks = marks.select(F.col("doc_id").alias("marked_id"), F.col("tid").alias("marked_tid"), F.flatten(F.transform("lines", flag)).alias("gone"))
    packed = C.rows(docs, doc_id=C.own(docs, "doc_id"), tid=F.xxhash64(C.own(docs, "text")))
    joined = packed.join(marks.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("tid") == F.col("marked_tid")), "left")
    text = F.col("row").getField("text")
    lines = F.split(text, "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    made = joined.select(
        "row",
        F.when(F.col("gone").isNotNull(), F.array_join(stay, "\n")).otherwise(text).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.octet_length(x) >= least))).alias("judged"),
        F.coalesce(F.size(F.filter("gone", lambda x: x)), F.lit(0)).alias("n_gone"),
    )
    return made.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns), F.col("judged").alias("lf_judged"), F.col("n_gone").alias("lf_gone"))


def op5_line_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that repeat, exactly or nearly, removed."""
    made = dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "text", F.col("lf_judged").alias("judged"), F.col("lf_gone").alias("gone"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that only blank lines are left of is removed. n_chars follows the text.

    Nulls, ties, repeated rows and the like are as in dedup(): null and empty
    texts stay, as nothing of them was removed.
    """
    made = dedup(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("lf_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.where(F.col("text").isNull() | (F.col("lf_gone") == 0) | F.col("text").rlike(r"\S")).select(*(f"`{c}`" for c in docs.columns))


_ALLOWED = f"(case when size < {MIN_BYTES} then 0 else {EDITS}" + "".join(f" + (size >= {4 * STEP_BYTES * 4**i})::int" for i in range(12)) + " end)"
#: Letter counts bound the edit distance from below, so that few pairs are compared in full.
ORACLE = f"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents where text is not null),
j as (select doc_id, n, line, strlen(line) as size from l where strlen(line) >= 1),
f as (select line, size, {_ALLOWED} as allowed, min(doc_id * 1000000 + n) as first,
 {", ".join(f"size - strlen(replace(line, '{c}', '')) as c{i}" for i, c in enumerate("etnhaiors"))}
 from j group by line, size),
g as (select *, size + unnest(range(allowed + 1)) as near_size from f where allowed > 0),
p as (select a.line as la, b.line as lb, a.first as fa, b.first as fb, a.allowed from g a join f b on b.size = a.near_size
 and a.line <> b.line and {" + ".join(f"abs(a.c{i} - b.c{i})" for i in range(9))} <= 2 * a.allowed and (a.size < b.size or a.line < b.line)),
v as (select distinct case when fa < fb then lb else la end as line from p where levenshtein(la, lb) <= allowed),
m as (select j.doc_id, j.n, (j.doc_id * 1000000 + j.n > f.first or v.line is not null) as gone from j join f using (line) left join v using (line)),
s as (select l.doc_id, string_agg(l.line, chr(10) order by l.n) filter (where not coalesce(m.gone, false)) as text, count(m.n) as judged, count(*) filter (where m.gone) as gone
 from l left join m on l.doc_id = m.doc_id and l.n = m.n group by l.doc_id)
select doc_id, coalesce(text, '') as text, cast(judged as int) as judged, cast(gone as int) as gone from s
union all select doc_id, null, 0, 0 from documents where text is null
"""
