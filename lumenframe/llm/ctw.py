"""LM scoring by context-tree weighting over binary-decomposed bytes.

Each byte is eight binary decisions; a decision's contexts are the 0 to DEPTH
bytes before it and the byte's bits so far. All nodes count zeros and ones
over the whole corpus; a node's Krichevsky-Trofimov block probability Pe and
the product of its children's weighted probabilities mix to
Pw = Pe / 2 + prod Pw(child) / 2, and the code length of a byte is that of the
predictive mixture over all depths.

A document must not be coded by a model that has seen it. Of a byte with its
DEPTH bytes of context, its run, the occurrences in its own document are taken
out of all nodes on the run's path before it is predicted. Where a node's own
estimate has the share w = Pe / 2 / Pw, taking k occurrences of a bit out
multiplies Pw by R = w * Pe' / Pe + (1 - w) * R(child), and the bit then has
the probability R of k - 1 over R of k at the root. For k = 1, Pe' / Pe is
n / (c - 1/2), with n and c the node's counts of all bits and of that one.

The model is the table of byte runs of DEPTH + 1 bytes with their counts: the
counts of all nodes are sums over it, and every byte of the corpus has one of
its runs. The corpus is hashed into parts. Each part asks for the runs that it
holds, once for each number of own occurrences, the counts are summed over all parts, subtrees below two context bytes
are weighted side by side (the two levels above have at most 257 * 255 nodes),
and each part gets the code lengths of its own runs back. Runs, counts and
code lengths travel packed, one row for each part and bucket of subtrees.
Nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenframe.llm import common as C

#: Context bytes: with the byte itself they fill a number of 64 bits.
DEPTH = 7
#: So many keys at least are gathered before they are summed.
LEAST_MERGED = 1 << 16
_U = np.uint64
_LOG_HALF, _LOG_PI = np.log(0.5), np.log(np.pi)
#: Of the run at a text's byte t < DEPTH, the bytes that are in the text.
_INSIDE = np.array([0xFF + sum(0xFF << 8 * (DEPTH + 1 - j) for j in range(1, t + 1)) for t in range(DEPTH)], _U)


def runs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte its run in one number: the bytes before it, the nearest first (0 before the text), and itself."""
    b = buf.astype(_U)
    g = b.copy()
    for t in range(1, DEPTH + 1):
        g[t:] |= b[:-t] << _U(8 * (DEPTH + 1 - t))
    for t in range(DEPTH):
        at = off[:-1] + t
        at = at[at < off[1:]]
        g[at] &= _INSIDE[t]
    return g


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[at], np.add.reduceat(n[order], at)


def merged(some) -> tuple[np.ndarray, np.ndarray]:
    """summed() of all (distinct keys in order, numbers): these are added as they come, whenever they are as many as the sum so far, so that none is sorted often."""
    total = np.zeros(0, _U), np.zeros(0, np.int64)
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    for x in some:
        fresh.append(x)
        if sum(len(k) for k, _ in fresh) > max(len(total[0]), LEAST_MERGED):
            total, fresh = summed(*map(np.concatenate, zip(total, *fresh))), []  # type: ignore[arg-type]
    return summed(*map(np.concatenate, zip(total, *fresh))) if fresh else total  # type: ignore[arg-type]


def packed(v: np.ndarray) -> bytes:
    """The numbers by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _starts(s: np.ndarray) -> np.ndarray:
    """Places of the first of equal numbers in order."""
    return np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)


def _only_runs(table: pa.Table) -> np.ndarray:
    """The distinct runs of a part's texts, in order."""
    k, fresh = np.zeros(0, _U), []
    for batch in table.combine_chunks().to_batches():
        for block in C.blocks(batch, "text", 2 << 20):
            g = np.sort(runs(*C.text_buffer(block.column("text"))))
            fresh.append(g[_starts(g)])
            if sum(map(len, fresh)) > len(k):  # what is held at once stays within twice the result
                k = np.sort(np.concatenate([k, *fresh]))
                k, fresh = k[_starts(k)], []
    k = np.sort(np.concatenate([k, *fresh]))
    return k[_starts(k)]


def in_order(g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order that has equal runs of a block together, by text; the runs in it; the starts of equal ones, the starts of equal ones of one text, and these' numbers.

    Runs are sorted by the upper bits of their hash, with their places in the
    lower ones: that is one plain sort. Where two different runs share the
    upper bits, the block is sorted by the runs themselves.
    """
    bits = _U(len(g).bit_length())
    h = C.mixed(g) >> bits << bits
    h |= np.arange(len(g), dtype=_U)
    h.sort()
    order = (h & ((_U(1) << bits) - _U(1))).astype(np.int64)
    s = g[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    if (new[1:] & (h[1:] >> bits == h[:-1] >> bits)).any():
        order = np.argsort(g, kind="stable")  # equal runs stay in the order of their texts here, too
        s = g[order]
        new = np.append(True, s[1:] != s[:-1])[: len(s)]
    text = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))[order]
    own = np.flatnonzero(new | np.append(True, text[1:] != text[:-1])[: len(s)])
    return order, s, np.flatnonzero(new), own, np.diff(np.append(own, len(s)))


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of a part's texts, in order, and their numbers; places of runs, in order, that are in one text twice or more, and how often."""
    more: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, _U), np.zeros(0, np.int64))]

    def blocks():
        for batch in table.combine_chunks().to_batches():
            for block in C.blocks(batch, "text", 1 << 20):
                buf, off = C.text_buffer(block.column("text"))
                all_runs = runs(buf, off)
                _, g, _, own, size = in_order(all_runs, off)
                more.append((g[own[size > 1]], size[size > 1]))
                all_runs.sort()
                at = _starts(all_runs)
                yield all_runs[at], np.diff(np.append(at, len(all_runs)))

    k, n = merged(blocks())
    g, size = map(np.concatenate, zip(*more))
    by = np.argsort(g)
    several = np.unique(np.searchsorted(k, g[by]) << 32 | size[by])  # place << 32 | occurrences in a text
    return k, n, several >> 32, several & 0xFFFFFFFF


def labels(n: int) -> np.ndarray:
    """n whole numbers that Spark's hash partitioner puts into n different partitions, in order."""
    out, low = np.full(n, -1, np.int64), 0
    rotate = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    while (out < 0).any():
        v = np.arange(low, low + 16 * n, dtype=np.uint32)
        h = np.uint32(42) ^ rotate(v * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotate(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
        at = h.view(np.int32).astype(np.int64) % n
        out[at[::-1]] = np.where(out[at[::-1]] < 0, v[::-1], out[at[::-1]])
        low += 16 * n
    return out


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places in keys, in order) of each bucket that has some of the sorted keys: runs with the same two nearest bytes share one."""
    top = keys >> _U(8 * (DEPTH - 1))
    at = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(top) else np.zeros(0, np.int64)
    own = (C.mixed(top[at]) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
    of = np.repeat(own, np.diff(np.append(at, len(top))))
    del top
    order = np.argsort(of, kind="stable")
    of = of[order]
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at[1:], len(of))):
        yield int(of[a]), order[a:b]


_ASKED = {"part": "int", "bucket": "int", "size": "long", "runs": "binary", "counts": "binary", "more": "long", "places": "binary", "owns": "binary"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _asked(named: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        """A part's distinct runs by bucket, packed, with their numbers, and places in them of runs with several own occurrences."""
        keys, n, places, owns = _distinct(table)
        several, rows = dict(_by_bucket(keys[places], len(named))), []  # by bucket once: there are many
        for i, at in _by_bucket(keys, len(named)):  # at is in order
            some = several.get(i, np.zeros(0, np.int64))
            own = packed(np.diff(np.searchsorted(at, places[some]), prepend=0)), packed(owns[some])
            rows.append((int(named[i]), len(at), packed(np.diff(keys[at], prepend=_U(0))), packed(n[at]), len(some), *own))
        part = table.column("part")[0].as_py() if table.num_rows else 0
        columns = list(zip(*((part, *r) for r in rows))) or [()] * len(_ASKED)
        return pa.table({name: pa.array(list(c), _ARROW[kind]) for c, (name, kind) in zip(columns, _ASKED.items())})

    return run


def _gathered(batches):
    """(bucket, asks, the function that unpacks the runs of one, all runs, their counts) of each row of (bucket, asks)."""
    for batch in batches:
        for i in range(batch.num_rows):
            asks = batch.column("asks")[i].as_py()
            each = lambda a: np.cumsum(unpacked(a["runs"], a["size"], _U), dtype=_U)
            keys, n = merged((each(a), unpacked(a["counts"], a["size"], np.int64)) for a in asks)
            yield batch.column("bucket")[i].as_py(), asks, each, keys, n


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers, by Stirling's series eight places up."""
    p = np.ones_like(x)
    for i in range(8):
        p = p * (x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(p)


_SMALL = np.arange(4096.0)
_GAMMA = {plus: log_gamma(_SMALL + plus) for plus in (0.5, 1.0)}


def _log_gamma_of(n: np.ndarray, plus: float) -> np.ndarray:
    """log gamma of whole numbers plus 0.5 or 1."""
    out = _GAMMA[plus][np.minimum(n, len(_SMALL) - 1).astype(np.int64)]
    big = n >= len(_SMALL)
    if big.any():
        out[big] = log_gamma(n[big] + plus)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return _log_gamma_of(zeros, 0.5) + _log_gamma_of(ones, 0.5) - _log_gamma_of(zeros + ones, 1.0) - _LOG_PI


def weighted(log_pe: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log Pw of nodes with children, and the weight of their own estimate in it."""
    log_pw = _LOG_HALF + np.logaddexp(log_pe, children)
    return log_pw, np.exp(_LOG_HALF + log_pe - log_pw)


class Subtree:
    """The nodes of depths 2 to DEPTH of some runs: all runs with the same c1 and c2 must be there."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.depths = [(keys, n)]  # runs and counts with DEPTH down to 2 bytes of context
        for _ in range(DEPTH - 2):
            k, c = self.depths[-1]
            self.depths.append(summed(((k >> _U(16)) << _U(8)) | (k & _U(255)), c))

    def levels(self, k: int) -> tuple[list[tuple], np.ndarray, tuple]:
        """Of bit k: by depth from DEPTH down to 2, (zeros, ones, share of the own estimate, place of the parent); the deepest node of each run; depth 2."""
        found, low, low_keys = [], None, None
        for key, count in self.depths:
            node = key >> _U(8 - k)
            new = np.append(True, node[1:] != node[:-1])
            at = np.flatnonzero(new)
            if low is None:
                place = np.cumsum(new) - 1
            node = node[at]
            total = np.add.reduceat(count, at).astype(float)
            ones = np.add.reduceat(count * (key >> _U(7 - k) & _U(1)).astype(np.int64), at).astype(float)
            log_pw, own = log_kt(total - ones, ones), np.ones(len(node))
            if low is not None:
                parent = ((low_keys >> _U(k + 8)) << _U(k)) | (low_keys & _U((1 << k) - 1))
                up = np.searchsorted(node, parent)
                found[-1] = (*found[-1], up)
                log_pw, own = weighted(log_pw, np.bincount(up, low, len(node)))
            found.append((total - ones, ones, own))
            low, low_keys = log_pw, node
        return found, place, (node, total - ones, ones, log_pw)

    def upwards(self) -> pa.Table:
        """(c1, node, zeros, ones, log_pw): sums of the nodes of depth 2 over c2; node: the heap number of the bits so far."""
        rows = []
        for k in range(8):
            node, zeros, ones, log_pw = self.levels(k)[2]
            c1 = (node >> _U(k + 8)) & _U(255)
            heap = (node & _U((1 << k) - 1)) | _U(1 << k)
            flat = (c1 << _U(8) | heap).astype(np.int64)
            some = np.unique(flat)
            at = np.searchsorted(some, flat)
            rows.append((some, *(np.bincount(at, v, len(some)) for v in (zeros, ones, log_pw))))
        flat, zeros, ones, log_pw = (np.concatenate(v) for v in zip(*rows))
        return pa.table({"c1": pa.array((flat >> 8).astype(np.int32)), "node": pa.array((flat & 255).astype(np.int32)), "zeros": zeros, "ones": ones, "log_pw": log_pw})

    def bits(self, top: list[tuple], places: np.ndarray, owns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each run's last byte without one occurrence of it, and of the runs at some places without so many."""
        keys = self.depths[0][0]
        out, more = np.zeros(len(keys)), np.zeros(len(places))
        for k in range(8):
            found, place, (node, *_) = self.levels(k)
            c1, heap = (node >> _U(k + 8) & _U(255)).astype(np.int64), (node & _U((1 << k) - 1) | _U(1 << k)).astype(np.int64)
            tops = [(*(v[at] for v in values), None) for values, at in zip(top, ((c1, heap), heap))]
            bit = keys >> _U(7 - k) & _U(1) == 1
            ratio, of, many = 0.0, place, _Several(bit[places], place[places], owns)
            for zeros, ones, own, *up in (*found, *tops):
                without = [own * (zeros + ones) / np.maximum(c - 0.5, 0.5) for c in (zeros, ones)]
                ratio = np.where(bit, without[1][of], without[0][of]) + (1 - own)[of] * ratio
                many.add(zeros, ones, own)
                if up and up[0] is not None:
                    of = up[0][of]
                    many.of = up[0][many.of]
            out += np.log2(ratio)
            more += many.bits()
        return out, more


#: Up to so many occurrences are taken out one by one.
_ONE_BY_ONE = 16


class _Several:
    """log R of the module's text, for k and for k - 1 occurrences of a bit, from the deepest node upward."""

    def __init__(self, bit: np.ndarray, of: np.ndarray, owns: np.ndarray):
        self.bit, self.of, self.owns = bit, of, owns.astype(float)
        self.ratios = [np.full(len(of), -np.inf)] * 2
        self.few = [np.flatnonzero((owns > j) & (owns <= _ONE_BY_ONE)) for j in range(_ONE_BY_ONE)]
        self.many = np.flatnonzero(owns > _ONE_BY_ONE)

    def add(self, zeros: np.ndarray, ones: np.ndarray, own: np.ndarray) -> None:
        if not len(self.of):
            return
        z, o, w = zeros[self.of], ones[self.of], own[self.of]
        c, n = np.where(self.bit, o, z), z + o
        taken, last = np.zeros(len(c)), np.zeros(len(c))  # log Pe' - log Pe for k - 1 occurrences, and what the k-th adds
        for j, some in enumerate(self.few):
            if len(some):
                taken[some] += last[some]
                last[some] = np.log((n[some] - j) / (c[some] - j - 0.5))
        if len(some := self.many):
            a, b, k = c[some], (n - c)[some], self.owns[some]
            taken[some] = log_kt(a - k + 1, b) - log_kt(a, b)
            last[some] = np.log((a + b - k + 1) / (a - k + 0.5))
        with np.errstate(divide="ignore"):
            mine, rest = np.log(w), np.log1p(-w)
            self.ratios = [np.logaddexp(mine + x, rest + r) for x, r in zip((taken + last, taken), self.ratios)]

    def bits(self) -> np.ndarray:
        return (self.ratios[0] - self.ratios[1]) / np.log(2) if len(self.of) else np.zeros(0)


def top_of(rows: pa.Table) -> list[tuple]:
    """(zeros, ones, share of the own estimate) of the nodes of depths 1 and 0. rows: summed (c1, node, zeros, ones, log_pw)."""
    at = (rows["c1"].to_numpy(), rows["node"].to_numpy())
    zeros, ones, low = (np.zeros((256, 256)) for _ in range(3))
    for name, into in (("zeros", zeros), ("ones", ones), ("log_pw", low)):
        into[at] = rows[name].to_numpy()
    log_pw1, own1 = weighted(log_kt(zeros, ones), low)
    log_pw1[zeros + ones == 0] = 0
    zeros0, ones0 = zeros.sum(0), ones.sum(0)
    _, own0 = weighted(log_kt(zeros0, ones0), log_pw1.sum(0))
    return [(zeros, ones, own1), (zeros0, ones0, own0)]


_SCORED = "n_bytes long, bits double, bits_per_byte double"


def _scored(docs: pa.Table, costs: pa.Table, named: np.ndarray, kind: pa.DataType) -> pa.Table:
    run = _only_runs(docs)
    bits = np.zeros(len(run), np.float32)
    rows = {r["bucket"]: r for r in costs.drop_columns(["part"]).to_pylist()}
    known, several = [np.zeros(0, _U)], [np.zeros(0, np.float32)]  # of runs with several own occurrences: place << 32 | occurrences
    for i, at in _by_bucket(run, len(named)):
        r = rows.pop(int(named[i]))
        bits[at] = unpacked(r["bits"], len(at), np.float32)
        place = np.cumsum(unpacked(r["places"], r["more"], np.int64))
        known.append(at[place].astype(_U) << _U(32) | unpacked(r["owns"], r["more"], np.int64).astype(_U))
        several.append(unpacked(r["more_bits"], r["more"], np.float32))
    known, several = np.concatenate(known), np.concatenate(several)
    by = np.argsort(known)
    known, several = known[by], several[by]
    by = np.argsort(hashed := C.mixed(run))
    hashed = hashed[by]
    out = []
    for batch in docs.combine_chunks().to_batches():
        for block in C.blocks(batch, "text", 1 << 20):
            buf, off = C.text_buffer(block.column("text"))
            each = np.zeros(0)
            if len(buf):
                order, g, at, own, n = in_order(runs(buf, off), off)
                place = by[np.searchsorted(hashed, C.mixed(g[at]))]  # asked in order, but for few
                new = np.zeros(len(g), bool)
                new[at] = True
                place = place[np.cumsum(new[own]) - 1]  # of each start of equal runs of a text
                cost = bits[place]
                some = np.flatnonzero(n > 1)
                cost[some] = several[np.searchsorted(known, place[some].astype(_U) << _U(32) | n[some].astype(_U))]
                each = np.empty(len(g))
                each[order] = np.repeat(cost, n)
            size = np.diff(off)
            some = size > 0  # reduceat needs the starts of texts that hold bytes
            total = np.zeros(len(size))
            if len(buf):
                total[some] = np.add.reduceat(each, off[:-1][some])
            none = block.column("text").is_null().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", divide="ignore"):
                per = total / size
            out.append(pa.table({"doc_id": block.column("doc_id"), "n_bytes": pa.array(size, mask=none), "bits": pa.array(total, mask=none), "bits_per_byte": pa.array(per, mask=size == 0)}))
    empty = pa.schema([("doc_id", kind), ("n_bytes", pa.int64()), ("bits", pa.float64()), ("bits_per_byte", pa.float64())])
    return pa.concat_tables(out) if out else empty.empty_table()


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte): code length of each document under the model of all others.

    Needs doc_id and text. Each byte is predicted without its run's own
    occurrences in the document (see above); what other rows hold counts, also
    that of rows that repeat this one: a copy makes a document cheap. A null
    text gets nulls; an empty one has 0 bytes, 0 bits and null bits_per_byte.
    Repeated rows are counted and scored as often as they come. Long texts are
    taken whole; empty docs give no rows; ids keep their type; other columns
    are ignored.
    """
    spark = docs.sparkSession
    C.arrow_batches(spark)
    docs = docs.select(C.own(docs, "doc_id").alias("doc_id"), C.own(docs, "text").alias("text"))
    kind = docs.schema["doc_id"].dataType
    named, arrow = labels(C.parts(spark)), to_arrow_type(kind)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(len(named))).cast("int")
    docs = docs.withColumn("part", F.get(F.lit([*map(int, named)]), part))
    asked = docs.groupBy("part").applyInArrow(_asked(named), ", ".join(map(" ".join, _ASKED.items())))
    model = C.kept(asked.groupBy("bucket").agg(F.collect_list(F.struct(*(c for c in _ASKED if c != "bucket"))).alias("asks")), "runs")

    def ups(batches):
        for _, _, _, keys, count in _gathered(batches):
            yield from Subtree(keys, count).upwards().to_batches()

    rows = model.mapInArrow(ups, "c1 int, node int, zeros double, ones double, log_pw double").groupBy("c1", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log_pw")))
    sent = spark.sparkContext.broadcast(top_of(rows.toArrow()))  # at most 256 * 255 rows, for any corpus

    def costed(batches):
        for bucket, asks, each, keys, count in _gathered(batches):
            at = [np.searchsorted(keys, each(a)).astype(np.int32) for a in asks]
            places = [p[np.cumsum(unpacked(a["places"], a["more"], np.int64))] for p, a in zip(at, asks)]
            bits, more = Subtree(keys, count).bits(sent.value, np.concatenate(places), np.concatenate([unpacked(a["owns"], a["more"], np.int64) for a in asks]))
            bits, more, low = bits.astype(np.float32), more.astype(np.float32), 0
            for p, a in zip(at, asks):
                made = {"bits": packed(bits[p]), "more": a["more"], "places": a["places"], "owns": a["owns"], "more_bits": packed(more[low : low + a["more"]])}
                low += a["more"]
                yield pa.RecordBatch.from_pydict({"part": pa.array([a["part"]], pa.int32()), "bucket": pa.array([bucket], pa.int32()), **{c: pa.array([v], pa.int64() if c == "more" else pa.binary()) for c, v in made.items()}})

    costs = model.mapInArrow(costed, "part int, bucket int, bits binary, more long, places binary, owns binary, more_bits binary")
    return docs.groupBy("part").cogroup(costs.groupBy("part")).applyInArrow(lambda d, c: _scored(d, c, named, arrow), f"doc_id {kind.simpleString()}, {_SCORED}")


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document, in all and per byte."""
    made = score(C.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", F.round("bits", 2).alias("bits"), F.round("bits_per_byte", 4).alias("bits_per_byte"))
