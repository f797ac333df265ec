"""Benchmark decontamination: suffix arrays of training shards, searched with every test suffix.

A shard is a run of whole documents of one partition. Its suffix array orders
the places of all words that the benchmark has, too, by the words that follow,
up to the document's end or a word that the benchmark lacks: one sort by
several packed symbols, then prefix doubling of the places that are still
tied. Every suffix of every test item is binary-searched, depth by depth, for
the places that begin with its first MIN_WORDS words. These intervals are few
and disjoint, so that the documents in them are listed in linear time, however
often a passage is repeated; a document's longest match with a suffix is at
one of its two places next to the suffix's own place in the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenframe.llm import common as C

#: A match counts from so many words on, or if it is a whole shorter item.
MIN_WORDS = 13
#: Bytes of text in a shard, unless a single document is longer.
SHARD_BYTES = 4 << 20
#: Bytes of test text that are sent to the executors at once; a larger benchmark is searched in several passes.
TEST_BYTES = 16 << 20

_ODD = 0x9E3779B97F4A7C15  # of the prefix hashes, with its inverse modulo 2**64
_INVERSE = np.uint64(pow(_ODD, -1, 1 << 64))


def suffix_array(symbols: np.ndarray, end: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): places with symbols above 0 in the order of the symbols from there on, compared to depth or their end, and their first 64 // bits symbols packed."""
    n, per = len(symbols), 64 // bits
    places = np.flatnonzero(symbols)
    key = np.zeros(len(places), np.uint64)
    last = end[places]
    for t in range(per):
        s = symbols[np.minimum(places + t, n - 1)] if n else symbols
        key |= np.where(places + t < last, s, np.uint64(0)) << np.uint64(bits * (per - 1 - t))
    by = np.argsort(key)
    order, keys = places[by], key[by]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    known, slots, rank = per, np.arange(len(order)), None
    while known < depth:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        head = np.maximum.accumulate(np.where(new, slots, 0))  # of each slot, the first slot of its tie
        rank = np.zeros(n, np.int64) if rank is None else rank
        rank[order] = head
        at = order[tied]
        after = np.where(at + known < end[at], rank[np.minimum(at + known, n - 1)] + 1, 0)
        both = head[tied] * (n + 1) + after
        by = np.argsort(both, kind="stable")
        order[tied] = at[by]
        new[tied] = np.append(True, both[by][1:] != both[by][:-1])
        known *= 2
    return order, keys


class Runs:
    """Words with hashes of all their runs."""

    def __init__(self, words: np.ndarray, end: np.ndarray):
        self.words, self.end = words, end
        power = lambda x: np.cumprod(np.append(np.uint64(1), np.full(len(words), x, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(words * power(_INVERSE)[: len(words)]))
        self.scale = power(np.uint64(_ODD))

    def hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.scale[at]


def common_length(a: Runs, p: np.ndarray, b: Runs, q: np.ndarray) -> np.ndarray:
    """How many words from place p in a on are those from place q in b on."""
    low, high = np.zeros(len(p), np.int64), np.minimum(a.end[p] - p, b.end[q] - q)
    while len(p) and (low < high).any():
        mid = (low + high + 1) >> 1
        same = a.hash(p, mid) == b.hash(q, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _least_in_ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a:b], for many nonempty ranges: by least values of ranges of each power of two."""
    tables, most = [values], int((b - a).max(initial=1))
    while 2 << (len(tables) - 1) <= most:
        t, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[:-half], t[half:]))
    out = np.empty(len(a), values.dtype)
    level = np.floor(np.log2(b - a)).astype(np.int64)
    for k in np.unique(level):
        some = level == k
        out[some] = np.minimum(tables[k][a[some]], tables[k][b[some] - (1 << k)])
    return out


class Tests:
    """All suffixes of the test items that are long enough to match."""

    def __init__(self, ids: list, texts: list):
        buf, off = C.text_buffer(pa.compute.utf8_lower(pa.array(texts, pa.string())))
        _, _, words, doc = C.word_table(buf, off)
        self.ids = ids
        lens = np.bincount(doc, minlength=len(texts))
        ends = np.cumsum(lens)
        self.runs = Runs(words, ends[doc])
        self.item = doc
        self.first = (ends - lens)[doc]
        need = np.minimum(MIN_WORDS, lens)[doc]
        self.longest = int(lens.max()) if len(lens) else 0
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        self.symbols = symbols.astype(np.uint64) + np.uint64(1)
        self.bits = int(len(self.vocabulary) + 1).bit_length()
        start = np.flatnonzero(np.arange(len(doc)) + need <= ends[doc])
        self.start, self.need = start, need[start]
        self.low, self.high = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        per, top = 64 // self.bits, np.uint64((1 << self.bits) - 1)
        for t in range(per):
            s, by = self.symbols[np.minimum(start + t, max(len(words) - 1, 0))], np.uint64(self.bits * (per - 1 - t))
            self.low |= np.where(t < self.need, s, np.uint64(0)) << by
            self.high |= np.where(t < self.need, s, top) << by

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        """Symbols of other words; 0 of those that no test item has."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.uint64)

    def search(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, length, test word, training word): the longest match of each text and item, the first of equal ones. doc: the words' text numbers, in order."""
        none = (np.zeros(0, np.int64),) * 5
        if not len(words) or not len(self.start):
            return none
        n, symbols = len(words), self.symbols_of(words)
        ends = np.searchsorted(doc, doc, "right") if len(doc) else doc
        stops = np.append(np.flatnonzero(symbols == 0), n)
        end = np.minimum(ends, stops[np.searchsorted(stops, np.arange(n))])
        order, keys = suffix_array(symbols, end, max(self.longest, 1), self.bits)
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        i, need = self.start, self.need
        for t in range(64 // self.bits, MIN_WORDS):
            go = hi > lo
            i, need, lo, hi = i[go], need[go], lo[go], hi[go]
            deep = np.flatnonzero(need > t)
            if not len(deep):
                continue
            goal = self.symbols[i[deep] + t]

            def bound(strict: bool) -> np.ndarray:
                a, b = lo[deep].copy(), hi[deep].copy()
                while (a < b).any():
                    mid = np.minimum((a + b) >> 1, len(order) - 1)
                    at = order[mid] + t
                    s = np.where(at < end[order[mid]], symbols[np.minimum(at, n - 1)], np.uint64(0))
                    right = (s <= goal if strict else s < goal) & (a < b)
                    left = ~right & (a < b)
                    a[right], b[left] = mid[right] + 1, mid[left]
                return a

            a, b = bound(False), bound(True)
            lo[deep], hi[deep] = a, b
        go = hi > lo
        i, lo, hi = i[go], lo[go], hi[go]
        if not len(i):
            return none
        # the documents of each interval; intervals of equally long needs are equal or disjoint
        (ia, ib), which = np.unique(np.stack([lo, hi]), axis=1, return_inverse=True)
        sizes = ib - ia
        slot = np.repeat(ia - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        texts = int(doc[-1]) + 1
        listed = np.unique(np.repeat(np.arange(len(ia)), sizes) * texts + doc[order[slot]])
        cut = np.searchsorted(listed, np.arange(len(ia) + 1) * texts)
        count = np.diff(cut)[which]
        test = np.repeat(np.arange(len(i)), count)
        text = listed[np.repeat(cut[:-1][which] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())] % texts
        # each suffix's own place in the order
        train = Runs(words, end)
        a, b = lo.copy(), hi.copy()
        while (go := np.flatnonzero(a < b)).size:
            mid = (a[go] + b[go]) >> 1
            q = order[mid]
            size = common_length(self.runs, i[go], train, q)
            p, q, stop = i[go] + size, q + size, end[q]
            wanted = np.where(p < self.runs.end[i[go]], self.symbols[np.minimum(p, len(self.symbols) - 1)], np.uint64(0))
            found = np.where(q < stop, symbols[np.minimum(q, n - 1)], np.uint64(0))
            less = found < wanted
            a[go[less]], b[go[~less]] = mid[less] + 1, mid[~less]
        slot = np.unique(slot)
        held = np.sort(doc[order[slot]] * n + slot)  # slots by text
        where = np.searchsorted(held, text * n + a[test])
        length = np.zeros(len(test), np.int64)
        for at, fine in ((where - 1, (where > 0) & (held[where - 1] >= text * n + lo[test])), (where, (where < len(held)) & (held[np.minimum(where, len(held) - 1)] < text * n + hi[test]))):
            some = np.flatnonzero(fine)
            length[some] = np.maximum(length[some], common_length(self.runs, i[test[some]], train, order[held[at[some]] % n]))
        item, word = self.item[i[test]], (i - self.first[i])[test]
        by = np.lexsort((word, -length, item, text))
        best = np.ones(len(by), bool)
        best[1:] = (text[by][1:] != text[by][:-1]) | (item[by][1:] != item[by][:-1])
        by = by[best]
        test, text, item, word, length = test[by], text[by], item[by], word[by], length[by]

        def begins(slots: np.ndarray, some: np.ndarray) -> np.ndarray:
            """Whether the places of these slots begin with the matches."""
            q = order[slots]
            fits = q + length[some] <= end[q]
            q, size = q[fits], length[some][fits]
            fits[fits] = train.hash(q, size) == self.runs.hash(i[test[some]][fits], size)
            return fits

        # the slots that begin with the match lie around the suffix's own place: their first and last
        left, right = lo[test].copy(), a[test].copy()
        while (go := np.flatnonzero(left < right)).size:
            mid = (left[go] + right[go]) >> 1
            yes = begins(mid, go)
            right[go[yes]], left[go[~yes]] = mid[yes], mid[~yes] + 1
        low, left, right = left, a[test].copy(), hi[test].copy()
        while (go := np.flatnonzero(left < right)).size:
            mid = (left[go] + right[go]) >> 1
            yes = begins(mid, go)
            left[go[yes]], right[go[~yes]] = mid[yes] + 1, mid[~yes]
        place = _least_in_ranges(order[held % n], np.searchsorted(held, text * n + low), np.searchsorted(held, text * n + left))
        return text, item, length, word, place


def _shards(batches):
    """Record batches of about SHARD_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for part in C.blocks(batch, "text", SHARD_BYTES):
            held.append(part)
            size += part.column("text").nbytes
            if size >= SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(p.num_rows for p in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matches(shard: pa.RecordBatch, tests: Tests) -> tuple[np.ndarray, ...]:
    """(row, item, length, test word, training word): the longest match of each row and item, the first of equal ones."""
    buf, off = C.text_buffer(pa.compute.utf8_lower(shard.column("text")))
    _, _, words, doc = C.word_table(buf, off)
    row, item, length, word, place = tests.search(words, doc)
    return row, item, length, word, place - np.searchsorted(doc, row)


def _slices(benchmark: DataFrame) -> list[tuple[list, list]]:
    """The items' ids and texts, in lists of at most TEST_BYTES (one pass over the training data each)."""
    text = C.own(benchmark, "text").cast("string").alias("text")
    item = C.own(benchmark, "item_id")
    benchmark = benchmark.select((item.cast("long") if isinstance(benchmark.schema["item_id"].dataType, T.NullType) else item).alias("item_id"), text).where("text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // TEST_BYTES)) if size > TEST_BYTES else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    out = []
    for k in range(n):
        rows = benchmark.where(part == k).select("item_id", "text").orderBy("item_id", "text").collect()
        out.append(([r.item_id for r in rows], [r.text for r in rows]))
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, item_word, doc_word): the longest match of each document and test item, with its word offsets from 0.

    Words are runs of letters, digits and non-ASCII characters of the lower-
    cased text. A match has MIN_WORDS words, or is a whole shorter item. Ties
    go to the first place in the item, then in the document. Nulls and empty
    texts on either side match nothing; a null id is given as null, and ids
    keep their types. Repeated documents, and repeated items, each have their
    own rows. Very long and repetitive texts are taken whole; empty tables give
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    C.arrow_batches(spark)
    docs = docs.select(C.own(docs, "doc_id").alias("doc_id"), C.own(docs, "text").alias("text")).where("text is not null")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType]
    kinds[1] = T.LongType() if isinstance(kinds[1], T.NullType) else kinds[1]
    named = to_arrow_type(kinds[1])
    out = None
    for ids, texts in _slices(benchmark):
        sent = spark.sparkContext.broadcast(Tests(ids, texts))

        def run(batches, sent=sent):
            tests = sent.value
            names = pa.array(tests.ids, named)
            for shard in _shards(batches):
                row, item, length, at, place = _matches(shard, tests)
                yield pa.RecordBatch.from_arrays(
                    [shard.column("doc_id").take(pa.array(row)), names.take(pa.array(item)), *(pa.array(v.astype(np.int64)) for v in (length, at, place))],
                    names=["doc_id", "item_id", "words", "item_word", "doc_word"],
                )

        found = docs.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, words long, item_word long, doc_word long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no match; rows, order of columns and clashing names stay as they are. Null texts stay."""
    spark = docs.sparkSession
    C.arrow_batches(spark)
    for ids, texts in _slices(benchmark):
        sent = spark.sparkContext.broadcast(Tests(ids, texts))

        def run(batches, sent=sent):
            for shard in _shards(batches):
                hit = np.zeros(shard.num_rows, bool)
                hit[_matches(shard, sent.value)[0]] = True
                yield shard.filter(pa.array(~hit))

        docs = C.mapped(docs, run)
    return docs


def op10_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verbatim match of every affected document with each benchmark item."""
    return matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; nulls, repeated rows and the like are as in matches() and clean()."""
    return clean(docs, C.table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
ORACLE = f"""
with b as (select item_id, {_WORDS} as w, least({MIN_WORDS}, len({_WORDS})) as need from benchmark where text is not null),
d as (select doc_id, {_WORDS} as w from documents where text is not null),
bg as (select item_id, need, i, array_to_string(w[i + 1:i + need], ' ') as g from (select item_id, w, need, unnest(range(len(w) - need + 1)) as i from b where need > 0)),
dg as (select doc_id, need, i, array_to_string(w[i + 1:i + need], ' ') as g from (select doc_id, w, need, unnest(range(len(w) - need + 1)) as i from d, (select distinct need from b where need > 0) where len(w) >= need)),
m as (select doc_id, item_id, bg.need, bg.i as bi, dg.i as di, bg.i - row_number() over (partition by doc_id, item_id, dg.i - bg.i order by bg.i) as run from bg join dg on bg.need = dg.need and bg.g = dg.g),
r as (select doc_id, item_id, min(bi) as item_word, min(di) as doc_word, count(*) + any_value(need) - 1 as words from m group by doc_id, item_id, di - bi, run)
select doc_id, item_id, words, item_word, doc_word from r qualify row_number() over (partition by doc_id, item_id order by words desc, item_word, doc_word) = 1
"""
