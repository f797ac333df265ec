"""Exact top-k search with a bit-sliced index.

Vectors are attributes: each component is quantised to DATA_BITS bits, and bit
j of component d of all rows of a block is one bitmap, a slice. A query's
components are integer weights of QUERY_BITS bits and a sign. The weighted sum
of all components is made for all rows at once by adding slices, shifted by
the weights' bits, with bitmap full adders; the top rows are selected from the
sum's most significant slice downward and resolved by exact products, which
gives a k-th best that is reached. The quantisation errors of a query and of a
block bound how far a sum can be from the true product: all rows whose bounds
reach that k-th best are resolved by exact products, too. A task goes from
block to block with the best that its queries have found so far as bounds;
where there is one, no rows are selected first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lumenframe.llm import common as C
from lumenframe.llm.ctw import labels

K = 10
DATA_BITS, QUERY_BITS = 6, 4
#: Ids that search: those divisible by it.
EVERY = 50
#: Rows of a block, whose slices lie in one task's memory; queries of a tile.
BLOCK_ROWS = TILE_QUERIES = 1 << 16
#: Vectors of so many bytes together are sent to all executors at most; more are joined in tiles.
BROADCAST_BYTES = 64 << 20
#: Words of 64 rows that are added up at once, so that slices stay in the cache.
WORDS = 1024
DECIMALS = 6


def full_add(levels: list[np.ndarray]) -> list[np.ndarray]:
    """The slices of the sum, least first. levels[j]: bitmaps (n, words) of weight 2**j."""
    out, carried, j = [], [], 0
    while j < len(levels) or carried:
        p = np.concatenate([*([levels[j]] if j < len(levels) and len(levels[j]) else []), *carried]) if carried or (j < len(levels) and len(levels[j])) else None
        carried = []
        if p is None:
            out.append(None)
            j += 1
            continue
        while len(p) > 1:
            m = len(p) // 3
            if m:
                a, b, c = p[:m], p[m : 2 * m], p[2 * m : 3 * m]
                t = a ^ b
                carry = (a & b) | (t & c)
                t ^= c
            else:
                a, b = p[:1], p[1:2]
                t, carry = a ^ b, a & b
            carried.append(carry)
            p = np.concatenate([t, p[3 * m :]]) if m and len(p) > 3 * m else t
        out.append(p[0])
        j += 1
    return out


def signed_digits(weight: np.ndarray) -> list[np.ndarray]:
    """Digits -1, 0 and 1 of whole numbers, least first, none of them beside another nonzero one."""
    out, w = [], weight.copy()
    while w.any():
        digit = np.where(w & 1, 2 - (w & 3), 0)
        out.append(digit)
        w = (w - digit) >> 1
    return out


class SlicedIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, d = vectors.shape
        self.low = float(vectors.min()) if vectors.size else 0.0
        self.step = max((float(vectors.max()) - self.low) / (1 << DATA_BITS), 1e-300) if vectors.size else 1.0
        level = np.clip(((vectors - self.low) / self.step).astype(np.int64), 0, (1 << DATA_BITS) - 1)
        rest = vectors - (self.low + self.step * (level + 0.5))
        self.rest = float(np.sqrt((rest**2).sum(1)).max(initial=0))
        self.size = float(np.sqrt((vectors**2).sum(1)).max(initial=0))
        words = -(-n // 64)
        self.slices = np.zeros((2, d, DATA_BITS, words), np.uint64)
        bits = np.zeros((d, words * 64), bool)
        for j in range(DATA_BITS):
            bits[:, :n] = (level.T >> j) & 1
            self.slices[0, :, j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
            bits[:, :n] = ~bits[:, :n]
            self.slices[1, :, j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.all = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=len(self.ids), bitorder="little"))

    def _sums(self, digits: list[np.ndarray]) -> list[np.ndarray]:
        """The slices of the rows' sums over all components of their levels, or of the levels' complements, times the digits."""
        taken = []
        for at in range(DATA_BITS + len(digits) - 1):
            some = [(np.flatnonzero(digits[at - j]), digits[at - j], j) for j in range(max(0, at - len(digits) + 1), min(DATA_BITS, at + 1))]
            taken.append(tuple(np.concatenate(x) for x in zip(*(((digit[d] < 0).astype(np.int64), d, np.full(len(d), j)) for d, digit, j in some))))
        parts = []
        for w in range(0, len(self.all), WORDS):
            parts.append(full_add([self.slices[neg, d, j, w : w + WORDS] for neg, d, j in taken]))
        zero = lambda w: np.zeros(min(WORDS, len(self.all) - w), np.uint64)
        return [np.concatenate([p[k] if k < len(p) and p[k] is not None else zero(i * WORDS) for i, p in enumerate(parts)]) for k in range(max(map(len, parts), default=0))]

    def _at_least(self, total: list[np.ndarray], least: int) -> np.ndarray:
        """The bitmap of the rows whose sums are that large."""
        if least <= 0:
            return self.all
        over, equal = np.zeros_like(self.all), self.all
        for at in range(max(len(total), least.bit_length()) - 1, -1, -1):
            s = total[at] if at < len(total) else None
            if least >> at & 1:
                equal = equal & s if s is not None else np.zeros_like(equal)
            elif s is not None:
                over, equal = over | (equal & s), equal & ~s
        return over | equal

    def _top_rows(self, total: list[np.ndarray], k: int) -> np.ndarray:
        """The rows of the k largest sums, with all that tie with the k-th."""
        sure, edge = np.zeros_like(self.all), self.all
        for s in reversed(total):
            with_bit = edge & s
            if int(np.bitwise_count(sure | with_bit).sum()) >= k:
                edge = with_bit
            else:
                sure, edge = sure | with_bit, edge & ~s
        return self._rows(sure | edge)

    def best(self, name, query: np.ndarray, k: int, rows: np.ndarray, bound: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids other than name and their best rounded products of the k best ids in some rows; ties go to the smaller id, and products below bound are left out."""
        rows = rows[self.ids[rows] != name]
        ids, score = self.ids[rows], np.round(self.vectors[rows] @ query, DECIMALS) + 0.0
        if bound > -np.inf:
            some = score >= bound
            ids, score = ids[some], score[some]
        by = np.lexsort((ids, -score))
        ids, score = ids[by], score[by]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:k]
        return ids[first], score[first]

    def top(self, name, query: np.ndarray, k: int, bound: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """best() over all rows, exactly; ids whose products are below bound may be left out."""
        n = len(self.ids)
        scale = float(np.abs(query).max(initial=0)) / ((1 << QUERY_BITS) - 1)
        if n <= 4 * k or not scale:
            return self.best(name, query, k, np.arange(n))
        weight = np.rint(query / scale).astype(np.int64)
        digits = signed_digits(weight)
        total = self._sums(digits)
        some = k + 1
        while bound == -np.inf:  # until the rows of the largest sums have k other ids
            ids, score = self.best(name, query, k, self._top_rows(total, min(some, n)))
            if len(ids) == k:
                bound = float(score[-1])
            elif some >= n:
                return ids, score  # these were all rows
            some *= 2
        error = float(np.linalg.norm(query - scale * weight)) * self.size + float(np.linalg.norm(scale * weight)) * self.rest + 10.0**-DECIMALS
        complement = ((1 << DATA_BITS) - 1) * sum(int((x < 0).sum()) << i for i, x in enumerate(digits))
        least = (bound - error - scale * (self.low + self.step / 2) * int(weight.sum())) / (scale * self.step) + complement
        return self.best(name, query, k, self._rows(self._at_least(total, int(np.floor(least)) - 1)), bound)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").combine_chunks()
    ids = ids.to_numpy(zero_copy_only=False) if not pa.types.is_string(ids.type) else np.array(ids.to_pylist(), dtype=str)
    flat = table.column("v").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, flat.flatten().to_numpy().astype(float).reshape(len(ids), -1)


def _found(queries: tuple[np.ndarray, np.ndarray], indexes: list[SlicedIndex], k: int, kind: pa.DataType) -> pa.Table:
    """(id, neighbour, score): of each query the k best ids in the blocks together."""
    out: tuple[list, list, list] = ([], [], [])
    for name, query in zip(*queries):
        ids, score = None, None
        for index in indexes:
            full = ids is not None and len(ids) == k
            more = index.top(name, query, k, float(score[-1]) if full else -np.inf)
            if ids is None:
                ids, score = more
                continue
            both_ids, both = np.concatenate([ids, more[0]]), np.concatenate([score, more[1]])
            by = np.lexsort((both_ids, -both))
            _, first = np.unique(both_ids[by], return_index=True)
            by = by[np.sort(first)[:k]]
            ids, score = both_ids[by], both[by]
        if ids is not None:
            for into, v in zip(out, (np.full(len(ids), name), ids, score)):
                into.append(v)
    named = lambda v: pa.array(np.concatenate(v) if v else [], kind)
    return pa.table({"id": named(out[0]), "neighbour": named(out[1]), "score": pa.array(np.concatenate(out[2]) if out[2] else [], pa.float64())})


def _blocks(table: pa.Table) -> list[SlicedIndex]:
    return [SlicedIndex(*_matrix(table.slice(i, BLOCK_ROWS))) for i in range(0, table.num_rows, BLOCK_ROWS)]


def _divisible(ids: Column, kind: str, every: int) -> Column:
    """Whether ids, whole numbers or texts of such, are divisible; no other text is."""
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    return F.coalesce((ids if numeric else ids.cast("string").try_cast("decimal(38,10)")) % every == 0, F.lit(False))


def neighbours(vectors: DataFrame, k: int = K, every: int = 1) -> DataFrame:
    """(vec_id, neighbour, score, rank): for every row the k rows of largest inner product, exactly.

    With every above 1 only rows whose ids are divisible by it search; they
    search all rows.

    Needs vec_id and embedding. Scores are rounded to DECIMALS digits before
    they are compared; ties go to the smaller id. A row is not its own
    neighbour, nor are rows that repeat its id; a repeated id searches once,
    with its least vector, and is found at most once, with its best product.
    Vectors are compared with those of equal length. A null id, a null or
    empty vector, and one with a null, NaN or infinite component take no part.
    With fewer than k others all are given; an empty table gives no rows;
    other columns are ignored.

    Vectors of up to BROADCAST_BYTES are sent to all executors, and each task
    takes some queries past all blocks. Above that, blocks of rows meet tiles
    of queries, each pair in a partition of its own: either side is shuffled
    once for each block of the other.
    """
    spark = vectors.sparkSession
    C.arrow_batches(spark)
    kind = vectors.schema["vec_id"].dataType
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    v = C.own(vectors, "embedding") if single else F.transform(C.own(vectors, "embedding"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.select(C.own(vectors, "vec_id").alias("id"), v.alias("v")).where("id is not null and size(v) > 0").where(~bad).distinct().withColumn("dim", F.size("v"))
    fine = C.kept(fine, "vectors")
    asks = _divisible(F.col("id"), kind.simpleString(), every) if every > 1 else F.lit(True)
    n, size, searching = fine.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)) * (4 if single else 8), F.count_if(asks)).first()
    queries = fine.where(asks).groupBy("id", "dim").agg(F.min("v").alias("v")).select("id", "dim", "v")
    named, tasks = to_arrow_type(kind), C.parts(spark)
    columns = f"id {kind.simpleString()}, neighbour {kind.simpleString()}, score double"
    if size <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast(fine.select("id", "dim", "v").toArrow())  # at most BROADCAST_BYTES

        def run(batches):
            held: dict[int, list[SlicedIndex]] = {}
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for dim in pc.unique(batch.column("dim")).to_pylist():
                    if dim not in held:
                        held[dim] = _blocks(sent.value.filter(pc.equal(sent.value.column("dim"), dim)))
                    yield from _found(_matrix(table.filter(pc.equal(table.column("dim"), dim))), held[dim], k, named).to_batches()

        best = queries.repartition(tasks, F.xxhash64("id")).mapInArrow(run, columns)
    else:
        blocks = -(-n // BLOCK_ROWS)
        tiles = max(-(-searching // TILE_QUERIES), -(-tasks // blocks))
        cells = F.lit([*map(int, labels(blocks * tiles))])  # of pairs of a block and a tile: a partition for each
        at = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
        every_one = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

        def spread(side: DataFrame, block: Column, tile: Column) -> DataFrame:
            placed = side.select("id", "dim", "v", block.alias("block")).select("*", tile.alias("tile"))
            return placed.select("id", "dim", "v", F.get(cells, F.col("block") * tiles + F.col("tile")).alias("cell")).repartition(blocks * tiles, "cell").groupBy("cell")

        def met(q: pa.Table, rows: pa.Table) -> pa.Table:
            found = [_found(((), ()), [], k, named)]
            for dim in pc.unique(q.column("dim")).to_pylist():
                some, others = (t.filter(pc.equal(t.column("dim"), dim)) for t in (q, rows))
                found.append(_found(_matrix(some), _blocks(others), k, named))
            return pa.concat_tables(found)

        # a row repeats an id in its own block only, as blocks go by id
        best = spread(queries, every_one(blocks), at(tiles)).cogroup(spread(fine, at(blocks), every_one(tiles))).applyInArrow(met, columns)
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbour")
    both = best.groupBy("id", "neighbour").agg(F.max("score").alias("score"))  # an id with vectors of several lengths may be found with each
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), "neighbour", "score", "rank")


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K nearest of each embedding whose id is divisible by EVERY, among all."""
    return neighbours(C.table(spark, sf_dir, "embeddings"), every=EVERY)


ORACLE = f"""
select vec_id, neighbour, score, cast(rank as int) as rank from (
 select a.vec_id, b.vec_id as neighbour, round(list_inner_product(a.embedding::double[], b.embedding::double[]), {DECIMALS}) + 0.0 as score,
 row_number() over (partition by a.vec_id order by round(list_inner_product(a.embedding::double[], b.embedding::double[]), {DECIMALS}) desc, b.vec_id) as rank
 from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0)
where rank <= {K}
"""
