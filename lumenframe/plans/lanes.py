"""Queries of the lane operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import fixtures as X
from lumenframe.functions import lane as L
from lumenframe.registry import query

NAMES = ("a8", "b8", "a16", "b16")


def _q(name: str, sql: str, **cols):
    @query(name, f"with {X.LANES} select k, n, {sql} from lanes")
    def run(spark, d):
        return X.lanes(spark, d).select("k", "n", *(c(*map(F.col, NAMES)).alias(a) for a, c in cols.items()))


def _wrap(e: str, bits: int, signed: bool) -> str:
    low = f"(({e}) & {(1 << bits) - 1})"
    return f"case when {low} >= {1 << (bits - 1)} then {low} - {1 << bits} else {low} end" if signed else low


def _sat(e: str, bits: int, signed: bool) -> str:
    lo, hi = L.limits(bits, signed)
    return f"greatest({lo}, least({hi}, {e}))"


_q(
    "lane_saturate",
    f"{_sat('a8 + b8', 8, False)} as add_u8, {_sat('a8 - b8', 8, False)} as sub_u8, {_sat('a16 + b16', 16, True)} as add_s16, {_sat('a16 - b16', 16, True)} as sub_s16, least(abs(a16), 32767) as abs_s16, least(-a16, 32767) as neg_s16",
    add_u8=lambda a8, b8, a16, b16: L.saturate(a8 + b8, 8, False), sub_u8=lambda a8, b8, a16, b16: L.saturate(a8 - b8, 8, False), add_s16=lambda a8, b8, a16, b16: L.saturate(a16 + b16, 16, True), sub_s16=lambda a8, b8, a16, b16: L.saturate(a16 - b16, 16, True),
    abs_s16=lambda a8, b8, a16, b16: L.saturate(F.abs(a16), 16, True), neg_s16=lambda a8, b8, a16, b16: L.saturate(-a16, 16, True),
)
_q(
    "lane_wrap",
    f"{_wrap('a8 + b8', 8, False)} as add_u8, {_wrap('a8 - b8', 8, False)} as sub_u8, {_wrap('a16 + b16', 16, True)} as add_s16, {_wrap('a16 * b16', 16, True)} as mul_lo, {_wrap('a16', 8, True)} as narrow_s8, {_wrap('-a8', 8, False)} as neg_u8",
    add_u8=lambda a8, b8, a16, b16: L.wrap(a8 + b8, 8, False), sub_u8=lambda a8, b8, a16, b16: L.wrap(a8 - b8, 8, False), add_s16=lambda a8, b8, a16, b16: L.wrap(a16 + b16, 16, True), mul_lo=lambda a8, b8, a16, b16: L.wrap(a16 * b16, 16, True),
    narrow_s8=lambda a8, b8, a16, b16: L.wrap(a16, 8, True), neg_u8=lambda a8, b8, a16, b16: L.wrap(-a8, 8, False),
)
_q("lane_avg", "(a8 + b8 + 1) >> 1 as avg_u8, (a16 - b16) >> 1 as sub_div2, abs(a8 - b8) as abs_diff", avg_u8=lambda a8, b8, a16, b16: L.avg(a8, b8), sub_div2=lambda a8, b8, a16, b16: L.sub_div2(a16, b16), abs_diff=lambda a8, b8, a16, b16: F.abs(a8 - b8))
_q(
    "lane_mulhi",
    f"(a16 * b16) >> 16 as mul_hi, {_sat('(((a16 * b16) >> 14) + 1) >> 1', 16, True)} as mul_q15, a8 * b8 as mul_long, a16 + a8 * b8 as mul_acc, a16 - a8 * b8 as mul_sub",
    mul_hi=lambda a8, b8, a16, b16: L.mul_hi(a16, b16, 16), mul_q15=lambda a8, b8, a16, b16: L.mul_q15(a16, b16), mul_long=lambda a8, b8, a16, b16: a8 * b8, mul_acc=lambda a8, b8, a16, b16: a16 + a8 * b8, mul_sub=lambda a8, b8, a16, b16: a16 - a8 * b8,
)
_q(
    "lane_shift",
    f"{_wrap('a16 * 8', 16, True)} as left3, {_sat('a16 * 8', 16, True)} as left3_sat, a16 >> 3 as right3, a8 >> 2 as right2_u8, case when b8 % 9 - 4 >= 0 then {_wrap('a16 * (1 << greatest(0, b8 % 9 - 4))', 16, True)} else a16 >> greatest(0, 4 - b8 % 9) end as by_lane",
    left3=lambda a8, b8, a16, b16: L.shift_left(a16, 3, 16, True), left3_sat=lambda a8, b8, a16, b16: L.shift_left(a16, 3, 16, True, True), right3=lambda a8, b8, a16, b16: F.shiftright(a16, 3), right2_u8=lambda a8, b8, a16, b16: F.shiftright(a8, 2), by_lane=lambda a8, b8, a16, b16: L.shift_by(a16, b8 % 9 - 4, 16, True),
)
_q("lane_clz", "case when a8 = 0 then 8 else 8 - length(bin(a8)) end as clz8, case when a16 + 32768 = 0 then 16 else 16 - length(bin(a16 + 32768)) end as clz16", clz8=lambda a8, b8, a16, b16: L.clz(a8, 8), clz16=lambda a8, b8, a16, b16: L.clz(a16 + 32768, 16))
_q(
    "lane_compare",
    "case when a8 > b8 then 255 else 0 end as gt, case when a16 <= b16 then -1 else 0 end as le, case when a8 = b8 then 255 else 0 end as eq, case when a8 > b8 then a16 else b16 end as picked, least(a16, b16) as lo, greatest(a16, b16) as hi".replace(" then 255 else 0 end", " then 255::bigint else 0 end").replace(" then -1 else", " then (-1)::bigint else"),
    gt=lambda a8, b8, a16, b16: L.mask_of(a8 > b8, 8, False), le=lambda a8, b8, a16, b16: L.mask_of(a16 <= b16, 16, True), eq=lambda a8, b8, a16, b16: L.mask_of(a8 == b8, 8, False), picked=lambda a8, b8, a16, b16: L.select(L.mask_of(a8 > b8, 8, False), a16, b16), lo=lambda a8, b8, a16, b16: F.least(a16, b16), hi=lambda a8, b8, a16, b16: F.greatest(a16, b16),
)
_q("lane_bits", "a8 & b8 as v_and, a8 | b8 as v_or, xor(a8, b8) as v_xor, a8 & ~b8 as v_andnot, a8 | ~b8 as v_ornot, ~a8 as v_not, case when a8 > 127 then a8 - 256 else a8 end as as_signed", v_and=lambda a8, b8, a16, b16: L.bits_of(a8, b8, "and"), v_or=lambda a8, b8, a16, b16: L.bits_of(a8, b8, "or"), v_xor=lambda a8, b8, a16, b16: L.bits_of(a8, b8, "xor"), v_andnot=lambda a8, b8, a16, b16: L.bits_of(a8, b8, "and_not"), v_ornot=lambda a8, b8, a16, b16: L.bits_of(a8, b8, "or_not"), v_not=lambda a8, b8, a16, b16: F.bitwise_not(a8), as_signed=lambda a8, b8, a16, b16: L.wrap(a8, 8, True))
_q("lane_narrow", f"{_sat('a16', 8, True)} as to_s8, {_sat('a16', 8, False)} as to_u8, a16 & 255 as low", to_s8=lambda a8, b8, a16, b16: L.saturate(a16, 8, True), to_u8=lambda a8, b8, a16, b16: L.saturate(a16, 8, False), low=lambda a8, b8, a16, b16: L.wrap(a16, 8, False))
_q("lane_float", "cast(trunc(a16 / 7.0::double) as bigint) as to_int, cast(round(a16 / 4.0::double) as bigint) as rounded, round(1 / sqrt((a8 + 1)::double), 9) as rsqrt, round(1 / (a8 + 1)::double, 9) as reciprocal, round(a16 / (b8 + 1)::double, 9) as quotient", to_int=lambda a8, b8, a16, b16: (a16 / 7.0).cast("bigint"), rounded=lambda a8, b8, a16, b16: F.round(a16 / 4.0).cast("bigint"), rsqrt=lambda a8, b8, a16, b16: F.round(1 / F.sqrt(a8 + 1), 9), reciprocal=lambda a8, b8, a16, b16: F.round(1 / (a8 + 1), 9), quotient=lambda a8, b8, a16, b16: F.round(a16 / (b8 + 1), 9))
_TABLE = [(i * 37 + 11) % 251 for i in range(200)]
_q("lane_lut", f"coalesce(case when a8 < 200 then ({_TABLE}::bigint[])[a8 + 1] end, 0) as lut, ({_TABLE[:16]}::bigint[])[b8 % 16 + 1] as lut16", lut=lambda a8, b8, a16, b16: L.look_up(_TABLE, a8), lut16=lambda a8, b8, a16, b16: L.look_up(_TABLE[:16], b8 % 16))

_ROWS = f"with {X.LANES}, v as (select k, list(a8 order by n) as a, list(b8 order by n) as b from lanes group by k)"


def _vectors(spark, d):
    # at most 7 lines share a line number, so that an order's lanes make a short vector
    s = F.array_sort(F.collect_list(F.struct("n", "a8", "b8")))
    v = X.lanes(spark, d).groupBy("k").agg(s.alias("s"))
    return v.select("k", F.transform("s", lambda x: x["a8"]).alias("a"), F.transform("s", lambda x: x["b8"]).alias("b"))


@query("lane_sad", f"{_ROWS} select k, cast(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) as bigint) as sad from v")
def lane_sad(spark, d):
    return _vectors(spark, d).select("k", L.sad(F.col("a"), F.col("b")).alias("sad"))


@query("lane_interleave", f"{_ROWS} select k, list_aggregate(flatten(list_transform(list_zip(a, b), lambda p: [p[1], p[2]])), 'string_agg', ',') as ab, coalesce(list_aggregate(list_transform(list_filter(list_zip(a, range(len(a))), lambda p: p[2] % 2 = 1), lambda p: p[1]), 'string_agg', ','), '') as odd from v")
def lane_interleave(spark, d):
    v = _vectors(spark, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return v.select("k", text(L.interleave(F.col("a"), F.col("b"))).alias("ab"), text(L.deinterleave(F.col("a"), 2, 1)).alias("odd"))


@query("lane_hadd", f"with {X.LANES} select k, n, cast(sum(a8) over (partition by k, (n - 1) // 2) as bigint) as pair from lanes")
def lane_hadd(spark, d):
    from pyspark.sql.window import Window

    return X.lanes(spark, d).select("k", "n", F.sum("a8").over(Window.partitionBy("k", F.floor((F.col("n") - 1) / 2))).alias("pair"))
