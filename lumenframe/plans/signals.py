"""Queries of the signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import fixtures as X
from lumenframe.functions import pcm
from lumenframe.operators import signal as S
from lumenframe.registry import query

N, U = 16, "user_id"
_FR = f"{X.SIGNAL}, ids as (select user_id, max(n) // {N // 2} as last from sig group by user_id), fr as (select user_id, frame, i from ids, lateral (select unnest(range(last + 1)) as frame), lateral (select unnest(range({N})) as i)), framed as (select fr.user_id, cast(frame as bigint) as frame, cast(i as int) as i, coalesce(v, 0.0) as v from fr left join sig on sig.user_id = fr.user_id and n = frame * {N // 2} + i)"
_WIN = f"{_FR}, win as (select user_id, frame, i, v * sin((i + 0.5::double) * (pi() / {N})) as v from framed)"
_DFT = f"{_WIN}, dft as (select user_id, frame, cast(k as int) as k, sum(v * cos((i * k % {N}) * (-2 * pi() / {N}))) as re, sum(v * sin((i * k % {N}) * (-2 * pi() / {N}))) as im from win, (select unnest(range({N})) as k) group by user_id, frame, k)"


def _frames(spark, d):
    return S.frames(X.signal(spark, d), U, N)


@query("sig_frames", f"with {_FR} select * from framed")
def sig_frames(spark, d):
    return _frames(spark, d)


@query("sig_window", f"with {_WIN} select user_id, frame, i, round(v, 6) as v from win")
def sig_window(spark, d):
    return S.sine_window(_frames(spark, d), N).withColumn("v", F.round("v", 6))


@query("sig_dft", f"with {_DFT} select user_id, frame, k, round(re, 4) + 0 as re, round(im, 4) + 0 as im from dft where k > 0 and k < {N // 2}")
def sig_dft(spark, d):
    z = S.dft(S.sine_window(_frames(spark, d), N), [U, "frame"], N)
    return z.where(f"k > 0 and k < {N // 2}").select(U, "frame", "k", (F.round("re", 4) + 0).alias("re"), (F.round("im", 4) + 0).alias("im"))


@query(
    "sig_dominant",
    f"with {_DFT}, p as (select user_id, frame, k as bin, re * re + im * im as p from dft where k > 0 and k < {N // 2}), h as (select user_id, frame, cast(bin // h as int) as k, p from p, (select unnest([1, 2, 3]) as h) where bin % h = 0), m as (select user_id, frame, k, round(avg(p), 6) as power from h group by user_id, frame, k) select user_id, frame, k, round(power, 2) as power from m qualify row_number() over (partition by user_id, frame order by power desc, k) = 1",
)
def sig_dominant(spark, d):
    z = S.dft(S.sine_window(_frames(spark, d), N), [U, "frame"], N)
    return S.dominant(z, [U, "frame"], N).withColumn("power", F.round("power", 2))


@query("fft_arrow", f"with {_DFT} select user_id, frame, k, round(sqrt(re * re + im * im), 4) as magnitude from dft")
def fft_arrow(spark, d):
    z = S.fft(S.sine_window(_frames(spark, d), N), [U, "frame"]).select(U, "frame", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return z.select(U, "frame", "k", F.round(F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")), 4).alias("magnitude"))


@query("stft_roundtrip", f"with {X.SIGNAL} select user_id, n, round(v, 5) as v from sig where n >= {N // 2}")
def stft_roundtrip(spark, d):
    z = S.fft(S.sine_window(_frames(spark, d), N), [U, "frame"])
    back = S.overlap_add(S.ifft(z, [U, "frame"]), U, N)
    return back.join(X.signal(spark, d).select(U, "n"), [U, "n"]).where(f"n >= {N // 2}").select(U, "n", F.round("v", 5).alias("v"))


@query("sig_moving_avg", f"with {X.SIGNAL} select user_id, n, round(avg(v) over (partition by user_id order by n rows between 5 preceding and 1 preceding), 6) as mean from sig")
def sig_moving_avg(spark, d):
    return S.moving_average(X.signal(spark, d), U, 5).select(U, "n", F.round("mean", 6).alias("mean"))


@query("sig_delay", f"with {X.SIGNAL} select user_id, n, coalesce(lag(v, 4) over (partition by user_id order by n), 0.0) as old from sig")
def sig_delay(spark, d):
    return S.delayed(X.signal(spark, d), U, 4).select(U, "n", "old")


@query("scene_sessions", f"with {X.SIGNAL} select user_id, n, cast(sum(case when v < 30 then 1 else 0 end) over (partition by user_id order by n) as bigint) as session from sig")
def scene_sessions(spark, d):
    return S.sessions(X.signal(spark, d), U, F.col("v") < 30).select(U, "n", "session")


_MU = "case when code >= 128 then 1 else -1 end * (((((255 - code) & 15) << 3) + 132 << (((255 - code) >> 4) & 7)) - 132)"
_AL = """case when xor(code, 85) & 128 = 128 then 1 else -1 end * case when (xor(code, 85) >> 4) & 7 = 0 then ((xor(code, 85) & 15) << 4) + 8
 else ((xor(code, 85) & 15) << 4) + 264 << ((xor(code, 85) >> 4) & 7) - 1 end"""


@query(
    "sig_pcm_convert",
    f"with {X.SIGNAL} select user_id, n, (q % 256) * 256 - 32768 as u8_s16, (q * 256) >> 8 as s24_s16, cast(trunc(greatest(-1, least(1, v / 256 - 1)) * 32767) as bigint) as f_s16, round((q % 256) * (2.0::double / 255) - 1, 9) as u8_f, q / 32768.0::double as s16_f, ((q % 256) - 128) * 16777216 as u8_s32, q * 65536 as s16_s32, cast({_MU} as bigint) as mulaw, cast({_AL} as bigint) as alaw from (select *, q % 256 as code from sig)",
)
def sig_pcm_convert(spark, d):
    q, v = F.col("q"), F.col("v")
    b = q % 256
    return X.signal(spark, d).select(
        U, "n", pcm.u8_to_s16(b).alias("u8_s16"), pcm.wide_to_s16(q * 256, 24).alias("s24_s16"), pcm.float_to_s16(v / 256 - 1).alias("f_s16"), F.round(pcm.u8_to_float(b), 9).alias("u8_f"), pcm.signed_to_float(q, 16).alias("s16_f"),
        pcm.u8_to_s32(b).alias("u8_s32"), pcm.s16_to_s32(q).alias("s16_s32"), pcm.by_table(b, pcm.mulaw_table()).alias("mulaw"), pcm.by_table(b, pcm.alaw_table()).alias("alaw"),
    )


@query("sig_envelope", "with n as (select unnest(range(2000)) as i) select cast(i as bigint) as i, round(case when i < 1200 then case when i < 100 then i / 100.0::double when i < 400 then (0.6::double * i + (300 - i)) / 300 else 0.6::double end when i < 1500 then 0.6::double * (300 - (i - 1200)) / 300 else 0.0 end, 9) as level, round(sin(2 * pi() * i * 440 / 48000), 9) as sine, round((i * 440 / 48000.0::double - floor(i * 440 / 48000.0::double)) * 2 - 1, 9) as saw, case when i % 1600 = 0 then 2 when i % 400 = 0 then 1 else 0 end as beat from n")
def sig_envelope(spark, d):
    i = F.col("id")
    return spark.range(2000).select(i.alias("i"), F.round(S.adsr(i, 100, 300, 0.6, 1200, 300), 9).alias("level"), F.round(S.sine(i, 440.0, 48000.0), 9).alias("sine"), F.round(S.saw(i, 440.0, 48000.0), 9).alias("saw"), S.metronome(i, 800, 120, 4).alias("beat"))


_NOTES = f"{X.SIGNAL}, notes as (select n * 40 as start, 50 + q % 50 as length, 200.0::double + q % 400 as hz, 0.1::double as gain from sig where user_id % 10 = 0)"


@query("sig_mix", f"with {_NOTES}, v as (select start, length, hz, gain, unnest(range(length + 20)) as i from notes) select start + i as n, round(sum(gain * case when i < length then case when i < 10 then i / 10.0::double when i < 30 then (0.5::double * i + (20 - i)) / 20 else 0.5::double end else 0.5::double * (20 - (i - length)) / 20 end * sin(2 * pi() * i * hz / 8000)), 6) + 0 as v from v group by start + i")
def sig_mix(spark, d):
    s = X.signal(spark, d).where("user_id % 10 = 0")
    notes = s.select((F.col("n") * 40).alias("start"), (50 + F.col("q") % 50).alias("length"), (200.0 + F.col("q") % 400).alias("hz"), F.lit(0.1).alias("gain"))
    return S.mixed(notes, 8000, 10, 20, 0.5, 20).select("n", (F.round("v", 6) + 0).alias("v"))


_IIR = f"""with recursive {X.SIGNAL}, k as (select ita, b0, 2 * (ita * ita - 1) * b0 as a1, -(1 - q * ita + ita * ita) * b0 as a2
 from (select ita, q, 1 / (1 + q * ita + ita * ita) as b0 from (select 1 / tan(pi() * 5.0::double / 50.0::double) as ita, sqrt(2.0::double) as q))),
f(user_id, n, x1, x2, l1, l2, h1, h2) as (select user_id, -1::bigint, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from sig where n = 0
 union all select f.user_id, sig.n, v, x1, b0 * (v + 2 * x1 + x2) + a1 * l1 + a2 * l2, l1, b0 * ita * ita * (v - 2 * x1 + x2) + a1 * h1 + a2 * h2, h1
 from f join sig on sig.user_id = f.user_id and sig.n = f.n + 1 cross join k)
select user_id, n, round(l1, 6) + 0 as low, round(h1, 6) + 0 as high from f where n >= 0"""


@query("sig_iir", _IIR)
def sig_iir(spark, d):
    s = X.signal(spark, d)
    low, high = S.biquad(s, U, 5.0, 50.0), S.biquad(s, U, 5.0, 50.0, True)
    return low.join(high.withColumnRenamed("v", "high"), [U, "n"]).select(U, "n", (F.round("v", 6) + 0).alias("low"), (F.round("high", 6) + 0).alias("high"))


@query("sig_piano")
def sig_piano(spark, d):
    from lumenframe.operators import piano

    s = X.signal(spark, d).where("user_id % 25 = 0 and n < 12")
    notes = s.select(F.col(U).alias("track"), F.col("n").alias("id"), (F.col("n") * 200).alias("start"), (100 + F.col("q") % 200).alias("length"), (1 + F.col("q") % 88).alias("note"))
    return piano.performed(notes, 4000).select("track", "n", F.round("v", 6).alias("v"))
