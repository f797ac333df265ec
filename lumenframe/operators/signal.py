"""Signals: framing, windows, Fourier transforms, filters, envelopes and synthesis.

A signal is a table (key, n, v) of samples. Frames and transforms by join and
aggregation stay in the JVM; whole-array FFTs and recursive filters, which an
order defines, run on Arrow batches.
"""

from __future__ import annotations

from math import pi, sqrt, tan

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def frames(signal: DataFrame, key: str, size: int) -> DataFrame:
    """(key, frame, i, v): frames of a size, each half a frame on, zero-padded at the end.

    Each sample knows its frames, so that no range join is needed.
    """
    hop = size // 2
    f = F.floor(F.col("n") / hop)
    own = signal.select(key, F.explode(F.filter(F.array(f - 1, f), lambda k: k >= 0)).alias("frame"), "n", "v")
    filled = own.select(key, "frame", (F.col("n") - F.col("frame") * hop).cast("int").alias("i"), "v")
    last = filled.groupBy(key, "frame").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return last.select(key, "frame", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i"), "m").select(key, "frame", "i", F.coalesce(F.try_element_at("m", F.col("i")), F.lit(0.0)).alias("v"))


def sine_window(framed: DataFrame, size: int) -> DataFrame:
    """Weight sin((i + 1/2) pi / size); its squares add to 1 at half-frame steps."""
    return framed.withColumn("v", F.col("v") * F.sin((F.col("i") + 0.5) * (pi / size)))


def dft(framed: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, k, re, im): discrete Fourier transform by aggregation, for short frames."""
    k = framed.select(*keys, "i", "v", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    angle = (F.col("i") * F.col("k") % size) * (-2 * pi / size)
    return k.groupBy(*keys, "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))


def _arrays(framed: DataFrame, keys: list[str]) -> DataFrame:
    s = F.array_sort(F.collect_list(F.struct("i", "v")))
    return framed.groupBy(*keys).agg(F.transform(s, lambda x: x["v"]).alias("x"))


def fft(framed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, re, im): spectra of whole frames as arrays, by the fast transform."""
    arrays = _arrays(framed, keys)

    def run(batches):
        for b in batches:
            z = [np.fft.fft(np.array(x, float)) for x in b.column("x").to_pylist()]
            cols = [b.column(k) for k in keys] + [pa.array([v.real.tolist() for v in z], pa.list_(pa.float64())), pa.array([v.imag.tolist() for v in z], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "re", "im"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema if f.name in keys)
    return arrays.mapInArrow(run, f"{head}, re array<double>, im array<double>")


def ifft(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, v): real parts of the inverse transforms."""

    def run(batches):
        for b in batches:
            x = [np.fft.ifft(np.array(r) + 1j * np.array(m)).real.tolist() for r, m in zip(b.column("re").to_pylist(), b.column("im").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(x, pa.list_(pa.float64()))], names=[*keys, "x"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spectra.schema if f.name in keys)
    return spectra.mapInArrow(run, f"{head}, x array<double>").select(*keys, F.posexplode("x").alias("i", "v"))


def overlap_add(framed: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, v): windowed frames added up again."""
    w = sine_window(framed, size)
    return w.groupBy(key, (F.col("frame") * (size // 2) + F.col("i")).alias("n")).agg(F.sum("v").alias("v"))


def dominant(spectrum: DataFrame, keys: list[str], size: int, harmonics: int = 3) -> DataFrame:
    """(keys, k, power): the bin whose harmonics have the largest mean power, the lowest of equals."""
    p = spectrum.where((F.col("k") > 0) & (F.col("k") < size / 2)).select(*keys, "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    base = p.select(*keys, "p", F.col("k").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("h")).where("at % h = 0").select(*keys, "p", (F.col("at") / F.col("h")).cast("int").alias("k"))
    mean = base.groupBy(*keys, "k").agg(F.round(F.avg("p"), 6).alias("power"))
    return mean.groupBy(*keys).agg(F.min(F.struct((-F.col("power")).alias("q"), "k")).alias("b")).select(*keys, F.col("b.k").alias("k"), (-F.col("b.q")).alias("power"))


def delayed(signal: DataFrame, key: str, size: int) -> DataFrame:
    """A delay line: each sample with the one size places before, or 0."""
    return signal.withColumn("old", F.coalesce(F.lag("v", size).over(Window.partitionBy(key).orderBy("n")), F.lit(0.0)))


def moving_average(signal: DataFrame, key: str, n: int) -> DataFrame:
    """Each sample with the mean of up to n samples before it."""
    return signal.withColumn("mean", F.avg("v").over(Window.partitionBy(key).orderBy("n").rowsBetween(-n, -1)))


def sessions(signal: DataFrame, key: str, cut: Column) -> DataFrame:
    """Number the runs of a signal that cuts part."""
    return signal.withColumn("session", F.sum(F.when(cut, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("n")))


def biquad(signal: DataFrame, key: str, hz: float, rate: float, high: bool = False) -> DataFrame:
    """Second-order Butterworth low or high pass: each sample needs the filtered ones before it."""
    ita, q = 1 / tan(pi * hz / rate), sqrt(2)
    b0 = 1 / (1 + q * ita + ita * ita)
    a1, a2 = 2 * (ita * ita - 1) * b0, -(1 - q * ita + ita * ita) * b0
    g, mid = (b0 * ita * ita, -2.0) if high else (b0, 2.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for x in pdf["v"].to_numpy():
            y = g * (x + mid * x1 + x2) + a1 * y1 + a2 * y2
            x1, x2, y1, y2 = x, x1, y, y1
            out.append(y)
        return pd.DataFrame({key: pdf[key], "n": pdf["n"], "v": out})

    return signal.select(key, "n", "v").groupBy(key).applyInPandas(run, f"{key} long, n long, v double")


def adsr(i: Column, attack: int, decay: int, sustain: float, release_at: int, release: int) -> Column:
    """Envelope at sample i of a note that is let go at release_at; the decay runs from the note's start."""
    held = lambda k: F.when(k < attack, k / attack).when(k < attack + decay, (sustain * k + (decay - k)) / decay).otherwise(F.lit(sustain))
    level = held(F.lit(release_at))
    return F.when(i < release_at, held(i)).when(i < release_at + release, level * (release - (i - release_at)) / release).otherwise(F.lit(0.0))


def sine(n: Column, hz: float | Column, rate: float) -> Column:
    return F.sin(2 * pi * n * hz / rate)


def saw(n: Column, hz: float | Column, rate: float) -> Column:
    return F.pmod(n * hz / rate, F.lit(1.0)) * 2 - 1


def metronome(n: Column, rate: int, bpm: int, beats: int) -> Column:
    """2 at a strong beat, 1 at a weak one, else 0."""
    step = rate * 60 // bpm
    return F.when(n % (step * beats) == 0, 2).when(n % step == 0, 1).otherwise(0)


def mixed(notes: DataFrame, rate: int, attack: int, decay: int, sustain: float, release: int) -> DataFrame:
    """(n, v): notes (start, length, hz, gain), in samples, as sine voices with envelopes, added up."""
    voice = notes.select("start", "length", "hz", "gain", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") + release - 1)).alias("i"))
    attack_ = F.when(F.col("i") < attack, F.col("i") / attack).when(F.col("i") < attack + decay, (sustain * F.col("i") + (decay - F.col("i"))) / decay).otherwise(F.lit(sustain))
    env = F.when(F.col("i") < F.col("length"), attack_).otherwise(sustain * (release - (F.col("i") - F.col("length"))) / release)
    return voice.groupBy((F.col("start") + F.col("i")).alias("n")).agg(F.sum(F.col("gain") * env * sine(F.col("i"), F.col("hz"), rate)).alias("v"))
