"""Spectra: blocks of a padded series, their power, and averages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import AVERAGES
from .series import zero_pad


def tukey(n: int, alpha: float) -> np.ndarray:
    x, edge = np.arange(n), alpha * (n - 1) / 2
    w = np.ones(n)
    if edge > 0:
        near = np.minimum(x, n - 1 - x)
        w = np.where(near < edge, 0.5 * (1 + np.cos(np.pi * (near / edge - 1))), 1.0)
    return w


def blocks(df: DataFrame, step, size: int, hop: int, key: list[str]) -> DataFrame:
    """Samples of an even grid dealt to overlapping blocks: (key, block, i, re, im); whole blocks only."""
    span = df.groupBy(*key).agg(F.min("t").alias("_a"), F.count(F.lit(1)).alias("_n"))
    rows = df.join(span, key).withColumn("_i", F.round((F.col("t") - F.col("_a")) / step).cast("long"))
    last = F.least(F.floor(F.col("_i") / hop), F.floor((F.col("_n") - size) / hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / hop))
    cut = rows.where(first <= last).withColumn("block", F.explode(F.sequence(first, last)))
    return cut.select(*key, "block", (F.col("_i") - F.col("block") * hop).alias("i"), "re", "im").where((F.col("i") >= 0) & (F.col("i") < size))


def spectrogram(df: DataFrame, step, size: int, key: list[str], overlap: float = 0.5, alpha: float = 0.1, unit: float = 1.0, kind: str = "long", band: float | None = None) -> DataFrame:
    """Two-sided power of windowed blocks: (key, block, f, power). ``unit``: seconds in a unit of t.

    Blocks shuffle by (series, block), so a long series spreads over tasks; the transform is numpy.
    """
    hop = max(1, round(size * (1 - overlap)))
    dt = step * unit
    w = tukey(size, alpha)
    cut = blocks(zero_pad(df.select(*key, "t", "re", "im"), step, key), step, size, hop, key)
    names = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def power(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(size, complex)
        x[pdf["i"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        p = np.abs(np.fft.fft(x * w)) ** 2 * dt / (w * w).sum()
        f = np.fft.fftfreq(size, dt)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * size for k in key} | {"block": pdf["block"].iloc[0], "f": f, "power": p})
        return out if band is None else out[np.abs(f) <= band / 2]

    return cut.groupBy(*key, "block").applyInPandas(power, f"{names}, block long, f double, power double")


def dft_power(df: DataFrame, key: list[str], size: int, dt: float) -> DataFrame:
    """The same for short blocks in columns alone: sums of cosines and sines by frequency; (key, k, power). Samples: (key, i, re, im)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    rows = df.select("*", k.alias("k"))
    a = F.pmod(F.col("k") * F.col("i"), F.lit(size)) * (2 * math.pi / size)
    re = F.sum(F.col("re") * F.cos(a) + F.col("im") * F.sin(a))
    im = F.sum(F.col("im") * F.cos(a) - F.col("re") * F.sin(a))
    return rows.groupBy(*key, "k").agg((dt / size * (re * re + im * im)).alias("power"))


def average_power(spec: DataFrame, key: list[str], how: str = "median") -> DataFrame:
    """Average over blocks by frequency; how: a name of the registry of averages."""
    build = AVERAGES[how] if isinstance(how, str) else how
    return spec.groupBy(*key, "f").agg(build(F.col("power")).alias("power"))


def power_spectrum(df: DataFrame, step, size: int, key: list[str], how: str = "median", asd: bool = False, **more) -> DataFrame:
    out = average_power(spectrogram(df, step, size, key, **more), key, how).orderBy(*key, "f")
    return out.withColumn("power", F.sqrt("power")) if asd else out


#: Samples of a series that a periodogram transforms in one piece.
LONGEST = 1 << 24


def periodogram(df: DataFrame, step, key: list[str], unit: float = 1.0) -> DataFrame:
    """One block over the whole padded series, no window: (key, f, power) in order of frequency.

    A series is one transform, so it has to fit a task: beyond ``LONGEST`` samples it is an error
    (use :func:`spectrogram`). Series travel as arrays, many in a batch.
    """
    padded = zero_pad(df.select(*key, "t", "re", "im"), step, key)
    dt = step * unit
    packed = padded.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("t", "re", "im"))).alias("_s"))
    n = F.size("_s")
    arrays = packed.where(F.when(n > LONGEST, F.raise_error(F.lit("a series is too long for one periodogram")).cast("boolean")).otherwise(True))
    arrays = arrays.select(*key, F.col("_s.re").alias("re"), F.col("_s.im").alias("im"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.select(*key).schema)

    def power(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            re, im = batch.column(len(key)), batch.column(len(key) + 1)
            spectra = []
            for k in range(batch.num_rows):
                x = re[k].values.to_numpy() + 1j * im[k].values.to_numpy()
                order = np.argsort(np.fft.fftfreq(len(x)), kind="stable")
                spectra.append((np.fft.fftfreq(len(x), dt)[order], (np.abs(np.fft.fft(x)) ** 2 * dt / len(x))[order]))
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f, _ in spectra]))
            columns = [batch.column(i).take(at) for i in range(len(key))] + [pa.array(np.concatenate([s[i] for s in spectra] or [np.zeros(0)])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*key, "f", "power"])

    return arrays.mapInArrow(power, f"{names}, f double, power double")


def power_by_source(spec: DataFrame, sources: DataFrame, how: str = "median", freq: str = "median", asd: bool = True) -> DataFrame:
    """(detector, f = F0 * freqfactor, power): spectra of each series reduced over blocks, then over frequency, in order of f.

    A series whose source isn't among ``sources`` keeps its row with a null f.
    """
    first = average_power(spec, ["source", "detector", "freqfactor"], how)
    one: Column = AVERAGES[freq](F.col("power"))
    out = first.groupBy("source", "detector", "freqfactor").agg(one.alias("power")).join(sources.select("source", "f0"), "source", "left")
    power = F.sqrt("power") if asd else F.col("power")
    return out.select("source", "detector", "freqfactor", (F.col("f0") * F.col("freqfactor")).alias("f"), power.alias("power")).orderBy("f", "detector")
