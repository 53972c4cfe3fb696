"""Streaming forms: incremental heterodyning, block means, live segments and deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import complex_rotate, phase_cycles
from ..operators.phase import BROADCAST_SOURCES, butterworth, filter_run


def stream_block_average(stream: DataFrame, key: list[str], stride: str, samples: int, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Tumbling block means behind a watermark; only blocks with ``samples`` rows at least; later rows are dropped."""
    agg = stream.withWatermark(ts, late).groupBy(*key, F.window(ts, stride)).agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.count(F.lit(1)).alias("n"))
    return agg.where(F.col("n") >= samples).select(*key, F.unix_micros("window.start").alias("start"), "re", "im", "n")


def stream_segments(stream: DataFrame, key: list[str], gap: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Contiguous live stretches as session windows."""
    agg = stream.withWatermark(ts, late).groupBy(*key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(*key, F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


def stream_dedupe(stream: DataFrame, key: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([*key, ts])


def stream_heterodyne(raw: DataFrame, sources: DataFrame, rate: float, resample: float, knee: float, order: int = 9, n_freq: int = 1, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Incremental heterodyne of raw (detector, ts, t, x): (source, detector, t, re, im).

    ``sources`` is a static list of BROADCAST_SOURCES rows at most; without a source the stream gives no row.
    The state of a (source, detector) is the forward filter, the open block and the last time; it
    lives in the checkpoint, so a restarted stream carries on where it stopped. Rows at or before
    the last time are dropped; a gap above two samples restarts filter and block.
    """
    size = round(rate / resample)
    b, a = butterworth(knee, rate, order)
    if sources.limit(BROADCAST_SOURCES + 1).count() > BROADCAST_SOURCES:
        raise ValueError(f"more than {BROADCAST_SOURCES} sources: run a stream for each part of the list")
    j = raw.withWatermark(ts, late).crossJoin(F.broadcast(sources))  # a static list of checked size
    re, im = complex_rotate("x", F.lit(0.0), phase_cycles("t", [f"f{i}" for i in range(n_freq)], "epoch"))
    turned = j.select("source", "detector", "t", re.alias("re"), im.alias("im"))
    n_state = 4 * len(b)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, open_t, open_z, last = None, [], [], None
        if state.exists:
            flat, open_t, open_re, open_im, last = state.get
            z = None if not len(flat) else (np.array(flat[: n_state // 2]) + 1j * np.array(flat[n_state // 2 :])).reshape(len(b), 2)
            open_t, open_z = list(open_t), list(np.array(open_re) + 1j * np.array(open_im))
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        if last is not None:
            rows = rows[rows["t"] > last]
        out = []
        t, x = rows["t"].to_numpy(), rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        before = np.concatenate([[last if last is not None else (t[0] if len(t) else 0)], t[:-1]]) if len(t) else t
        cuts = np.flatnonzero(t - before > 2 / rate)
        for lo, hi in zip([0, *cuts], [*cuts, len(t)], strict=True):
            if lo in cuts:
                z, open_t, open_z = None, [], []
            if lo == hi:
                continue
            y, z = filter_run(x[lo:hi], b, a, z)
            open_t += t[lo:hi].tolist()
            open_z += list(y)
            while len(open_t) >= size:
                out.append((*key, float(np.mean(open_t[:size])) + 0.5 / rate, float(np.mean(np.real(open_z[:size]))), float(np.mean(np.imag(open_z[:size])))))
                open_t, open_z = open_t[size:], open_z[size:]
        if len(t):
            last = float(t[-1])
        flat = [] if z is None else [*z.ravel().real.tolist(), *z.ravel().imag.tolist()]
        state.update((flat, open_t, [float(v.real) for v in open_z], [float(v.imag) for v in open_z], last))
        yield pd.DataFrame(out, columns=["source", "detector", "t", "re", "im"])

    kinds = f"source {turned.schema['source'].dataType.simpleString()}, detector {turned.schema['detector'].dataType.simpleString()}, t double, re double, im double"
    return turned.groupBy("source", "detector").applyInPandasWithState(
        step, kinds, "flat array<double>, open_t array<double>, open_re array<double>, open_im array<double>, last double", "append", GroupStateTimeout.NoTimeout
    )
