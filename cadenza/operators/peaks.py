"""Peak picking over ordered samples: smoothing, moving median, local maxima, refractory merge."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import ordered


def moving_median(keys: Sequence[str], order: Sequence[str | Column], value: str, reach: int) -> Column:
    """Median of the rows at most `reach` away; fewer at the ends."""
    return F.percentile(value, 0.5).over(ordered(keys, order).rowsBetween(-reach, reach))


def smoothed(keys: Sequence[str], order: Sequence[str | Column], value: str) -> Column:
    """Mean of three with zeros outside the ends."""
    w = ordered(keys, order)
    return (F.coalesce(F.lag(value).over(w), F.lit(0.0)) + F.col(value) + F.coalesce(F.lead(value).over(w), F.lit(0.0))) / 3


def is_peak(keys: Sequence[str], order: Sequence[str | Column], value: str, threshold: Column) -> Column:
    """Above the threshold and not below either neighbour; rows at the ends are none."""
    w = ordered(keys, order)
    x = F.col(value)
    return F.coalesce((x > threshold) & (x >= F.lag(value).over(w)) & (x >= F.lead(value).over(w)), F.lit(False))


def refractory(df: DataFrame, keys: Sequence[str], place: str, strength: str, gap: float) -> DataFrame:
    """Peaks at least `gap` apart: a nearer one replaces the kept one if it is stronger, and the place moves with it.

    Sequential by nature. Keys are sorted, not gathered: the state is one row, so a long key streams through its task."""
    columns = [*keys, place, strength]
    schema = df.select(*columns).schema
    dealt = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, place, strength)

    def merged(batches):
        key, kept = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                own = row[: len(keys)]
                if own != key:
                    if kept is not None:
                        out.append((*key, *kept))
                    key, kept = own, row[len(keys) :]
                elif row[-2] - kept[0] < gap:
                    if row[-1] > kept[1]:
                        kept = row[len(keys) :]
                else:
                    out.append((*key, *kept))
                    kept = row[len(keys) :]
            yield pd.DataFrame(out, columns=columns)
        if kept is not None:
            yield pd.DataFrame([(*key, *kept)], columns=columns)

    return dealt.mapInPandas(merged, schema)


def onsets(samples: np.ndarray, rate: int, hop: int = 512, size: int = 2048) -> list[tuple[float, float]]:
    """(seconds, strength) of note beginnings: log-spectral flux between 60 and 4500 Hz, smoothed, against a moving median.

    Fixed values: magnitudes are weighed 200 times before the logarithm; a peak is above the median of 81 values plus 0.35 of the
    spread between median and 95th percentile, no less than its neighbours, and followed (two frames later) by a loudness above 0.03
    of the 98th percentile; peaks are at least 0.07 seconds apart, and a nearer one that is stronger takes the place of the last."""
    if len(samples) < size + 2 * hop:
        return []
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    heard = np.fft.rfftfreq(size, 1 / rate)
    loud = np.log1p(200 * np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))[:, (heard > 60) & (heard < 4500)])
    # the flux of frame k + 1 stands at k
    flux = np.convolve(np.maximum(np.diff(loud, axis=0), 0).sum(axis=1), np.full(3, 1 / 3), "same")
    padded = np.pad(flux, 40, constant_values=np.nan)
    base = np.nanmedian(np.lib.stride_tricks.sliding_window_view(padded, 81), axis=1)
    limit = base + 0.35 * (np.percentile(flux, 95) - np.median(flux)) + 1e-6
    level = np.sqrt((frames.astype(np.float64) ** 2).mean(axis=1))
    later = level[np.minimum(np.arange(len(flux)) + 3, len(level) - 1)]
    inner = np.zeros(len(flux), bool)
    inner[1:-1] = (flux[1:-1] >= flux[:-2]) & (flux[1:-1] >= flux[2:])
    apart = int(0.07 * rate / hop)
    kept: list[int] = []
    for k in np.flatnonzero(inner & (flux > limit) & (later > 0.03 * np.percentile(level, 98))):
        if not kept or k - kept[-1] >= apart:
            kept.append(int(k))
        elif flux[k] > flux[kept[-1]]:
            kept[-1] = int(k)
    return [(((k + 1) * hop + size // 2) / rate, float(flux[k])) for k in kept]
