"""Empirical mode decomposition: sifting with cubic-spline envelopes, and ensembles with noise whose series are sifted together.

A mode is what is left of a series after the mean of its upper and lower envelope, splines through the mirrored maxima and minima, has been taken away
until that mean is small. Modes come off one after another, the quickest first, until too few extrema are left; they add up to the series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship
from .sliding import LastOf, slide

SIFTS = 50
SMALL = 0.05
MODES = 12
TOGETHER = 1 << 16


def spline(at: np.ndarray, values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (at, values), by one tridiagonal solve for its second derivatives."""
    n = len(at)
    if n == 1:
        return np.full(len(where), values[0])
    h = np.diff(at)
    slope = np.diff(values) / h
    m = np.zeros(n)
    if n > 2:
        main, right = (2 * (h[:-1] + h[1:])).tolist(), (6 * np.diff(slope)).tolist()
        side = h[1:-1].tolist()
        for i in range(1, n - 2):  # elimination, then back substitution
            f = side[i - 1] / main[i - 1]
            main[i] -= f * side[i - 1]
            right[i] -= f * right[i - 1]
        inner = [0.0] * (n - 2)
        inner[-1] = right[-1] / main[-1]
        for i in range(n - 4, -1, -1):
            inner[i] = (right[i] - side[i] * inner[i + 1]) / main[i]
        m[1:-1] = inner
    k = np.clip(np.searchsorted(at, where, "right") - 1, 0, n - 2)
    a, b = at[k + 1] - where, where - at[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (values[k] / h[k] - m[k] * h[k] / 6) * a + (values[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def extrema(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the maxima and of the minima; of a plateau its middle."""
    turns = np.flatnonzero(np.diff(x) != 0)
    if not len(turns):
        return np.zeros(0, int), np.zeros(0, int)
    up = x[turns + 1] > x[turns]
    change = np.flatnonzero(up[1:] != up[:-1])
    middle = (turns[change] + 1 + turns[change + 1]) // 2
    return middle[up[change]], middle[~up[change]]


def _envelope(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A spline through the extrema, the two outermost of which are mirrored at each end."""
    n = len(x)
    left, right = -at[1::-1][: len(at)], 2 * (n - 1) - at[-1:-3:-1]
    left, right = left[left < at[0]], right[right > at[-1]]
    places = np.concatenate([np.sort(left), at, np.sort(right)])
    return spline(places.astype(float), x[np.concatenate([at[: len(left)][::-1], at, at[len(at) - len(right) :][::-1]])], np.arange(n, dtype=float))


def first_mode(x: np.ndarray) -> np.ndarray | None:
    """The quickest mode; None for a series with fewer than two maxima or minima."""
    h = np.asarray(x, float).copy()
    for sift in range(SIFTS):
        high, low = extrema(h)
        if len(high) < 2 or len(low) < 2:
            return h if sift else None
        mean = (_envelope(h, high) + _envelope(h, low)) / 2
        h = h - mean
        if (mean * mean).sum() <= SMALL**2 * (h * h).sum():
            break
    return h


def _envelopes(h: np.ndarray, of: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """_envelope of series laid end to end. of: each value's series; at: their extrema, two or more each."""
    count = np.bincount(of[at], minlength=len(lengths))
    ends = np.cumsum(count)
    first, last, shift = ends - count, ends - 1, 4 * np.arange(len(lengths))
    places, values = np.empty(len(at) + 4 * len(lengths)), np.empty(len(at) + 4 * len(lengths))
    local = (at - starts[of[at]]).astype(float)
    own = np.arange(len(at)) + 4 * of[at] + 2
    places[own], values[own] = local, h[at]
    for knot, source, turn in ((0, first + 1, 0), (1, first, 0), (2, last, 2), (3, last - 1, 2)):  # two mirrored knots at each end
        k = (first if knot < 2 else ends) + shift + knot
        places[k], values[k] = turn * (lengths - 1.0) - local[source], h[at[source]]
    # the splines' second derivatives: one tridiagonal system, 0 at each series' ends, by cyclic reduction; the diagonal outweighs the sides
    step, outer = np.diff(places), np.zeros(len(places), bool)
    outer[first + shift] = outer[ends + shift + 3] = True
    step[(ends + shift + 3)[:-1]] = 1.0  # between two series
    slope = np.diff(values) / step
    main, m, up, down = np.ones(len(places)), np.zeros(len(places)), np.zeros(len(places)), np.zeros(len(places))
    main[1:-1], m[1:-1] = 2 * (step[:-1] + step[1:]), 6 * np.diff(slope)
    main[outer], m[outer] = 1.0, 0.0
    down[:-1] = np.where(outer[:-1] | outer[1:], 0.0, step)
    up[1:] = down[:-1]
    far = 1
    while far < len(places) and np.abs(up / main).max() > 1e-20:
        p, q = np.zeros(len(places)), np.zeros(len(places))
        p[far:], q[:-far] = -up[far:] / main[:-far], -down[:-far] / main[far:]
        next_main, next_m, next_up, next_down = main.copy(), m.copy(), np.zeros(len(places)), np.zeros(len(places))
        next_main[far:] += p[far:] * down[:-far]
        next_main[:-far] += q[:-far] * up[far:]
        next_m[far:] += p[far:] * m[:-far]
        next_m[:-far] += q[:-far] * m[far:]
        next_up[far:], next_down[:-far] = p[far:] * up[:-far], q[:-far] * down[far:]
        main, m, up, down, far = next_main, next_m, next_up, next_down, 2 * far
    m /= main
    seen = np.zeros(len(h), np.int64)
    seen[at] = 1
    k = np.cumsum(seen) + 4 * of + 1
    where = np.arange(len(h)) - starts[of]
    a, b = places[k + 1] - where, where - places[k]
    left, right = values[:-1] / step - m[:-1] * step / 6, values[1:] / step - m[1:] * step / 6
    return (m[:-1] / (6 * step))[k] * a**3 + (m[1:] / (6 * step))[k] * b**3 + left[k] * a + right[k] * b


def first_modes(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first_mode of many series laid end to end, sifted together; zeros for a series that has none."""
    out, h, lengths = np.zeros(len(x)), np.asarray(x, float).copy(), np.asarray(lengths)
    place = np.arange(len(x))  # where the values that are still sifted lie in x

    def only(stay):
        return h[stay[of]], place[stay[of]], lengths[stay]

    for sift in range(SIFTS):
        while True:
            of, starts = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
            d = np.diff(h)
            d[of[1:] != of[:-1]] = 0
            turns = np.flatnonzero(d)
            up = d[turns] > 0
            change = np.flatnonzero((up[1:] != up[:-1]) & (of[turns[1:]] == of[turns[:-1]]))
            middle = (turns[change] + 1 + turns[change + 1]) // 2
            high, low = middle[up[change]], middle[~up[change]]
            enough = (np.bincount(of[high], minlength=len(lengths)) >= 2) & (np.bincount(of[low], minlength=len(lengths)) >= 2)
            if enough.all():
                break
            if sift:
                out[place[~enough[of]]] = h[~enough[of]]
            h, place, lengths = only(enough)
        if not len(lengths):
            return out
        mean = (_envelopes(h, of, high, starts, lengths) + _envelopes(h, of, low, starts, lengths)) / 2
        h = h - mean
        moved = np.add.reduceat(mean * mean, starts) > SMALL**2 * np.add.reduceat(h * h, starts)
        out[place] = h
        h, place, lengths = only(moved)
    return out


def decompose(x: np.ndarray) -> list[np.ndarray]:
    """The modes, quickest first, and the rest."""
    left, out = np.asarray(x, float).copy(), []
    while len(out) < MODES and (mode := first_mode(left)) is not None:
        out.append(mode)
        left = left - mode
    return [*out, left]


def without_first_mode(x: np.ndarray) -> np.ndarray:
    mode = first_mode(x)
    return np.asarray(x, float).copy() if mode is None else x - mode


def emd_denoise(panel: DataFrame, column: str) -> DataFrame:
    """(symbol, trade_date, column, denoised): each name's whole series without its first mode. It looks ahead: for comparison only. Nulls stay null
    and are skipped."""
    ship(panel.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trade_date")
        there = g[column].notna().to_numpy()
        out = np.full(len(g), np.nan)
        if there.any():
            out[there] = without_first_mode(g[column].to_numpy(float)[there])
        return g.assign(denoised=pd.Series(out, g.index).where(there, None))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select("symbol", "trade_date", column).schema)
    return panel.select("symbol", "trade_date", column).groupBy("symbol").applyInPandas(run, f"{kinds}, denoised double")


def ceemdan_denoise(panel: DataFrame, column: str, *, trials: int = 50, noise: float = 0.2, seed: int = 7) -> DataFrame:
    """As emd_denoise, with the first mode of the complete ensemble: the mean of the first modes of `trials` copies of the series, each with its own white
    noise of `noise` times the series' deviation. A task sifts the copies of some names together, TOGETHER values or one name at a time, and only means leave it."""
    ship(panel.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in panel.select("symbol", "trade_date", column).schema}
    rows = panel.select("symbol", "trade_date", column).where(F.col(column).isNotNull())
    series = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("trade_date", F.col(column).alias("v")))).alias("rows"))  # one row a session

    def ensemble(found):
        lengths = np.array([len(x) for x in found])
        scale = [noise * x.std() for x in found]
        white = [np.random.default_rng([seed, trial]).standard_normal(lengths.max()) for trial in range(trials)]
        copies = np.concatenate([x + s * w[: len(x)] for w in white for x, s in zip(found, scale, strict=True)])
        return np.concatenate(found) - first_modes(copies, np.tile(lengths, trials)).reshape(trials, -1).mean(0)

    def run(batches):
        for b in batches:
            ends = np.cumsum(np.diff(b.column(2).offsets.to_numpy()))
            found, out, held = np.split(b.column(2).flatten().to_numpy(zero_copy_only=False), ends[:-1]), [], []
            for i, x in enumerate(found):
                held.append(x)
                if trials * sum(map(len, held)) >= TOGETHER or i == len(found) - 1:
                    out.append(ensemble(held))
                    held = []
            if out:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["symbol", "rows", "denoised"])

    shape = f"symbol {kinds['symbol']}, rows array<struct<trade_date: {kinds['trade_date']}, v: {kinds[column]}>>, denoised array<double>"
    done = series.select("symbol", "rows", F.col("rows.v").cast("array<double>").alias("x")).mapInArrow(run, shape)
    each = done.select("symbol", F.explode(F.arrays_zip("rows", "denoised")).alias("e"))
    return each.select("symbol", F.col("e.rows.trade_date").alias("trade_date"), F.col("e.rows.v").alias(column), F.col("e.denoised").alias("denoised"))


def causal_emd(panel: DataFrame, column: str, *, window: int = 252) -> DataFrame:
    """(symbol, trade_date, column, denoised): the last value of the window that ends at each row without its first mode."""
    last = lambda windows: np.array([without_first_mode(w)[-1] for w in windows])
    return slide(panel.select("symbol", "trade_date", column), {"denoised": (column, lambda: LastOf(last, window))})
