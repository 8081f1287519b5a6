"""Wavelet shrinkage by a periodised orthogonal filter bank, as two small matrices for any window length.

The Daubechies filter of given order follows from its definition: half-band roots inside the unit circle. Analysis takes every second value of the
circular convolution, an odd length being extended by its last value; synthesis is the transpose, and cuts what was extended. Both are linear, so a
window's coefficients are one matrix product, and windows are worked on in batches.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .sliding import LastOf, slide

WINDOW = 252
ORDER = 4
MAD = 0.6745


@lru_cache
def scaling_filter(order: int) -> np.ndarray:
    """The low-pass synthesis filter with `order` vanishing moments, of 2 * order taps that sum to the root of 2."""
    half = np.polynomial.Polynomial([math.comb(order - 1 + k, k) for k in range(order)])
    taps = np.ones(1)
    for y in half.roots():
        b = 1 - 2 * y  # (z + 1/z) / 2
        z = b + np.sqrt(b * b - 1 + 0j)
        taps = np.convolve(taps, [1, -(z if abs(z) < 1 else 1 / z)])
    for _ in range(order):
        taps = np.convolve(taps, [1, 1])
    taps = np.real(taps)
    return taps * math.sqrt(2) / taps.sum()


def levels(n: int, taps: int) -> int:
    """How often a series of n values can be halved before the filter is longer than it."""
    return max(0, int(math.log2(n / (taps - 1)))) if n >= taps - 1 else 0


def _step(n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Low- and high-pass analysis of n values: matrices of (n + 1) // 2 rows over n + n % 2 values."""
    low = scaling_filter(order)
    size, taps = n + n % 2, len(low)
    smooth, detail = np.zeros((size // 2, size)), np.zeros((size // 2, size))
    for o in range(size // 2):
        for j in range(taps):
            at = (taps // 2 + 2 * o - j) % size
            smooth[o, at] += low[taps - 1 - j]
            detail[o, at] += (-1) ** (j + 1) * low[j]
    return smooth, detail


@lru_cache
def maps(n: int, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(analysis, synthesis, sizes): coefficients = analysis @ x, x = synthesis @ coefficients; sizes of the smooth part and then of each level's
    details, coarsest first."""
    whole, back, sizes, m = np.eye(n), np.eye(n), [], n
    parts, outs = [], []
    for _ in range(levels(n, 2 * order)):
        smooth, detail = _step(m, order)
        extend = np.vstack([np.eye(m), np.eye(m)[-1:]]) if m % 2 else np.eye(m)
        cut = np.eye(m, m + m % 2)
        parts.insert(0, detail @ extend @ whole)
        outs.insert(0, back @ cut @ detail.T)
        whole, back = smooth @ extend @ whole, back @ cut @ smooth.T
        sizes.insert(0, len(detail))
        m = len(smooth)
    return np.vstack([whole, *parts]), np.hstack([back, *outs]), [m, *sizes]


def denoise(windows: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each row with its details shrunk by the universal threshold (soft), the noise's scale being the finest details' median."""
    analysis, synthesis, sizes = maps(windows.shape[1], order)
    return shrunk(windows, analysis, sizes) @ synthesis.T


def shrunk(windows: np.ndarray, analysis: np.ndarray, sizes: list[int]) -> np.ndarray:
    n = windows.shape[1]
    c = windows @ analysis.T
    if len(sizes) > 1:
        limit = np.median(np.abs(c[:, -sizes[-1] :]), axis=1, keepdims=True) / MAD * math.sqrt(2 * math.log(max(n, 2)))
        d = c[:, sizes[0] :]
        c[:, sizes[0] :] = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
    return c


def last_denoised(windows: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The last value of each denoised row: one row of the synthesis is all that it needs."""
    analysis, synthesis, sizes = maps(windows.shape[1], order)
    return shrunk(windows, analysis, sizes) @ synthesis[-1]


def causal_denoise(panel: DataFrame, column: str, *, window: int = WINDOW, order: int = ORDER) -> DataFrame:
    """(symbol, trade_date, column, denoised): the last value of the denoised window that ends at each row, so the future cannot change it; null until
    a window is full and where it holds a null."""
    return slide(panel.select("symbol", "trade_date", column), {"denoised": (column, lambda: LastOf(lambda w: last_denoised(w, order), window))})
