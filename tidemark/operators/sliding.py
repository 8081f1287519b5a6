"""Kernels that slide over each name's rows in order: order statistics and other functions of the last rows.

Rows are dealt by name and sorted, then stream through Arrow batches; a kernel keeps what it needs of the last rows and carries it over batches, so a
task holds one window, not a series. Against a window expression, which builds each row's frame anew, the work of a row is that of one step.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import by_symbol
from ..workers import ship

#: Takes a name's next values (NaN where null) and returns a result for each.
Kernel = Callable[[np.ndarray], np.ndarray]


class Quantile:
    """The quantile of the last `window` rows' values (all rows so far without one), from a list kept in order: linear between two values, or the upper
    of them."""

    def __init__(self, q: float, window: int | None, min_rows: int, upper: bool):
        self.q, self.window, self.least, self.upper, self.rows, self.ordered = q, window, min_rows, upper, deque(), []

    def __call__(self, values: np.ndarray) -> np.ndarray:
        rows, ordered, out = self.rows, self.ordered, np.full(len(values), np.nan)
        for i, v in enumerate(values.tolist()):
            if v == v:
                insort(ordered, v)
            if self.window is not None:
                rows.append(v)
                if len(rows) > self.window and (old := rows.popleft()) == old:
                    del ordered[bisect_left(ordered, old)]
            n = len(ordered)
            if n >= max(1, self.least):
                at = (n - 1) * self.q
                low = int(at)
                out[i] = ordered[low] if at == low else ordered[low + 1] if self.upper else (low + 1 - at) * ordered[low] + (at - low) * ordered[low + 1]
        return out


class Extreme:
    """The largest (sign 1) or least (sign -1) value of the last `window` rows, from a deque of falling candidates."""

    def __init__(self, sign: int, window: int, min_rows: int):
        self.sign, self.window, self.least, self.at, self.held, self.best = sign, window, min_rows, 0, deque(), deque()

    def __call__(self, values: np.ndarray) -> np.ndarray:
        held, best, out = self.held, self.best, np.full(len(values), np.nan)
        for i, v in enumerate((values * self.sign).tolist()):
            at = self.at
            self.at += 1
            if v == v:
                held.append(at)
                while best and best[-1][1] <= v:
                    best.pop()
                best.append((at, v))
            while held and held[0] <= at - self.window:
                held.popleft()
            while best and best[0][0] <= at - self.window:
                best.popleft()
            if len(held) >= max(1, self.least):
                out[i] = best[0][1] * self.sign
        return out


class Mean:
    """The mean of the last `window` rows' values, each window added up anew, so that nothing of a row is left once it has gone."""

    def __init__(self, window: int, min_rows: int):
        self.window, self.least, self.tail = window, max(1, min_rows), np.full(window - 1, np.nan)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        x, out = np.concatenate([self.tail, values]), np.full(len(values), np.nan)
        if not len(values):
            return out
        held = ~np.isnan(x)
        so_far = np.concatenate([[0], np.cumsum(held)])
        n = so_far[self.window :] - so_far[: -self.window]
        windows = np.lib.stride_tricks.sliding_window_view(np.where(held, x, 0.0), self.window)
        for k in range(0, len(values), 4096):
            enough = np.flatnonzero(n[k : k + 4096] >= self.least) + k
            out[enough] = windows[enough[0] : enough[-1] + 1].sum(1)[enough - enough[0]] / n[enough] if len(enough) else 0.0
        self.tail = x[len(values) :]
        return out


class LastOf:
    """A function of the full last `window` rows, given as a matrix of one row a window; NaN until there are enough, and where a value is."""

    def __init__(self, function: Callable[[np.ndarray], np.ndarray], window: int):
        self.function, self.window, self.tail = function, window, np.zeros(0)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.tail, values])
        out = np.full(len(values), np.nan)
        if len(x) >= self.window:
            windows = np.lib.stride_tricks.sliding_window_view(x, self.window)
            full = np.flatnonzero(~np.isnan(windows).any(1))
            for k in range(0, len(full), 4096):
                some = full[k : k + 4096]
                out[some + self.window - 1 - (len(x) - len(values))] = self.function(windows[some])
        self.tail = x[len(x) - min(len(x), self.window - 1) :]
        return out


class Row:
    """The number of each row, from 1."""

    def __init__(self):
        self.at = 0

    def __call__(self, values: np.ndarray) -> np.ndarray:
        self.at += len(values)
        return np.arange(self.at - len(values) + 1, self.at + 1, dtype=float)


class Lagged:
    """A kernel's results `lag` rows later."""

    def __init__(self, kernel: Kernel, lag: int):
        self.kernel, self.waiting = kernel, np.full(lag, np.nan)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        every = np.concatenate([self.waiting, self.kernel(values)])
        self.waiting = every[len(values) :]
        return every[: len(values)]


def quantile(window: int | None, q: float = 0.5, *, min_rows: int | None = None, lag: int = 0, upper: bool = False) -> Callable[[], Kernel]:
    """Makes kernels of a sliding (or, without a window, running) quantile; null with fewer than min_rows (window) values."""
    least = min_rows if min_rows is not None else window or 1
    return lambda: Lagged(Quantile(q, window, least, upper), lag) if lag else Quantile(q, window, least, upper)


def mean(window: int, *, min_rows: int | None = None, lag: int = 0) -> Callable[[], Kernel]:
    """Makes kernels of a sliding mean."""
    least = window if min_rows is None else min_rows
    return lambda: Lagged(Mean(window, least), lag) if lag else Mean(window, least)


def extreme(how: str, window: int, *, min_rows: int | None = None, lag: int = 0) -> Callable[[], Kernel]:
    """Makes kernels of a sliding max or min."""
    sign, least = {"max": 1, "min": -1}[how], window if min_rows is None else min_rows
    return lambda: Lagged(Extreme(sign, window, least), lag) if lag else Extreme(sign, window, least)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Row numbers at which a key differs from the row before, null keys being equal."""
    n = len(columns[0]) if columns else 0
    differs = np.zeros(max(0, n - 1), bool)
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        other = pc.coalesce(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        differs |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs) + 1


def slide(rows: DataFrame, kernels: dict[str, tuple[str, Callable[[], Kernel]]], *, keys: Iterable[str] = ("symbol",), order: Iterable[Column | str] = ("trade_date",)) -> DataFrame:
    """The rows with a double column for each kernel: name -> (column, maker). Without keys the rows are one series, for frames of one row a session."""
    keys, order = list(keys), list(order)
    own = rows.columns
    at = [own.index(k) for k in keys]
    makers = [(own.index(c), make) for c, make in kernels.values()]

    def run(batches):
        now, live = object(), []
        for b in batches:
            if not b.num_rows:
                continue
            cuts = [0, *_changes([b.column(i) for i in at]).tolist(), b.num_rows] if at else [0, b.num_rows]
            inputs = {i: pc.cast(b.column(i), pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for i, _ in makers}
            outs = [[] for _ in makers]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(b.column(i)[lo].as_py() for i in at)
                if key != now:
                    now, live = key, [make() for _, make in makers]
                for out, kernel, (i, _) in zip(outs, live, makers, strict=True):
                    out.append(kernel(inputs[i][lo:hi]))
            made = [np.concatenate(o) for o in outs]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(m, pa.float64(), mask=np.isnan(m)) for m in made]], [*own, *kernels])

    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in kernels]])
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def median(rows: DataFrame, column: str, window: int, name: str, **how) -> DataFrame:
    """The rows with a sliding median."""
    return slide(rows, {name: (column, quantile(window, **how))})


class Past:
    """Formulas over rows that lie name after name, each in order of time; `at` numbers a name's rows from 1. Missing values are NaN, and a window
    that lacks rows or values has none, as in the column expressions of the same names."""

    SLICE = 1024

    def __init__(self, columns: dict[str, np.ndarray], at: np.ndarray):
        self.columns, self.at = columns, at

    def col(self, x: np.ndarray | str) -> np.ndarray:
        return self.columns[x] if isinstance(x, str) else x

    def number(self, x: float) -> np.ndarray:
        return np.full(len(self.at), x)

    def shift(self, x: np.ndarray | str, n: int) -> np.ndarray:
        x = self.col(x)
        out = np.full(len(x), np.nan)
        out[n:] = np.where(self.at[n:] > n, x[: max(0, len(x) - n)], np.nan)
        return out

    def safe_div(self, a: np.ndarray | str, b: np.ndarray | str) -> np.ndarray:
        a, b = self.col(a), self.col(b)
        return np.divide(a, b, out=np.full(len(b), np.nan), where=b != 0)

    def change(self, x: np.ndarray | str, n: int = 1) -> np.ndarray:
        return self.safe_div(x, self.shift(x, n)) - 1

    def absolute(self, x: np.ndarray) -> np.ndarray:
        return np.abs(x)

    def log1p(self, x: np.ndarray) -> np.ndarray:
        return np.log1p(x, out=np.full(len(x), np.nan), where=x > -1)

    def losses(self, x: np.ndarray) -> np.ndarray:
        return np.where(x >= 0, 0.0, x)

    def rolling(self, x: np.ndarray | str, n: int, how: str) -> np.ndarray:
        x = self.col(x)
        out = np.full(len(x), np.nan)
        if len(x) >= n:
            out[n - 1 :] = self._extreme(x, n, np.maximum if how == "max" else np.minimum) if how in ("max", "min") else self._moments(x, n, how)
            out[self.at < n] = np.nan
        return out

    @staticmethod
    def _extreme(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
        """By the extremes from each row to the ends of its block of n rows: a window is the end of one block and the beginning of the next."""
        blocks = np.full(-(-len(x) // n) * n, np.nan)
        blocks[: len(x)] = x
        blocks = blocks.reshape(-1, n)
        ahead, back = f.accumulate(blocks, axis=1).ravel(), f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return f(back[: len(x) - n + 1], ahead[n - 1 : len(x)])

    def _moments(self, x: np.ndarray, n: int, how: str) -> np.ndarray:
        """Each window added up anew, less its last value, so that equal values leave exactly 0."""
        windows = np.lib.stride_tricks.sliding_window_view(x, n)
        out = np.full(len(windows), np.nan)
        for k in range(0, len(windows), self.SLICE):
            some = windows[k : k + self.SLICE]
            d = some - some[:, -1:]
            m = d.sum(1) / n
            if how == "mean":
                out[k : k + self.SLICE] = some[:, -1] + m
            elif n > 1:
                d -= m[:, None]
                out[k : k + self.SLICE] = np.sqrt(np.einsum("ij,ij->i", d, d) / (n - 1))
        return out


class _Depth(int):
    """How many rows a formula looks back over."""

    def _with(self, other) -> _Depth:
        return _Depth(max(self, other)) if isinstance(other, _Depth) else self

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = _with

    def __neg__(self) -> _Depth:
        return self


class _Needs:
    """Formulas read for what they need: the columns, and how far they look back."""

    def __init__(self):
        self.columns = []

    def col(self, x: _Depth | str) -> _Depth:
        if isinstance(x, str):
            self.columns += [x] if x not in self.columns else []
            return _Depth(0)
        return x

    def number(self, x: float) -> _Depth:
        return _Depth(0)

    def shift(self, x: _Depth | str, n: int) -> _Depth:
        return _Depth(int(self.col(x)) + n)

    def safe_div(self, a: _Depth | str, b: _Depth | str) -> _Depth:
        return _Depth(max(self.col(a), self.col(b)))

    def change(self, x: _Depth | str, n: int = 1) -> _Depth:
        return self.shift(x, n)

    def absolute(self, x: _Depth) -> _Depth:
        return x

    log1p = losses = absolute

    def rolling(self, x: _Depth | str, n: int, how: str) -> _Depth:
        return self.shift(x, n - 1)


def evaluate(panel: DataFrame, made: Callable[[Past], dict[str, np.ndarray]], *, keep: tuple[str, ...] = (), present: str | None = None, all_rows: bool = False) -> DataFrame:
    """(symbol, trade_date, *keep, formulas): `made` gives the arrays by name from a Past. Rows without the formula `present` drop, or with all_rows
    have no formulas.

    Rows are numbered by a window by name, which deals and sorts them where the panel is not yet; batches then stream through numpy, and only as many
    rows as the formulas look back over are carried from one to the next, so a row's work grows with no series and hardly with the window."""
    needs = _Needs()
    names, depth = zip(*((n, int(d)) for n, d in made(needs).items()), strict=True)
    back, inputs, own = max(depth), needs.columns, ["symbol", "trade_date", *keep]

    def run(batches):
        last, tail, numbers = None, {c: np.zeros(0) for c in inputs}, np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            if (np.diff(at, prepend=0 if last is None else last)[at != 1] != 1).any():
                raise ValueError("a name's rows are not in order")
            last, k = at[-1], len(numbers)
            numbers = np.concatenate([numbers, at])
            tail = {c: np.concatenate([tail[c], pc.cast(b.column(len(own) + i), pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)]) for i, c in enumerate(inputs)}
            with np.errstate(all="ignore"):
                found = {n: v[k:] for n, v in made(Past(tail, numbers)).items()}
            rows = pa.RecordBatch.from_arrays([b.column(i) for i in range(len(own))], own)
            if present is not None:
                has = ~np.isnan(found[present])
                if all_rows:
                    found = {n: np.where(has, v, np.nan) for n, v in found.items()}
                else:
                    rows, found = rows.filter(pa.array(has)), {n: v[has] for n, v in found.items()}
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, pa.float64(), mask=np.isnan(v)) for v in found.values()]], [*own, *found])
            tail, numbers = {c: v[max(0, len(v) - back) :] for c, v in tail.items()}, numbers[max(0, len(numbers) - back) :]

    ship(panel.sparkSession)
    numbered = panel.select(*own, *[F.col(c).alias(f"_x{i}") for i, c in enumerate(inputs)], F.row_number().over(by_symbol()).alias("_at"))
    schema = T.StructType([*panel.select(*own).schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return numbered.mapInArrow(run, schema)


__all__ = ["Extreme", "Kernel", "LastOf", "Lagged", "Mean", "Past", "Quantile", "Row", "evaluate", "extreme", "mean", "median", "quantile", "slide"]
