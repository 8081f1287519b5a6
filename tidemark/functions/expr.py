"""Expressions with the engine's null rules: division by zero is null, windows need all their rows, ranks average ties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12
TRADING_DAYS = 252


def by_symbol() -> WindowSpec:
    """Each name's rows by date."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def by_date() -> WindowSpec:
    """Each date's rows."""
    return Window.partitionBy("trade_date")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero made zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def shift(x: Column | str, n: int, by: WindowSpec | None = None) -> Column:
    by = by or by_symbol()
    return F.lag(col(x), n).over(by) if n >= 0 else F.lead(col(x), -n).over(by)


def change(x: Column | str, n: int = 1, by: WindowSpec | None = None) -> Column:
    """Return over n rows."""
    return safe_div(col(x), shift(x, n, by)) - 1


def rolling(x: Column | str, n: int, how: str, *, min_rows: int | None = None, by: WindowSpec | None = None, lag: int = 0) -> Column:
    """An aggregate over the last n rows, `lag` rows back; null with fewer than min_rows (n) values."""
    x, frame = col(x), (by or by_symbol()).rowsBetween(-n + 1 - lag, -lag)
    value = {
        "mean": lambda: F.avg(x), "std": lambda: F.stddev_samp(x), "max": lambda: F.max(x), "min": lambda: F.min(x),
        "sum": lambda: F.sum(x), "median": lambda: F.percentile(x, F.lit(0.5)),
    }[how]()
    return F.when(F.count(x).over(frame) >= (n if min_rows is None else min_rows), value.over(frame))


class Columns:
    """What formulas are made of, as columns; sliding.Past has the same over arrays."""

    col, shift, change, rolling, safe_div = map(staticmethod, (col, shift, change, rolling, safe_div))
    absolute, log1p, number = map(staticmethod, (F.abs, F.log1p, F.lit))

    @staticmethod
    def losses(x: Column) -> Column:
        """x where negative, else 0."""
        return F.when(x < 0, x).when(x.isNotNull(), 0.0)


def exact_sum(x: Column | str) -> Column:
    """A sum that is the same in whatever order rows come: multiples of 2^-10 add up without rounding, and what is left of each value is too
    small to round differently."""
    x = col(x)
    high = F.rint(x * 1024.0) / 1024.0
    return F.sum(high) + F.sum(F.nanvl(x - high, F.lit(0.0)))


def zscore(x: Column | str, by: WindowSpec | None = None) -> Column:
    """(x - mean) / (sd + 1e-12) within a group; null where either is."""
    x, by = col(x), by or by_date()
    return (x - F.avg(x).over(by)) / (F.stddev_samp(x).over(by) + EPS)


def average_rank(x: Column | str, *keys: str) -> Column:
    """Rank with ties at their average; nulls have none."""
    x = col(x)
    tied = F.count(x).over(Window.partitionBy(*keys, x))
    below = F.rank().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), below + (tied - 1) / 2.0)


def ordinal(x: Column, *keys: str, tie: str = "symbol") -> Column:
    """Rank without ties: equal values go by symbol."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(x, tie))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null for a group without variance."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def skew(x: Column | str) -> Column:
    """Population skewness from moments; null without variance."""
    x = col(x)
    m = F.avg(x * x * x) - 3 * F.avg(x) * F.avg(x * x) + 2 * F.pow(F.avg(x), F.lit(3.0))
    return F.when(F.var_pop(x) > 0, m / F.pow(F.stddev_pop(x), F.lit(3.0)))


def excess_kurtosis(x: Column | str) -> Column:
    x, m = col(x), F.avg(col(x))
    fourth = F.avg(x * x * x * x) - 4 * m * F.avg(x * x * x) + 6 * m * m * F.avg(x * x) - 3 * m * m * m * m
    return F.when(F.var_pop(x) > 0, fourth / F.pow(F.var_pop(x), F.lit(2.0)) - 3)


@dataclass(frozen=True)
class Costs:
    """A market's charges as fractions of an order's value, its flat charge on a sell order, and its impact in basis points: base + slope *
    sqrt(order / adv)."""

    buy: float
    sell: float
    flat_sell: float
    base: float
    slope: float


#: A transaction tax of .001, exchange fees (3.07e-5 + 1e-6) with 18 % tax on them, a stamp duty of 1.5e-4 on buys, a flat
#: depository charge of 15.34 on sells; overseas a sell fee of 2.78e-5 only.
DELIVERY = Costs(0.001 + (3.07e-5 + 1e-6) * 1.18 + 1.5e-4, 0.001 + (3.07e-5 + 1e-6) * 1.18, 15.34, 3.0, 10.0)
OVERSEAS = Costs(0.0, 2.78e-5, 0.0, 1.0, 8.0)


def cost_rate(side: str, order: Column, adv: Column, *, market: str = "delivery", impact_multiplier: float = 1.0, dp_order_value: Column | None = None) -> Column:
    """Cost of an order as a fraction of its value: charges and square-root impact. Without order or volume there is no impact."""
    costs = DELIVERY if market == "delivery" else OVERSEAS
    charges = F.lit(costs.buy if side == "buy" else costs.sell)
    if side == "sell" and dp_order_value is not None and costs.flat_sell:
        charges = charges + F.when(dp_order_value > 0, F.lit(costs.flat_sell) / dp_order_value).otherwise(0.0)
    impact = F.when((order > 0) & (adv > 0), (costs.base + costs.slope * F.sqrt(safe_div(order, adv))) * impact_multiplier / 1e4).otherwise(0.0)
    return charges + impact


@dataclass(frozen=True)
class Market:
    """What a backtest needs of a market: its sessions are those observed in its panel."""

    name: str
    settlement_days: int
    costs: str

    def cost(self, side: str, order: Column, adv: Column, **more) -> Column:
        return cost_rate(side, order, adv, market=self.costs, **more)


MARKETS = {m.name: m for m in (Market("delivery", 1, "delivery"), Market("overseas", 1, "overseas"))}


def market(name: str) -> Market:
    if name not in MARKETS:
        raise ValueError(f"no market {name}; there are {sorted(MARKETS)}")
    return MARKETS[name]
