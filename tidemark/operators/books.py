"""Books with memory as daily returns: drift, trading rules, costs and each book's own volatility along one path a configuration.

What doesn't depend on the last book (risk model, base weights, caps) is worked out by date in parallel (portfolio.base_weights). What does is a fold:
a configuration's sessions stream by in order, each with the returns of the names it may hold and, on a rebalance date, the capped weights. The fold
keeps the book, the names' last known volumes, the pending target and the last returns of the fully invested book, so a task holds a few
hundred numbers. That state is returned at every rebalance, and a later call resumes from it with later sessions only.

A session: (1) holdings earn their returns and drift, cash earns nothing; (2) a target that is due is traded at the close, at cost; (3) a rebalance date forms
a new target, which is due `lag` sessions later: capped weights times the volatility target over the larger of the 21- and 63-session volatility
of the book's returns over its exposure, then bands or partial moves against the drifted book, then the participation cap.
"""

from __future__ import annotations

import json
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import DELIVERY, OVERSEAS
from ..workers import ship
from .portfolio import Config, base_weights, config_name, traded

FAST, SLOW = 21, 63
DAY, RETURN, TARGET = 0, 1, 2


def cost_fraction(buy: bool, order: float, adv: float | None, *, market: str = "delivery", multiplier: float = 1.0, flat: bool = True) -> float:
    """expr.cost_rate for one order of a fold; flat: with the charge a sell order."""
    m = {"delivery": DELIVERY, "overseas": OVERSEAS}[market]
    charges = m.buy if buy else m.sell + (m.flat_sell / order if flat and order > 0 else 0.0)
    known = adv is not None and not math.isnan(adv) and adv > 0 and order > 0
    return charges + ((m.base + m.slope * math.sqrt(order / adv)) * multiplier / 1e4 if known else 0.0)


class Fold:
    """One configuration's path."""

    def __init__(self, config: Config, lag: int, market: str, state: str | None = None):
        self.config, self.lag, self.market = config, lag, market
        kept = json.loads(state) if state else {"weights": [], "adv": [], "pending": None, "returns": []}
        self.weights, self.adv, self.pending = dict(map(tuple, kept["weights"])), dict(map(tuple, kept["adv"])), kept["pending"]
        if self.pending:
            self.pending = [self.pending[0], dict(map(tuple, self.pending[1]))]
        self.returns: deque[float] = deque(kept["returns"], SLOW)

    def state(self) -> str:
        pending = [self.pending[0], list(self.pending[1].items())] if self.pending else None
        return json.dumps({"weights": list(self.weights.items()), "adv": list(self.adv.items()), "pending": pending, "returns": list(self.returns)})

    def realised(self) -> float | None:
        r = np.array(self.returns)
        if len(r) < FAST:
            return None
        vol = lambda x: float(x.std(ddof=1)) * math.sqrt(252)
        return max(vol(r[-FAST:]), vol(r)) if len(r) >= SLOW else vol(r[-FAST:])

    def session(self, idx: int, rets: dict, target: list[tuple]) -> tuple[float, float, float, float | None]:
        """(gross return, cost, turnover, gross of a new target) of a session; target: (symbol, adv, weight) on a rebalance date."""
        c, gross, cost, turnover = self.config, 0.0, 0.0, 0.0
        if self.weights:
            exposure = sum(self.weights.values())
            gross = sum(w * rets.get(n, 0.0) for n, w in self.weights.items())
            self.returns.append(gross / exposure if exposure > 1e-9 else 0.0)
            if 1 + gross > 0:
                self.weights = {n: w * (1 + rets.get(n, 0.0)) / (1 + gross) for n, w in self.weights.items()}
        if self.pending and self.pending[0] == idx:
            to, self.pending = self.pending[1], None
            for name in sorted(self.weights.keys() | to.keys()):
                move = to.get(name, 0.0) - self.weights.get(name, 0.0)
                if abs(move) >= 1e-12:
                    cost += abs(move) * cost_fraction(move > 0, abs(move) * c.capital, self.adv.get(name), market=self.market)
                    turnover += abs(move)
            self.weights = dict(to)
        made = None
        if target:
            self.adv |= {s: a for s, a, _ in target if a is not None}
            vol = self.realised()
            scale = min(1.0, c.target_vol / vol) if vol else 1.0
            new = traded(c, {s: w * scale for s, _, w in target}, self.weights, self.adv)
            self.pending, made = [idx + self.lag, new], sum(new.values())
        return gross, cost, turnover / 2, made


def path_rows(panel: DataFrame, rows: DataFrame, calendar: DataFrame, configs: list[Config], names: list[str]) -> DataFrame:
    """(config, idx, kind, trade_date, symbol, a, b): what the folds read, a session's marker before its returns and its targets."""
    days = calendar.select("idx", "trade_date")
    at = days.withColumnRenamed("trade_date", "rebalance_date")
    weights = base_weights(rows.select("rebalance_date", "symbol", "vol", "adv", "industry", "hist"), configs, names)
    targets = weights.join(at, "rebalance_date").select("config", "idx", F.lit(TARGET).alias("kind"), F.col("rebalance_date").alias("trade_date"), "symbol", F.col("adv").cast("double").alias("a"), F.col("weight").alias("b"))
    ever = rows.join(at, "rebalance_date").groupBy("symbol").agg(F.min("idx").alias("first"))
    held = panel.where("ret is not null").select("symbol", "trade_date", "ret").join(days, "trade_date").join(ever, "symbol").where("idx > first")
    each = F.explode(F.array(*map(F.lit, names))).alias("config")
    kind = rows.schema["symbol"].dataType.simpleString()
    returns = held.select(each, "idx", F.lit(RETURN).alias("kind"), "trade_date", "symbol", F.col("ret").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    marks = days.select(each, "idx", F.lit(DAY).alias("kind"), "trade_date", F.lit(None).cast(kind).alias("symbol"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    return marks.unionByName(returns).unionByName(targets)


def run_books(panel: DataFrame, rows: DataFrame, calendar: DataFrame, configs: list[Config], *, lag: int = 1, market: str = "delivery", states: DataFrame | None = None) -> DataFrame:
    """(config, idx, trade_date, gross_return, cost, net_return, turnover, target_gross, state) of every session.

    rows: rebalance_date, symbol, vol, adv, industry and hist of each date's picks (portfolio.risk_windows). target_gross and state are null but on
    rebalance dates. states (config, idx, state): a configuration resumes after its state's session; rows of earlier sessions aren't read."""
    ship(panel.sparkSession)
    names = [config_name(c) for c in configs]
    by_name = dict(zip(names, configs, strict=True))
    every = path_rows(panel, rows, calendar, configs, names)
    if states is None:
        every = every.withColumn("state", F.lit(None).cast("string"))
    else:
        kept = states.select("config", F.col("idx").alias("_from"), "state")  # one row a configuration
        every = every.join(F.broadcast(kept), "config", "left").where("_from is null or idx > _from").drop("_from")
        every = every.withColumn("state", F.when(F.col("kind") == DAY, F.col("state")))
    out_names = ["config", "idx", "trade_date", "gross_return", "cost", "net_return", "turnover", "target_gross", "state"]
    kinds = [pa.string(), pa.int64(), pa.date32(), *[pa.float64()] * 5, pa.string()]

    def run(batches):
        config = idx = day = fold = None
        rets, target, out = {}, [], []

        def close():
            gross, cost, turnover, made = fold.session(idx, rets, target)
            out.append((config, idx, day, gross, cost, gross - cost, turnover, made, fold.state() if made is not None else None))

        for b in batches:
            for c, i, kind, d, symbol, x, y, state in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (c, i) != (config, idx):
                    if fold:
                        close()
                    if c != config:
                        fold = Fold(by_name[c], lag, market, state)
                    config, idx, day, rets, target = c, i, d, {}, []
                if kind == RETURN:
                    rets[symbol] = x
                elif kind == TARGET:
                    target.append((symbol, x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], out_names)
                out.clear()
        if fold:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], out_names)

    columns = ["config", "idx", "kind", "trade_date", "symbol", "a", "b", "state"]
    dealt = every.select(*columns).repartition("config").sortWithinPartitions("config", "idx", "kind", "symbol")
    return dealt.mapInArrow(run, "config string, idx long, trade_date date, gross_return double, cost double, net_return double, turnover double, target_gross double, state string")


def last_states(books: DataFrame) -> DataFrame:
    """(config, idx, state) of each configuration's last rebalance, to resume from."""
    return books.where("state is not null").groupBy("config").agg(F.max("idx").alias("idx"), F.max_by("state", "idx").alias("state"))


def study(capital: float = 2.5e6, **fixed) -> list[Config]:
    """The eight configurations of the construction study: three schemes with bands, and partial moves."""
    return [Config(scheme=s, tau=t, capital=capital, **fixed) for s, t in (("equal", 1.0), ("ivol", 1.0), ("minvar", 1.0), ("equal", 0.25), ("equal", 0.5), ("equal", 0.75), ("ivol", 0.5), ("minvar", 0.5))]
