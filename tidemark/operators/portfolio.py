"""Portfolio construction: relational stages by (rebalance_date, symbol), and the path-dependent kernel by configuration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..stages import Stage
from ..workers import ship



def by_book() -> WindowSpec:
    """The names of one rebalance."""
    return Window.partitionBy("rebalance_date")


@dataclass(frozen=True)
class Config:
    """Fixed production values of the constructor."""

    scheme: str = "equal"
    top_n: int = 25
    position_cap: float = 0.06
    sector_cap: float = 0.25
    adv_limit: float = 0.02
    band: float = 0.25
    tau: float = 1.0
    target_vol: float = 0.135
    full_exit: float = 0.005
    capital: float = 2.5e6


def production(capital: float) -> Config:
    return Config(scheme="minvar", tau=0.5, capital=capital)


def inverse_vol(book: DataFrame, vol: str = "vol") -> DataFrame:
    """Weights by 1 / vol; a missing vol counts with the mean inverse."""
    inverse = F.when(F.col(vol) > 0, 1 / F.col(vol))
    filled = F.coalesce(inverse, F.avg(inverse).over(by_book()), F.lit(1.0))
    return book.withColumn("_i", filled).withColumn("weight", F.col("_i") / F.sum("_i").over(by_book())).drop("_i")


def cap_positions(book: DataFrame, cap: float, rounds: int = 10) -> DataFrame:
    """Clips weights at the cap and gives the excess to the others in proportion to their headroom, `rounds` times at most."""
    out = book
    for _ in range(rounds):
        excess = F.sum(F.greatest(F.col("weight") - cap, F.lit(0.0))).over(by_book())
        room = F.greatest(F.lit(cap) - F.col("weight"), F.lit(0.0))
        share = F.coalesce(safe_div(room, F.nullif(F.sum(room).over(by_book()), F.lit(0.0))), F.lit(0.0))
        given = F.least(excess, F.sum(room).over(by_book())) * share
        out = out.withColumn("weight", F.least(F.col("weight"), F.lit(cap)) + given)
    return out


def cap_sectors(book: DataFrame, cap: float, sector: str = "industry") -> DataFrame:
    """Scales a sector down to its cap; names without one are exempt."""
    total = F.sum("weight").over(Window.partitionBy("rebalance_date", sector))
    return book.withColumn("weight", F.when(F.col(sector).isNull(), F.col("weight")).otherwise(F.col("weight") * F.least(F.lit(1.0), safe_div(F.lit(cap), total))))


def vol_target(weight: Column, realised: Column, target: float) -> Column:
    return weight * F.coalesce(F.least(F.lit(1.0), safe_div(F.lit(target), F.nullif(realised, F.lit(0.0)))), F.lit(1.0))


def no_trade(target: Column, prior: Column, band: float) -> Column:
    """Holds the prior weight where the change is under `band` of the target."""
    return F.when((target > 0) & (F.abs(target - prior) < band * target), prior).otherwise(target)


def partial(target: Column, prior: Column, tau: float, full_exit: float) -> Column:
    """Moves by tau of the way; what would stay under full_exit of a name to leave is sold."""
    moved = prior + tau * (target - prior)
    return F.when((target == 0) & (moved < full_exit), 0.0).otherwise(moved)


def participation_cap(target: Column, prior: Column, adv: Column, *, limit: float, capital: float) -> Column:
    """Bounds the move by a share of volume; an unknown volume fails open."""
    most = F.when(adv > 0, limit * adv / capital)
    return F.when(most.isNull(), target).otherwise(prior + F.greatest(-most, F.least(most, target - prior)))


def violations(book: DataFrame, config: Config) -> DataFrame:
    """Constraints that a book breaks, one row each."""
    eps = 1e-9
    checks = {"position_cap": F.max("weight") > config.position_cap + eps, "gross": F.sum("weight") > 1 + eps, "negative": F.min("weight") < -eps}
    return book.groupBy("rebalance_date").agg(*[c.alias(n) for n, c in checks.items()]).select("rebalance_date", F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("broken")) for n in checks])).alias("c")).where("c.broken").select("rebalance_date", "c.constraint")


NAMES_A_BLOCK = 128


def products(returns: DataFrame) -> DataFrame:
    """(a, b, n, x, y, xy, wxy, qq): over the days that names a <= b have in common their count and the sums of a's and b's values, of their
    product, of w times it and of its square. returns: symbol, trade_date, x, w.

    Names are dealt into blocks; a task takes two blocks, whose values are two matrices of one row a session, and multiplies them, so that
    a row is sent once to each block and not once to each name."""
    ship(returns.sparkSession)
    names = returns.agg(F.count_distinct("symbol")).first()[0]
    blocks = max(1, -(-names // NAMES_A_BLOCK))
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(j, F.col("block")).alias("lo"), F.greatest(j, F.col("block")).alias("hi"))))
    dealt = returns.where("x is not null").withColumn("block", own).select("symbol", "trade_date", "x", "w", "block", each.alias("p")).select("symbol", "trade_date", "x", "w", "block", "p.lo", "p.hi")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        days, row = np.unique(g["trade_date"].to_numpy(), return_inverse=True)
        symbols, column = np.unique(g["symbol"].to_numpy(), return_inverse=True)
        values, weight = np.full((len(days), len(symbols)), np.nan), np.zeros(len(days))
        values[row, column], weight[row] = g["x"], g["w"]
        block = np.zeros(len(symbols), int)
        block[column] = g["block"]
        have, v = (~np.isnan(values)).astype(float), np.nan_to_num(values)
        left, right = np.flatnonzero(block == g["lo"].iloc[0]), np.flatnonzero(block == g["hi"].iloc[0])
        sums = [x[:, left].T @ y[:, right] for x, y in ((have, have), (v, have), (have, v), (v, v), (v * weight[:, None], v), (v * v, v * v))]
        i, j = np.nonzero(sums[0])
        a, b = symbols[left[i]], symbols[right[j]]
        turned = a > b
        keep = ~turned if g["lo"].iloc[0] == g["hi"].iloc[0] else np.ones(len(a), bool)
        n, x, y, *rest = (m[i, j] for m in sums)
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        out = pd.DataFrame({"a": np.where(turned, b, a), "b": np.where(turned, a, b), "n": n.astype(np.int64), "x": x, "y": y, **dict(zip(("xy", "wxy", "qq"), rest, strict=True))})
        return out[keep]

    kind = returns.schema["symbol"].dataType.simpleString()
    return dealt.groupBy("lo", "hi").applyInPandas(run, f"a {kind}, b {kind}, n long, x double, y double, xy double, wxy double, qq double")


def pair_moments(returns: DataFrame) -> DataFrame:
    """Pairwise population covariances (a, b, n, cov) of long returns (symbol, trade_date, ret), on common days."""
    p = products(returns.select("symbol", "trade_date", F.col("ret").alias("x"), F.lit(1.0).alias("w")))
    return p.select("a", "b", "n", (F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n")).alias("cov"))


def demeaned(returns: DataFrame) -> DataFrame:
    """(symbol, trade_date, x): returns less their name's mean, so that a missing one, which counts as the mean, is 0."""
    return returns.where("ret is not null").select("symbol", "trade_date", (F.col("ret") - F.avg("ret").over(Window.partitionBy("symbol"))).alias("x"))


def ewma_moments(returns: DataFrame, *, lam: float = 0.94) -> DataFrame:
    """Exponentially weighted covariances (a, b, cov) of demeaned returns over all sessions; age counts sessions back from the last, and
    missing returns take their name's mean."""
    age = F.row_number().over(Window.orderBy(F.desc("trade_date"))) - 1  # one row a session
    ages = returns.select("trade_date").distinct().withColumn("w", F.pow(F.lit(lam), age))
    total = ages.agg(F.sum("w").alias("total"))
    p = products(demeaned(returns).join(ages, "trade_date"))
    return p.join(F.broadcast(total)).select("a", "b", (F.col("wxy") / F.col("total")).alias("cov"))  # one row


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """Covariances (a, b, cov) shrunk towards a scaled identity (Ledoit-Wolf), with missing returns at their name's mean: the shrinkage
    follows from sums over all pairs, which the products give."""
    t = returns.select("trade_date").distinct().agg(F.count(F.lit(1)).alias("t"))
    p = products(demeaned(returns).withColumn("w", F.lit(1.0))).join(F.broadcast(t))  # one row
    # written, as the shrinkage of all pairs goes back to each
    s = Stage(returns.sparkSession, "pairs").write(p.select("a", "b", "t", (F.col("xy") / F.col("t")).alias("s"), (F.col("qq") / F.col("t")).alias("q")))
    twice, same = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0), F.col("a") == F.col("b")
    total = s.agg(F.count_if(same).alias("p"), F.sum(F.when(same, F.col("s"))).alias("trace"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"), F.sum(twice * F.col("q")).alias("qs"), F.first("t").alias("_t"))
    mu = F.col("trace") / F.col("p")
    d2 = F.col("ss") - F.col("p") * mu * mu
    shrink = total.select(mu.alias("mu"), F.when(d2 > 0, F.least((F.col("qs") - F.col("ss")) / F.col("_t"), d2) / d2).otherwise(0.0).alias("shrink"))
    return s.join(F.broadcast(shrink)).select("a", "b", (F.when(same, F.col("shrink") * F.col("mu")).otherwise(0.0) + (1 - F.col("shrink")) * F.col("s")).alias("cov"))  # one row


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf covariance towards a scaled identity of rows of returns; missing values take their column's mean."""
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((x**2).T @ (x**2) / n - s**2).sum() / (n * p), delta)
    shrink = beta / delta if delta > 0 else 0.0
    return shrink * mu * np.eye(p) + (1 - shrink) * s


def min_variance(cov: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """Long-only: the solution of cov w = 1, clipped and scaled; equal weights if nothing is left."""
    n = len(cov)
    try:
        w = np.clip(np.linalg.solve(cov + ridge * np.eye(n), np.ones(n)), 0, None)
    except np.linalg.LinAlgError:
        w = np.zeros(n)
    return w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)


RISK_WINDOW = 252
MIN_OBS = 63


def risk_windows(panel: DataFrame, picks: DataFrame, calendar: DataFrame, *, window: int = RISK_WINDOW, min_obs: int = MIN_OBS) -> DataFrame:
    """picks (rebalance_date, symbol, ...) with obs, vol and hist over the `window` sessions that end at the rebalance: hist holds (session,
    ret) of the name's returns there; vol and hist are null under min_obs of them, for that name alone."""
    at = calendar.select("trade_date", "idx")
    rows = panel.where("ret is not null").select("symbol", "trade_date", "ret").join(at, "trade_date").select("symbol", F.floor(F.col("idx") / window).alias("_block"), "idx", "ret")
    asked = picks.select("symbol", F.col("rebalance_date").alias("trade_date")).distinct().join(at, "trade_date").select("symbol", F.col("trade_date").alias("rebalance_date"), F.col("idx").alias("_to"))
    # a window lies in two blocks of sessions at most, so only rows of names and times that are asked for are gathered
    two = asked.withColumn("_block", F.explode(F.array(F.floor(F.col("_to") / window), F.floor(F.col("_to") / window) - 1)))
    met = two.join(rows, ["symbol", "_block"]).where((F.col("idx") <= F.col("_to")) & (F.col("idx") > F.col("_to") - window))
    enough = F.count("ret") >= min_obs
    found = met.groupBy("symbol", "rebalance_date").agg(F.count("ret").alias("_obs"), F.when(enough, F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"), F.when(enough, F.sort_array(F.collect_list(F.struct("idx", "ret")))).alias("hist"))
    return picks.join(found, ["symbol", "rebalance_date"], "left").withColumn("obs", F.coalesce("_obs", F.lit(0).cast("long"))).drop("_obs")


CAP_ROUNDS = 4


def under_caps(w: np.ndarray, sectors: list[str | None], position: float, sector: float) -> np.ndarray:
    """Weights clipped at the position cap (an equal part at least) with the excess given to the others by their headroom, then sectors scaled
    down to their cap; names without a sector are exempt."""
    cap = max(position, 1 / len(w))
    for _ in range(CAP_ROUNDS):
        room, excess = np.maximum(cap - w, 0), np.maximum(w - cap, 0).sum()
        w = np.minimum(w, cap) + (min(excess, room.sum()) * room / room.sum() if room.sum() > 0 else 0)
    total: dict[str, float] = {}
    for s, v in zip(sectors, w, strict=True):
        if s is not None:
            total[s] = total.get(s, 0.0) + v
    return np.array([v * min(1.0, sector / total[s]) if s is not None and total[s] > 0 else v for s, v in zip(sectors, w, strict=True)])


def base_weights(rows: DataFrame, configs: list[Config], names: list[str]) -> DataFrame:
    """rows, once for each configuration, with weight under the position and sector caps. Books of a date are weighted apart, so all dates go side
    by side; a book holds top_n names at most. Names without enough history share an equal part, the others the risk model's."""
    ship(rows.sparkSession)
    each = rows.withColumn("config", F.explode(F.array(*map(F.lit, names))))
    by_name = dict(zip(names, configs, strict=True))
    kind = rows.schema["symbol"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c, g = by_name[g["config"].iloc[0]], g.sort_values("symbol")
        n, covered = len(g), g["hist"].notna().to_numpy()
        w = np.full(n, 1 / n)
        if c.scheme != "equal" and covered.any():
            some = g[covered]
            if c.scheme == "ivol":
                inverse = 1 / some["vol"].where(some["vol"] > 0)
                part = inverse.fillna(inverse.mean()).fillna(1.0).to_numpy()
                part = part / part.sum()
            else:
                last = max(r["idx"] for h in some["hist"] for r in h)
                x = np.full((RISK_WINDOW, len(some)), np.nan)
                for k, h in enumerate(some["hist"]):
                    for r in h:
                        if (at := RISK_WINDOW - 1 - (last - r["idx"])) >= 0:
                            x[at, k] = r["ret"]
                part = min_variance(shrunk_covariance(x[~np.isnan(x).all(1)]))
            w[covered] = part * covered.sum() / n
        w = under_caps(w, [x if isinstance(x, str) else None for x in g["industry"]], c.position_cap, c.sector_cap)
        return pd.DataFrame({"config": g["config"].iloc[0], "rebalance_date": g["rebalance_date"].iloc[0], "symbol": g["symbol"], "weight": w})

    shape = f"config string, rebalance_date date, symbol {kind}, weight double"
    w = each.select("config", "rebalance_date", "symbol", "vol", "industry", "hist").groupBy("config", "rebalance_date").applyInPandas(run, shape)
    return each.drop("hist", "vol").join(w, ["config", "rebalance_date", "symbol"])


def targets(rows: DataFrame, configs: list[Config], names: list[str], realised: DataFrame) -> DataFrame:
    """Base weights under the position cap, the sector cap and the volatility target: (config, rebalance_date, symbol, industry, adv, weight).
    realised: trade_date, vol of the fully invested book."""
    book = base_weights(rows.select("rebalance_date", "symbol", "vol", "adv", "industry", "hist"), configs, names)
    limit = F.element_at(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(c.target_vol) for c in configs])), F.col("config"))
    seen = book.join(realised.select(F.col("trade_date").alias("rebalance_date"), F.col("vol").alias("_vol")), "rebalance_date", "left")
    gross = F.coalesce(F.least(F.lit(1.0), safe_div(limit, F.nullif(F.col("_vol"), F.lit(0.0)))), F.lit(1.0))
    return seen.select("config", "rebalance_date", "symbol", "industry", "adv", (F.col("weight") * gross).alias("weight"))


def config_name(c: Config) -> str:
    return f"{c.scheme}_tau{c.tau:g}"


def traded(c: Config, target: dict, book: dict, adv: dict) -> dict:
    """The next book: the trading rule and the participation cap by name, and a gross of 1 at most."""
    new = {}
    for s in sorted(target.keys() | book.keys()):
        to, was = target.get(s, 0.0), book.get(s, 0.0)
        if c.tau < 1:
            to = 0.0 if to <= 1e-12 and was < c.full_exit else was + c.tau * (to - was)
        elif to > 0 and abs(to - was) < c.band * to:
            to = was
        if c.capital > 0 and adv.get(s) is not None and not np.isnan(adv[s]):
            most = c.adv_limit * adv[s] / c.capital
            to = was + max(-most, min(most, to - was))
        if to > 1e-12:
            new[s] = to
    total = sum(new.values())
    return {s: v / total for s, v in new.items()} if total > 1 + 1e-12 else new


def construct(rows: DataFrame, configs: list[Config], realised: DataFrame) -> DataFrame:
    """Books (config, rebalance_date, symbol, weight, prior) from targets by the trading rule, the participation cap and a gross of 1 at most.

    rows: rebalance_date, symbol, vol, adv, industry and hist of the names picked on each date (risk_windows). All that does not depend on
    the last book is worked out by date in parallel; what carries over, a configuration's bands or partial moves, folds its targets
    in order: top_n short rows a rebalance, however many names there are. Prior weights are the last book's, without drift."""
    names = [config_name(c) for c in configs]
    by_name = dict(zip(names, configs, strict=True))
    kind = rows.schema["symbol"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        name = g["config"].iloc[0]
        c, book, adv, out = by_name[name], {}, {}, []
        for day, d in g.sort_values(["rebalance_date", "symbol"]).groupby("rebalance_date"):
            adv |= dict(zip(d["symbol"], d["adv"], strict=True))
            new = traded(c, dict(zip(d["symbol"], d["weight"], strict=True)), book, adv)
            out += [(name, day, s, v, book.get(s, 0.0)) for s, v in new.items()]
            book = new
        return pd.DataFrame(out, columns=["config", "rebalance_date", "symbol", "weight", "prior"])

    t = targets(rows, configs, names, realised)
    return t.groupBy("config").applyInPandas(run, f"config string, rebalance_date date, symbol {kind}, weight double, prior double")
