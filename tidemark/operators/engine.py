"""Single-name tools: contextual bandits and policies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import asof_backward
from ..workers import ship

RUNS = 512


def fixed_policy(rewards: DataFrame, arm: str) -> DataFrame:
    """The policy that always picks one arm: (run, step, arm, reward) of a reward table."""
    return rewards.select("run", "step", F.lit(arm).alias("arm"), F.col(arm).alias("reward"))


def policy_returns(decisions: DataFrame, daily: DataFrame) -> DataFrame:
    """(run, trade_date, r): the daily returns (run, arm, trade_date, r) of the arm decided (run, decided_on, arm) last before each day; 0
    before the first decision."""
    days = daily.select("run", "trade_date").distinct().withColumn("_before", F.date_sub("trade_date", 1))
    held = asof_backward(days, decisions, ["run"], "_before", "decided_on", ["arm"])
    return held.join(daily, ["run", "arm", "trade_date"], "left").select("run", "trade_date", F.coalesce("r", F.lit(0.0)).alias("r"))


def linucb(rewards: DataFrame, arms: list[str], context: list[str], *, alpha: float = 0.3, ridge: float = 1.0) -> DataFrame:
    """Disjoint LinUCB over a reward table (run, step, context columns, arms): the decision of a step knows earlier steps only. A run's steps
    are learned in order by one task, up to RUNS runs of it side by side."""
    ship(rewards.sparkSession)
    k = len(context)

    def learn(x, r, starts, lengths):
        """Picks of runs that lie end to end in the rows of x (context) and r (rewards of all arms)."""
        picks, order = np.zeros(len(x), int), np.argsort(-lengths, kind="stable")
        starts, going = starts[order], np.searchsorted(-lengths[order], -np.arange(lengths.max()))  # how many runs have a step i
        a, b = np.tile(ridge * np.eye(k), (len(starts), len(arms), 1, 1)), np.zeros((len(starts), len(arms), k))
        for i, m in enumerate(going):
            at = starts[:m] + i
            now = x[at]
            solved = np.linalg.solve(a[:m], np.stack([b[:m], np.broadcast_to(now[:, None], (m, len(arms), k))], -1))
            mean, spread = np.moveaxis((now[:, None, :, None] * solved).sum(2), -1, 0)
            pick = picks[at] = (mean + alpha * np.sqrt(spread)).argmax(1)
            own = np.arange(m)
            a[own, pick] += now[:, :, None] * now[:, None, :]
            b[own, pick] += r[at, pick][:, None] * now
        return picks

    def run(batches):
        for whole in batches:
            for j in range(0, whole.num_rows, RUNS):
                some = whole.slice(j, RUNS)
                rows = some.column(1).flatten()
                lengths = np.diff(some.column(1).offsets.to_numpy())
                x, r = (np.column_stack([rows.field(c).to_numpy(zero_copy_only=False) for c in names]) for names in (context, arms))
                picks = learn(x, r, np.cumsum(lengths) - lengths, lengths)
                out = [some.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths))), rows.field("step"), pa.array(np.array(arms, object)[picks], pa.string()), pa.array(r[np.arange(len(r)), picks])]
                yield pa.RecordBatch.from_arrays(out, ["run", "step", "arm", "reward"])

    each = F.struct(F.col("step").cast("long").alias("step"), *[F.col(c).cast("double").alias(c) for c in (*context, *arms)])
    runs = rewards.groupBy("run").agg(F.sort_array(F.collect_list(each)).alias("rows"))  # a run's steps, which one task learns
    return runs.mapInArrow(run, f"run {rewards.schema['run'].dataType.simpleString()}, step long, arm string, reward double")


def thompson(moments: DataFrame, *, seed: int = 7) -> DataFrame:
    """One draw per arm from its reward moments (arm, n, mean, var), and the best arm; draws are seeded by arm."""
    ship(moments.sparkSession)

    @F.pandas_udf("double")
    def draw(arm: pd.Series, n: pd.Series, mean: pd.Series, var: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, sum(map(ord, a))]).normal(m, np.sqrt(max(v, 1e-12) / max(k, 1))) for a, k, m, v in zip(arm, n, mean, var, strict=True)])

    drawn = moments.withColumn("draw", draw("arm", "n", "mean", F.coalesce("var", F.lit(1.0))))
    return drawn.withColumn("picked", F.row_number().over(Window.orderBy(F.desc("draw"), "arm")) == 1)  # one row an arm
