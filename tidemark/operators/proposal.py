"""Proposals of candidate features: their schema, their order by what was learned, and their screen."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.expr import zscore
from ..stages import Stage
from . import sliding, validation

#: A name's pattern, the most characters of rationale and expression, and the longest lookback.
NAME = r"^[a-z][a-z0-9_]{2,30}$"
MOST_RATIONALE, MOST_EXPRESSION, MOST_LOOKBACK = 500, 300, 252


@dataclass(frozen=True)
class Proposal:
    name: str
    rationale: str
    expression: str
    lookback_days: int

    def problem(self) -> str | None:
        """What is wrong with it, if anything."""
        if not re.match(NAME, self.name):
            return "name"
        if not 1 <= len(self.rationale) <= MOST_RATIONALE:
            return "rationale"
        if not 1 <= len(self.expression) <= MOST_EXPRESSION:
            return "expression"
        if not 1 <= self.lookback_days <= MOST_LOOKBACK:
            return "lookback_days"
        try:
            dsl.compile_expression(self.expression)
        except dsl.SandboxError as e:
            return f"sandbox: {e}"
        return None


def invalid(proposals: DataFrame) -> DataFrame:
    """The proposals (name, rationale, expression, lookback_days) with `problem`, the first field that breaks the schema; the expression's
    grammar is not looked at."""
    long = lambda c, most: ~F.coalesce(F.length(c).between(1, most), F.lit(False))
    wrong = (
        F.when(~F.coalesce(F.col("name").rlike(NAME), F.lit(False)), "name").when(long("rationale", MOST_RATIONALE), "rationale").when(long("expression", MOST_EXPRESSION), "expression")
        .when(~F.coalesce(F.col("lookback_days").between(1, MOST_LOOKBACK), F.lit(False)), "lookback_days")
    )
    return proposals.withColumn("problem", wrong)


def by_memory(proposals: DataFrame, memory: DataFrame) -> DataFrame:
    """Proposals (position, family, ...) with `turn`, their order when families come by rank of memory (family, rank), unknown ones last."""
    ranked = proposals.join(memory.select("family", F.col("rank").alias("_rank")), "family", "left")
    return ranked.withColumn("turn", F.row_number().over(Window.orderBy(F.asc_nulls_last("_rank"), "position"))).drop("_rank")  # a proposal round is a short list


def screen(panel: DataFrame, rows: DataFrame, calendar: DataFrame, folds: DataFrame, library: list[str], proposals: list[Proposal], *, min_names: int = 20) -> DataFrame:
    """Per proposal: status, detail, mean_ic, t and delta_ic, the ridge's mean rank correlation with the feature less that without.

    All candidates are computed in one frame and screened in one pass."""
    spark = rows.sparkSession
    found, refused, names = {}, [], set(library) | set(rows.columns)
    for p in proposals:
        bad = "name collides with existing feature" if p.name in names else p.problem()
        if bad:
            refused.append((p.name, "rejected", bad, None, None, None))
        else:
            found[p.name] = p.expression
    shape = "name string, status string, detail string, mean_ic double, t double, delta_ic double"
    out = spark.createDataFrame(refused, shape)
    if not found:
        return out
    days = rows.select("trade_date").distinct()  # one row a session
    raw = sliding.evaluate(panel, dsl.arrays(found)).join(F.broadcast(days), "trade_date", "left_semi")
    scored = raw.select("symbol", "trade_date", *[F.coalesce(zscore(n), F.lit(0.0)).alias(n) for n in found])
    both = Stage(spark, "screen").write(rows.join(scored, ["symbol", "trade_date"], "left").fillna(0.0, list(found)))
    done = validation.candidates(both, calendar, folds, library, list(found), min_names=min_names)
    ok = done.where("config <> ''").select(F.col("config").alias("name"), F.lit("ok").alias("status"), F.lit("screened").alias("detail"), "mean_ic", "t", "delta_ic")
    return ok.unionByName(out)
