"""Adjusted prices kept up to date by batches of new bars and actions, instead of by a rebuild.

The store's `adjusted` table is partitioned by period and by a bucket of symbols; `actions` holds every declared action, `heads` each symbol's last
session, and `versions` one row a batch. A batch touches

- symbols whose history it changes: those with actions not known before, with bars at or before their last session (late or corrected ones), that are
  new, or for which an action was waiting for a session that the batch brings. Their rows are adjusted anew from their own bars;
- all other symbols with new bars: as nothing is adjusted after the last session, these rows are appended as they are.

Of the rows adjusted anew only partitions with a row that differs, which digests tell, are written, by dynamic overwrite, so all others keep their files. A batch that is
applied again, or that was cut off between its writes, leaves the same store: rows are replaced by key, heads and version are written last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import Stage
from .actions import adjust

KEY = ["symbol", "trade_date"]
PART = ["period", "bucket"]
ACTION = ["symbol", "ex_date", "subject"]
PRICES = ("open", "high", "low", "close")


class AdjustedStore:
    """Backward-adjusted bars under one path. period: the date pattern of a partition ("yyyy", "yyyy-MM"); buckets: of symbols a period."""

    def __init__(self, spark: SparkSession, path: str, *, period: str = "yyyy", buckets: int = 16):
        self.spark, self.path, self.period, self.buckets = spark, path.rstrip("/"), period, buckets

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def read(self) -> DataFrame:
        """The adjusted panel."""
        return self.spark.read.parquet(f"{self.path}/adjusted").drop(*PART)

    def versions(self) -> DataFrame:
        """(version, symbols, partitions, rows, first_day, last_day): what each batch touched."""
        return self.spark.read.parquet(f"{self.path}/versions")

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"period": F.date_format("trade_date", self.period), "bucket": F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int")})

    def _scaled(self, bars: DataFrame) -> DataFrame:
        """Bars with the prices and the volume that their factor gives."""
        by = F.col("cum_adj_factor")
        return bars.select("*", *[(F.col(c) * by).alias(f"adj_{c}") for c in PRICES], (F.col("volume") / by).alias("adj_volume"))

    def _as_they_are(self, bars: DataFrame) -> DataFrame:
        """Bars after which nothing is adjusted."""
        return self._scaled(bars.withColumn("cum_adj_factor", F.lit(1.0)))

    def append(self, bars: DataFrame, actions: DataFrame) -> int:
        """Applies a batch of bars (one a symbol and date) and declared actions, and returns its version."""
        stage = Stage(self.spark, "incremental")
        bars = stage.write(bars, compression="zstd")
        actions = stage.write(actions.select(*ACTION).dropDuplicates())
        stored, known, heads, log = map(self._table, ("adjusted", "actions", "heads", "versions"))
        panel = bars.columns

        fresh = stage.write(actions if known is None else _unknown(actions, known))
        every = fresh if known is None else known.select(*ACTION).unionByName(fresh)

        spans = bars.groupBy("symbol").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
        last = heads.select("symbol", "last_day") if heads is not None else self.spark.createDataFrame([], bars.select("symbol", F.col("trade_date").alias("last_day")).schema)
        ends = stage.write(spans.join(last, "symbol", "left"))
        late = ends.where("last_day is null or lo <= last_day").select("symbol")
        waiting = ends.join(every, "symbol").where("ex_date > last_day and ex_date <= hi").select("symbol")
        told = fresh.select("symbol").where("symbol is not null")
        anew = stage.write(late.unionByName(waiting).unionByName(told).distinct())

        own = bars.join(anew, "symbol", "left_semi")
        if stored is not None:
            before = stored.select(*panel).join(anew, "symbol", "left_semi")
            own = before.join(bars.select(*KEY), KEY, "left_anti").unionByName(own)
        adjusted = adjust(own, every.join(anew, "symbol", "left_semi"))
        plain = bars.join(anew, "symbol", "left_anti")
        if stored is None:
            rows, parts = self._dealt(adjusted).unionByName(self._dealt(self._as_they_are(plain))), self._dealt(bars).select(*PART).distinct()
            swapped = parts.count()
        else:
            again = self._dealt(self._scaled(stage.write(adjusted.select(*panel, "cum_adj_factor"), compression="zstd")))  # all else follows from these columns
            added = self._dealt(self._as_they_are(plain))
            # of the partitions of rows made anew, those that hold the same rows already need no write
            same = self._dealt(stored.drop(*PART).join(anew, "symbol", "left_semi")).select(*again.columns)  # Spark may read a period as a number
            both = _digests(again, 1).unionByName(_digests(same, -1)).groupBy(*PART).agg(F.sum("n").alias("n"), *[F.expr(f"bit_xor({c})").alias(c) for c in ("h1", "h2")])
            parts = stage.write(both.where("n <> 0 or h1 <> 0 or h2 <> 0").select(*PART).unionByName(added.select(*PART)).distinct())
            swapped = parts.count()
            # a name made anew brings all its rows
            kept = self._dealt(self._in(stored, parts).drop(*PART)).join(anew, "symbol", "left_anti").join(plain.select(*KEY), KEY, "left_anti")
            rows = kept.select(*again.columns).unionByName(again.unionByName(added).join(F.broadcast(parts), PART, "left_semi"))  # at most periods x buckets rows
        if swapped:
            # the files that are read go when the job is done; rows come dealt by symbol, so each task sorts its own by partition and none are exchanged
            rows.write.partitionBy(*PART).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/adjusted")
        fresh.write.mode("append").parquet(f"{self.path}/actions")

        new_heads = ends.select("symbol", F.greatest("hi", F.coalesce("last_day", "hi")).alias("last_day"))
        others = [] if heads is None else [heads.join(new_heads, "symbol", "left_anti").select("symbol", "last_day")]
        stage.write(reduce(DataFrame.unionByName, others, new_heads)).write.mode("overwrite").parquet(f"{self.path}/heads")
        version = 1 if log is None else (log.agg(F.max("version")).first()[0] or 0) + 1
        days = bars.agg(F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
        row = days.select(F.lit(version).cast("long").alias("version"), F.lit(anew.count()).cast("long").alias("symbols"), F.lit(swapped).cast("long").alias("partitions"), "rows", "first_day", "last_day")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def _in(self, stored: DataFrame, parts: DataFrame) -> DataFrame:
        """The stored rows of some partitions, of which alone files are read."""
        found = parts.collect()  # at most periods x buckets rows
        name = lambda p, b: F.concat_ws("/", p, b.cast("string"))
        return stored.where(name(F.col("period"), F.col("bucket")).isin([f"{r['period']}/{r['bucket']}" for r in found]))


def _digests(rows: DataFrame, sign: int) -> DataFrame:
    """(period, bucket, n, h1, h2): of each partition its rows' number, times sign, and two digests that do not depend on their order. Rows are unique by key, so
    that none cancels another."""
    hashed = rows.select(*PART, F.xxhash64(*rows.columns).alias("h1"), F.xxhash64(F.lit(1), *rows.columns).alias("h2"))
    return hashed.groupBy(*PART).agg((F.count(F.lit(1)) * sign).alias("n"), F.expr("bit_xor(h1)").alias("h1"), F.expr("bit_xor(h2)").alias("h2"))


def _unknown(actions: DataFrame, known: DataFrame) -> DataFrame:
    """Actions that the store doesn't hold yet."""
    key = F.struct(*ACTION)  # structs match with null fields too
    return actions.withColumn("k", key).join(known.select(key.alias("k")), "k", "left_anti").drop("k")
