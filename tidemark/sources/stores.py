"""Sinks and stores: immutable raw files with a manifest, year-partitioned curated tables, append-only ledgers, integrity checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of intact files by extension.
MAGIC = {"zip": ["504B0304"], "json": ["7B", "5B"], "parquet": ["50415231"]}


class ImmutableError(FileExistsError):
    """A raw path is written once."""


def write_raw(df: DataFrame, path: str) -> None:
    """Writes once; an existing path is refused."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise ImmutableError(f"{path} already exists") from e
        raise


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sha256, size) of raw files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def corrupt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files whose first bytes are not their extension's (block pages, truncated downloads), and empty ones."""
    f = spark.read.format("binaryFile").load(paths).select("path", "length", F.hex(F.substring("content", 1, 8)).alias("head"))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    fits = F.lit(False)
    for ext, heads in MAGIC.items():
        for h in heads:
            fits = fits | ((kind == ext) & F.col("head").startswith(h))
    known = kind.isin(list(MAGIC))
    return f.where((F.col("length") == 0) | (known & ~fits)).select("path", "length", "head")


def write_years(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """Writes the years that the frame holds and leaves the other years' partitions as they are."""
    df.withColumn("year", F.year(date)).repartition("year").write.partitionBy("year").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_years(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A table written by years, of which only the partitions from `first` to `last` are listed and read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("year") >= first)
    if last is not None:
        df = df.where(F.col("year") <= last)
    return df.drop("year")


def stale_years(raw_dates: DataFrame, built: DataFrame, date: str = "trade_date") -> DataFrame:
    """Years whose curated last date or number of dates differ from the raw files'."""
    side = lambda df, n: df.groupBy(F.year(date).alias("year")).agg(F.max(date).alias(f"{n}_max"), F.countDistinct(date).alias(f"{n}_days"))
    both = side(raw_dates, "raw").join(side(built, "built"), "year", "left")
    return both.where(~F.coalesce((F.col("raw_max") == F.col("built_max")) & (F.col("raw_days") == F.col("built_days")), F.lit(False)))


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a JSON-lines ledger."""
    df.write.mode("append").json(path)


def trial_count(spark: SparkSession, path: str) -> int:
    """How many rows a JSON-lines ledger has; 0 if there is none yet."""
    try:
        return spark.read.schema("model string").json(path).count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def write_report(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A report as parquet, csv (with a header) or json; an earlier one at the path is replaced."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": writer.option("header", True).csv, "json": writer.json}[kind](path)


def not_yet_run(days: DataFrame, log: DataFrame) -> DataFrame:
    """Session days (trade_date) that a run log (trade_date, dry_run) does not hold a real run of: a rerun of a logged day finds none."""
    done = log.where("not coalesce(dry_run, false)").select("trade_date")
    return days.join(done, "trade_date", "left_anti")


def new_items(items: DataFrame, seen: DataFrame, key: str = "link_hash") -> DataFrame:
    """Items that the store does not hold, one a key."""
    return items.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def work_list(days: DataFrame, have: DataFrame, key: str = "day") -> DataFrame:
    """What a backfill still has to fetch."""
    return days.join(have, key, "left_anti")
