"""What the training-data operators share: reading tables, cutting lineage, names that do not clash, and joins on keys with very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import Stage
from ..workers import ship

__all__ = ["Stage", "hot_keys", "ship", "slices", "split_join", "table", "unused", "without"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; further columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def slices(batches, rows: int = 500):
    """Arrow batches, which Spark bounds by bytes, cut to few rows: what a worker unpacks at once stays small however long texts are."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that are columns of df (in any case) already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """df without the columns that have an output's name: an operator's own outputs take their place."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {o.lower() for o in outputs}])


HOT_SHARE = 64
HOT_LEAST = 256


def _one(keys: list[str]) -> Column:
    """What tells a key: its column, or a hash of its columns."""
    return F.col(keys[0]) if len(keys) == 1 else F.xxhash64(*keys)


def hot_keys(counted: DataFrame, key: str | list[str], rows: int) -> list:
    """The keys that hold more than a HOT_SHARE-th of `rows` rows: fewer than HOT_SHARE, so they may go to the driver. counted: key columns, n."""
    keys = [key] if isinstance(key, str) else key
    return [r[0] for r in counted.where(F.col("n") > max(HOT_LEAST, rows // HOT_SHARE)).select(_one(keys)).collect()]


def split_join(rows: DataFrame, facts: DataFrame, key: str | list[str], hot: list, spread: Column | str, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has few rows of each key, on key ("inner" or "left"). The rows of a hot key are dealt over
    HOT_SHARE tasks by `spread`, and only that key's facts are repeated for them."""
    keys = [key] if isinstance(key, str) else key
    if not hot:
        return rows.join(facts, keys, how)
    is_hot = _one(keys).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(HOT_SHARE))).otherwise(F.lit(0).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(HOT_SHARE - 1).cast("long"))
    repeated = facts.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0).cast("long")))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
