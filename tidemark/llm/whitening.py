"""Whitening of embeddings by the singular values of their centred rows.

1. Vectors become integers, x = floor(scale * entry) + shift; one pass sums each dimension exactly and keeps its least and largest value.
2. Each row's deviation, the sum over dimensions of (n * x - S)^2, is exact: in 64 bits where the dimensions' ranges prove that it fits,
   else as a decimal of 38 digits. Their sum over rows, divided by n^3, is the total variance, which therefore doesn't depend on
   how many components are computed.
3. The rows (n * x - S) / n are a distributed MLlib RowMatrix of JVM vectors. computeSVD asked for all dimensions sums their Gramian by
   a tree and decomposes it; singular values by the root of n are the components' deviations, so the covariance's divisor is n.
4. Rows are projected in Arrow batches by one small matrix (dimensions x components), which is all that the driver and the tasks hold
   besides their rows. A second RowMatrix over the whitened rows, centred anew, checks that their covariance is the identity.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries take no part, nor do rows of another length
than most rows have (of equally frequent lengths the longest); repeated rows and null ids are rows like any other; components whose
variance is under LEAST of the largest one's count as absent (so constant dimensions, fewer rows than dimensions and equal rows
give fewer components, and rows that are all equal none and so no result rows); equal eigenvalues have any basis of their
space; an empty table gives an empty result; a deviation beyond 64 bits raises an error in the query, and is a decimal in fit();
other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, ship, slices, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LEAST = 1e-10
LONG = (1 << 63) - 1


class Whitening(NamedTuple):
    """What a fit found: n rows, the sums by dimension, the components as columns, their eigenvalues and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float


def integers(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x array<long>) of the rows that take part, before lengths are compared."""
    v = F.col(f"`{vector_col}`")
    whole = F.size(v) > 0
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(v.isNotNull() & whole & finite).select(F.col(f"`{id_col}`"), F.transform(v, lambda c: F.floor(scale * c.cast("double")) + F.lit(shift)).alias("x"))


def _of_common_length(rows: DataFrame) -> DataFrame | None:
    """The rows of the most frequent length, None where there are none."""
    best = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return None if best is None else rows.where(F.size("x") == best["d"])


def _centred(x: Column, n: int, sums: list[int]) -> Column:
    """n * x - S by dimension, exact."""
    return F.zip_with(x, F.array(*[F.lit(s) for s in sums]), lambda a, s: a * F.lit(n) - s)


def _matrix(rows: DataFrame, column: Column, n: int, d: int) -> RowMatrix:
    """A distributed matrix of an array column, without Python: MLlib's vectors are made in the JVM."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("row")), "row"), n, d)


def fit(rows: DataFrame, *, components: int = COMPONENTS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of (id, x), and the rows with their exact deviation; None where there are no rows."""
    dims = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    found = sorted(dims.collect())  # one row a dimension
    if not found:
        return None
    n, sums = found[0]["n"], [r["s"] for r in found]
    bound = sum(max(abs(n * r["lo"] - r["s"]), abs(n * r["hi"] - r["s"])) ** 2 for r in found)
    kind = "long" if bound <= LONG else "decimal(38,0)"
    off = _centred(F.col("x"), n, sums)
    told = rows.withColumn("deviation", F.aggregate(F.transform(off, lambda v: v.cast(kind) * v.cast(kind)), F.lit(0).cast(kind), lambda a, v: (a + v).cast(kind)))
    whole = told.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("t")).first()["t"]
    total, d = float(whole) / float(n) ** 3, len(sums)
    if not whole:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0), told
    found = _matrix(rows, F.transform(off, lambda v: v.cast("double") / F.lit(float(n))), n, d).computeSVD(d, False, LEAST**0.5)
    eigenvalues = np.array(found.s.toArray()) ** 2 / n
    kept = min(components, len(eigenvalues))
    return Whitening(n, sums, found.V.toArray()[:, :kept], eigenvalues[:kept], total), told


def transform(rows: DataFrame, model: Whitening, *, id_col: str) -> DataFrame:
    """The rows (id, x, deviation) with `whitened`: an array of one value a component."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_col, "deviation")}
    scaled, n, sums = model.components / np.sqrt(model.eigenvalues), model.n, np.array(model.sums, np.int64)

    def run(batches):
        for b in slices(batches, 4096):
            off = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(sums)) * n - sums  # exact while n * x fits 63 bits
            white = off.astype(np.float64) / n @ scaled
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], [id_col, "deviation", "whitened"])

    ship(rows.sparkSession)
    return rows.select(F.col(f"`{id_col}`"), "x", "deviation").mapInArrow(run, f"`{id_col}` {kinds[id_col]}, deviation {kinds['deviation']}, whitened array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (centred, divisor n) minus the identity."""
    means = [r["m"] for r in sorted(white.select(F.posexplode("whitened").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).collect())]  # one row a component
    again = F.zip_with("whitened", F.array(*[F.lit(m) for m in means]), lambda v, m: v - m)
    gram = _matrix(white, again, n, k).computeGramianMatrix().toArray()
    return float(np.abs(gram / n - np.eye(k)).max())


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[Whitening, DataFrame, float] | None:
    """The model, the rows (id, deviation, whitened) and the identity's error; None without rows."""
    stage = Stage(vectors.sparkSession, "whitening")
    rows = _of_common_length(stage.write(integers(vectors, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift)))
    found = fit(rows, components=components) if rows is not None else None
    if found is None:
        return None
    model, told = found
    white = stage.write(transform(told, model, id_col=id_col))
    k = len(model.eigenvalues)
    return model, white, identity_error(white, model.n, k) if k else 0.0


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = whiten(vectors)
    if found is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model, white, error = found
    shares = F.array(*[F.lit(float(e / model.total)) for e in model.eigenvalues]) if len(model.eigenvalues) else F.array().cast("array<double>")
    each = white.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), shares.alias("e"))).alias("at", "of"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("of.w").alias("whitened"), F.col("of.e").alias("explained"), F.lit(error).alias("identity_error"))
