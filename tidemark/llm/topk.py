"""Exact top-k inner products by no-random-access aggregation over sorted component lists.

Vectors are dealt into candidate blocks and queries into query blocks; each pair of blocks is one group, and both kinds of
block have a fixed size, so no task's memory grows with the input. A block sorts each component once; a query reads those lists from
the end that its sign prefers. What it has read gives each row a lower bound (unread components at their list's worst) and an
upper bound (unread ones at the list's frontier). It stops at the depth where a row not yet met could not reach the threshold,
the k-th best lower bound so far or the k-th best score of a small seed block; rows whose upper bound reaches it are then resolved to final scores. Equal
scores go to the smaller vec_id.

Whole components may be of any size: bounds are then kept in floating point with a margin above their rounding, and final scores are
sums of exact integers.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a shorter vector counts as
padded with zeros; rows that repeat a query's vec_id are not its candidates, and a repeated query row is answered once; repeated
candidate rows rank each on their own; null ids are no queries, but candidates after all others of their score; scores beyond a
long count as its bounds; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, ship, slices, table

ROWS = 4096
QUERIES = 512
FIRST_READ = 64
SEED = 512


EXACT = 2**53
LONG = 2**63 - 1


class Lists:
    """One block's sorted component lists, each from its largest and from its smallest value.

    vectors holds whole numbers, as float64 or, where they are large, as Python integers."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, nameless: np.ndarray | None = None):
        nameless = np.zeros(len(ids), bool) if nameless is None else nameless
        order = np.lexsort((ids, nameless))
        self.ids, self.nameless, self.whole, self.unit = ids[order], nameless[order], None, 1
        vectors = vectors[order]
        if vectors.dtype == object:
            self.whole, self.unit = vectors, max(1, int(np.abs(vectors).max()))
            vectors = (vectors / self.unit).astype(np.float64)
        self.vectors = vectors
        self.most = float(np.abs(self.vectors).max()) * self.unit
        up = np.argsort(self.vectors, axis=0, kind="stable").T
        self.rows = {False: np.ascontiguousarray(up), True: np.ascontiguousarray(up[:, ::-1])}
        self.values = {k: np.ascontiguousarray(np.take_along_axis(self.vectors.T, r, 1)) for k, r in self.rows.items()}

    def top(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the block's rows that may be among the k best, best first; rows under `floor` may be missing."""
        exact = query.dtype != object and self.whole is None and len(query) * np.abs(query).max() * self.most < EXACT
        asked, margin = query, 0.0
        if not exact:
            asked = np.array([int(x) for x in query], object)
            size = max(1, int(np.abs(asked).max()))
            query, margin, unit = (asked / size).astype(np.float64), 8 * len(query) * 2.0**-52, size * self.unit
            margin *= len(query) * (1.0 if self.whole is not None else max(1.0, self.most))
            floor = min(floor / unit if np.isfinite(floor) else floor, LONG / unit)
        n, falls, rises = len(self.ids), np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        sides = [(True, falls), (False, rises)]
        frontier = sum(query[d] @ self.values[side][d] for side, d in sides)
        weight = np.concatenate([query[falls], query[rises]])
        worst = np.concatenate([self.values[side][d, -1] for side, d in sides]) * weight
        is_own = (self.ids == own) & ~self.nameless
        depth, told = FIRST_READ, floor > -np.inf
        while True:
            # a threshold told beforehand fixes the depth where no row that is not met can reach it
            depth = min(n, int(np.searchsorted(-frontier, -(floor - margin), "right")) + 1 if told else depth)
            rows = np.concatenate([self.rows[side][d, :depth] for side, d in sides]).ravel()
            parts = np.concatenate([self.values[side][d, :depth] for side, d in sides]) * weight[:, None]
            edge = parts[:, -1]
            # what is read replaces the frontier (the worst value) in the upper (lower) bound
            upper = edge.sum() + np.bincount(rows, (parts - edge[:, None]).ravel(), n)
            if not told and n - is_own.sum() > k:
                lower = worst.sum() + np.bincount(rows, (parts - worst[:, None]).ravel(), n)
                lower[is_own] = -np.inf
                reached = np.partition(lower, -k)[-k]
                floor = max(floor, reached if exact else min(reached, LONG / unit))
            if told or depth == n or edge.sum() < floor - margin:
                break
            depth *= 2
        at = np.flatnonzero((upper >= floor - margin) & ~is_own)
        if exact:
            scores = (self.vectors[at] @ query).astype(np.int64)
        else:
            whole = self.vectors[at].astype(np.int64).astype(object) if self.whole is None else self.whole[at]
            scores = np.array([max(-LONG - 1, min(LONG, int(v @ asked))) for v in whole], np.int64)
        best = np.lexsort((self.ids[at], self.nameless[at], ~scores))[:k]
        return at[best], scores[best]


def _packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, large), only of rows that take part. v: whole components as little-endian 32-bit words, or, where one does not fit
    (large), the components themselves as 64-bit floats."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.size("x") > 0).where(~F.exists("x", bad))

    def run(batches):
        for b in slices(batches):
            x = b.column(1)
            flat, ends = x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
            whole, v, large = np.floor(flat * scale), [], []
            fits = np.abs(whole) < 2**31
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                large.append(not fits[i:j].all())
                v.append(flat[i:j].astype("<f8").tobytes() if large[-1] else whole[i:j].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), pa.array(large, pa.bool_())], ["vec_id", "v", "large"])

    return whole.mapInArrow(run, "vec_id long, v binary, large boolean")


def _matrix(column: pd.Series, large: pd.Series, dims: int, scale: int) -> np.ndarray:
    some = large.any()
    out = np.zeros((len(column), dims), object if some else np.float64)
    for i, (v, is_large) in enumerate(zip(column, large, strict=True)):
        x = np.frombuffer(v, "<f8" if is_large else "<i4")
        out[i, : len(x)] = [math.floor(Fraction(c) * scale) for c in x.tolist()] if is_large else x.tolist() if some else x
    return out


def _search(pairs: DataFrame, k: int, scale: int) -> DataFrame:
    """pairs: (cb, qb, is_query, vec_id, nameless, v, large, floor) -> each query's best rows of each candidate block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dims = max(len(v) // (8 if large else 4) for v, large in zip(group["v"], group["large"], strict=True))
        ask = group[group["is_query"]]
        have = group[~group["is_query"]]
        out = []
        if len(have) and len(ask):
            lists = Lists(_matrix(have["v"], have["large"], dims, scale), have["vec_id"].to_numpy(np.int64), have["nameless"].to_numpy(bool))
            for own, q, floor in zip(ask["vec_id"].to_numpy(np.int64), _matrix(ask["v"], ask["large"], dims, scale), ask["floor"], strict=True):
                at, scores = lists.top(q, int(own), k, floor)
                out.append(pd.DataFrame({"query_id": own, "vec_id": pd.arrays.IntegerArray(lists.ids[at], lists.nameless[at]), "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})

    return pairs.groupBy("cb", "qb").applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id is divisible by `every`."""
    ship(vectors.sparkSession)
    stage = Stage(vectors.sparkSession, "topk")
    packed = stage.write(_packed(vectors, id_col, vector_col, scale))
    n = packed.count()
    blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-n // (every * QUERIES)))
    given = [F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("nameless"), "v", "large"]
    no_floor = F.lit(float("-inf")).alias("floor")
    rows = packed.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("cb"), F.lit(False).alias("is_query"), *given, no_floor)
    asked = packed.where(F.col("vec_id") % every == 0).distinct().select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("qb"), F.lit(True).alias("is_query"), *given)
    all_q, all_c = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    columns = ["cb", "qb", "is_query", "vec_id", "nameless", "v", "large", "floor"]
    few = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks * (ROWS // SEED or 1))) == 0
    seed_rows = rows.where(few).withColumn("cb", F.lit(0)).withColumn("qb", all_q).select(columns)
    seed = stage.write(_search(seed_rows.unionByName(asked.withColumns({"cb": F.lit(0), "floor": F.lit(float("-inf"))}).select(columns)), k, scale))
    floors = seed.groupBy("query_id").agg(F.when((F.count("score") >= k) & (F.min("score") > -LONG - 1), F.min("score").cast("double")).alias("seeded"))
    told = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").drop("query_id").withColumn("floor", F.coalesce("seeded", F.lit(float("-inf"))))
    every_pair = rows.withColumn("qb", all_q).select(columns).unionByName(told.withColumn("cb", all_c).select(columns))
    found = _search(every_pair, k, scale)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
