"""MinHash near-duplicates by min-max hashing.

A text's set is the set of the 64-bit hashes of its distinct shingles. Under each of HASHES permutations the sketch keeps both the least and
the largest value of the set: either agrees between two sets with a probability of their Jaccard similarity s, so HASHES evaluations
give 2 * HASHES unbiased values, and as a set's minimum and maximum fall on different shingles their mean varies less than that of as many
independent minima. Bands take the minima and maxima of PER_BAND permutations: a pair of similarity s misses all BANDS bands with a probability of
(1 - s^4)^20, 4e-7 at 0.85 and less above.

Texts of equal sets are one node. Candidates are verified on their whole sets (by the search that the SimHash operator's similarity mode uses
as well: one representative a bucket first, then blocks of what is still apart), so no pair below the threshold is linked, and
components follow from verified links only.

Defined results: null and empty texts and texts without words have the empty set (n_shingles 0) and are linked with nothing; fewer
words than a shingle are one shingle; rows of equal sets share a component, be they repeated or copies; null ids are kept and never become a
component's id unless all of its ids are null, and such rows count as kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import jaccard
from .common import Stage, hot_keys, split_join, table
from .simhash import components

WORDS = 5
PERCENT = 85
PER_BAND = 2
BANDS = 20
HASHES = PER_BAND * BANDS
_A = np.array([xxh64_intdigest(b"minmax a%d" % i) & 0xFFFFFFFF | 1 for i in range(HASHES)], np.uint32)[:, None]
_B = np.array([xxh64_intdigest(b"minmax b%d" % i) & 0xFFFFFFFF for i in range(HASHES)], np.uint32)[:, None]


def sketch(grams: np.ndarray) -> np.ndarray:
    """The least and the largest value of a set that isn't empty under each permutation: HASHES rows of two."""
    x, low, high = (grams >> np.uint64(32)).astype(np.uint32), None, None
    for k in range(0, len(x), 8192):  # bounded memory on very long texts
        values = x[None, k : k + 8192] * _A + _B
        lo, hi = values.min(1), values.max(1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.stack([low, high], 1)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity that two sketches tell: the share of their minima and maxima that agree."""
    return float((a == b).mean())


def bands(grams: np.ndarray) -> list[int]:
    """A key for each band, as signed longs; none for the empty set."""
    if not len(grams):
        return []
    values = sketch(grams).reshape(BANDS, 2 * PER_BAND)
    return [xxh64_intdigest(values[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: component_id is the smallest id that links reach, itself included."""
    stage = Stage(docs.sparkSession, "minhash")
    signed = stage.write(jaccard.signatures(docs, words=words, id_col=id_col, text_col=text_col, keys=bands))
    some = signed.where("size > 0")
    nodes = stage.write(some.groupBy("node").agg(F.min(F.struct(id_col, "text_md5")).alias("row"), F.min(id_col).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n")))
    roots = components(jaccard.links(nodes.select("node", "row", "size", "keys"), docs, stage, words=words, percent=percent, id_col=id_col, text_col=text_col), stage).withColumnRenamed("root", "_root")
    rooted = stage.write(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("_root", "node").alias("root")))
    least = stage.write(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = stage.write(split_join(rooted, least.drop("n"), "root", hot_keys(least, "root", rooted.count()), "node").select("node", "component_id"))
    copies = hot_keys(nodes, "node", some.count())
    stage.drop(nodes, rooted, least)
    linked = split_join(some.drop("keys"), named, "node", copies, F.monotonically_increasing_id()).select(id_col, F.col("size").alias("n_shingles"), "component_id")
    alone = signed.where("size = 0").select(id_col, F.col("size").alias("n_shingles"), F.col(id_col).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.y, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id
"""
