"""Near-duplicates by the Jaccard similarity of word shingles: candidates by SimHash and by MinHash bands, verified exactly.

This is the mode of the SimHash operator for a given similarity. Texts are cut into shingles as in simhash; a text's set is the set of its
shingles' 64-bit hashes, and texts of equal sets are one node, named by a 128-bit digest of the set. The first candidates are what the
operator's pigeonring search links, fingerprints of at most DISTANCE differing bits. At 0.8 fingerprints differ in some ten of 64 bits, too many
for its keys, so further candidates complete the search: nodes that agree in all ROWS values of one of BANDS bands of MinHash values. A
pair of similarity s is missed by the bands alone with probability (1 - s^3)^20, 6e-7 at 0.8 and less above. Every edge of either is
verified on whole sets, so that no pair below the threshold is linked.

First the pairs of the SimHash search are verified, and each node is compared with one representative, the least node of its buckets, which is
linear work and joins what large groups of near copies hold. Only buckets that still hold several parts are then searched pair by pair, but for pairs of one part; buckets
over BLOCK nodes or BLOCK_BYTES of sets are cut into pairs of blocks that other tasks take, so a task holds two blocks however long texts are.
Bucket keys and nodes that hold very many rows are dealt over many tasks wherever their rows are joined.

Defined results: null and empty texts, and texts without words, have the empty set and are one group; fewer words than a shingle
form one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from . import simhash
from .common import Stage, hot_keys, ship, slices, split_join
from .simhash import components

ROWS = 3
BANDS = 20
BLOCK = 256
BLOCK_BYTES = 16 << 20
_A = np.array([xxh64_intdigest(b"a%d" % i) & 0xFFFFFFFF | 1 for i in range(BANDS * ROWS)], np.uint32)[:, None]
_B = np.array([xxh64_intdigest(b"b%d" % i) & 0xFFFFFFFF for i in range(BANDS * ROWS)], np.uint32)[:, None]


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(simhash.shingle_hashes(text, words))


def bands(grams: np.ndarray) -> list[int]:
    """A key for each band, as signed longs; none for the empty set."""
    if not len(grams):
        return []
    x, least = (grams >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, len(x), 8192):  # bounded memory on very long texts
        part = (x[None, k : k + 8192] * _A + _B).min(1)
        least = part if least is None else np.minimum(least, part)
    values = least.reshape(BANDS, ROWS)
    return [xxh64_intdigest(values[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of percent / 100 or more."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def signatures(docs: DataFrame, *, words: int, id_col: str = "doc_id", text_col: str = "text", keys=bands, fingerprints: bool = False) -> DataFrame:
    """(id, text_md5, node, size, keys) of every row. keys: the bucket keys of a set, signed longs; fingerprints: with the SimHash fingerprint as fp."""

    def run(batches):
        for b in slices(batches):
            hashes = [simhash.shingle_hashes(t, words) for t in b.column(2).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            node, size = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(map(len, sets), pa.int64())
            out = [b.column(0), b.column(1), node, size, pa.array(map(keys, sets), pa.list_(pa.int64()))]
            if fingerprints:
                out.append(pa.array(np.fromiter(map(simhash.majority, hashes), np.uint64, len(hashes)).view(np.int64)))
            yield pa.RecordBatch.from_arrays(out, [id_col, "text_md5", "node", "size", "keys", "fp"][: len(out)])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.md5(text_col).alias("text_md5"), text_col).mapInArrow(run, f"{id_col} {kind}, text_md5 string, node binary, size long, keys array<long>{', fp long' if fingerprints else ''}")


def _forest(left: list, right: list | None, percent: int) -> list[tuple[bytes, bytes]]:
    """Verified edges that join parts of a bucket of (node, part, set): within one block, or between two."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for i, (x, c, a) in enumerate(left):
        for y, d, b in left[:i] if right is None else right:
            if (p := root(c)) != (q := root(d)) and similar(a, b, percent):
                parent[p] = q
                edges.append((min(x, y), max(x, y)))
    return edges


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, grams, other) that reach the similarity, as edges (a, b)."""

    def run(batches):
        for b in slices(batches):
            sets = [[np.frombuffer(g, np.uint64) for g in b.column(i).to_pylist()] for i in (2, 3)]
            ok = [k for k, (x, y) in enumerate(zip(*sets, strict=True)) if similar(x, y, percent)]
            at = pa.array(ok, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    return pairs.select("a", "b", "grams", "other").mapInArrow(run, "a binary, b binary")


def links(nodes: DataFrame, docs: DataFrame, stage: Stage, *, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(a, b): verified edges that connect whatever candidates reach the similarity. nodes: (node, row, size, keys), with one row of each node; found:
    further candidates (a, b), the lesser first."""
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    sizes = stage.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("rep")).where("n > 1"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("bytes") / BLOCK_BYTES)).cast("int")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = stage.write(split_join(keyed.drop("size"), sizes.select("key", "rep", blocks.alias("blocks")), "key", hot_keys(sizes, "key", total), "node"))
    met = rows.select("node") if found is None else rows.select("node").unionByName(found.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = stage.write(nodes.select("node", "row").join(met.distinct(), "node"))
    texts = docs.select(F.struct(id_col, F.md5(text_col).alias("text_md5")).alias("row"), text_col).join(wanted, "row").select("node", text_col)

    def cut(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "grams"])

    sets = stage.write(texts.mapInArrow(cut, "node binary, grams binary").dropDuplicates(["node"]))

    stars = rows.where("node <> rep").groupBy("node").agg(F.min("rep").alias("rep"))
    stars = stage.write(stars if found is None else stars.unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("rep"))).distinct())
    hot, often = (hot_keys(stars.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, stars.count()) for c in ("rep", "node"))
    pairs = split_join(split_join(stars, sets, "node", often, "rep"), sets.select(F.col("node").alias("rep"), F.col("grams").alias("other")), "rep", hot, "node")
    first = stage.write(_verified(pairs.select(F.col("rep").alias("a"), F.col("node").alias("b"), "grams", "other"), percent))
    # each node's representative, or that one's own, names its part: nodes of one part are linked, be it that some parts are linked as well
    up = first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("rep"))
    parts = split_join(up, up.select(F.col("node").alias("rep"), F.col("rep").alias("top")), "rep", hot, "node", "left").select("node", F.coalesce("top", "rep").alias("part"))
    members = stage.write(rows.join(parts, "node", "left").select("key", "node", "blocks", F.coalesce("part", "node").alias("part")))
    open_ = members.groupBy("key").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("key")
    hot = hot_keys(sizes, "key", total)
    left = stage.write(split_join(members, open_, "key", hot, "node").select("key", "node", "part", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    stage.drop(sizes, rows, wanted, stars, members)
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("lo"), F.greatest(j, F.col("block")).alias("hi")))
    often = left.groupBy("node").agg(F.sum("blocks").alias("n"))
    hot = hot_keys(often, "node", left.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"])
    pairs = left.select("key", "node", "part", "block", F.explode(ends).alias("pair"))
    asked = split_join(pairs, sets, "node", hot, F.struct("key", "pair")).select("key", "pair.lo", "pair.hi", "block", "node", "part", "grams")

    def run(batches):
        now, found = None, {}

        def close():
            some = found.get(now[1], [])
            return _forest(some, None if now[1] == now[2] else found.get(now[2], []), percent)

        for b in slices(batches):
            out = []
            for key, lo, hi, block, node, part, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, lo, hi) != now:
                    out += close() if now else []
                    now, found = (key, lo, hi), {}
                found.setdefault(block, []).append((node, part, np.frombuffer(grams, np.uint64)))
            if out:
                yield _edges(out)
        if now and (out := close()):
            yield _edges(out)

    dealt = asked.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return first.unionByName(dealt.mapInArrow(run, "a binary, b binary")).distinct()


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_md5, root) of every row: rows share a root where a chain of similarities of percent / 100 or more links their texts."""
    stage = Stage(docs.sparkSession, "jaccard")
    signed = stage.write(signatures(docs, words=words, id_col=id_col, text_col=text_col, fingerprints=True))
    nodes = stage.write(signed.groupBy("node").agg(F.min(F.struct(id_col, "text_md5")).alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")))
    keyed = nodes.where(F.size("keys") > 0).drop("n")
    found = simhash.candidates(keyed.select("node", "fp"), stage)
    roots = components(links(keyed, docs, stage, words=words, percent=percent, id_col=id_col, text_col=text_col, found=found), stage).withColumnRenamed("root", "_root")
    copies = hot_keys(nodes, "node", signed.count())
    return split_join(signed.drop("keys", "fp"), roots, "node", copies, F.monotonically_increasing_id(), "left").select(id_col, "text_md5", F.coalesce("_root", "node").alias("root"))
