"""SimHash near-duplicates, found by pigeonring filtering.

Fingerprint: texts are lower-cased in A-Z, split into words at ASCII white space and shingled; each bit of the fingerprint is
the majority of that bit over the XXH64 (seed 42) hashes of all shingles, repeats included.

Links: two fingerprints within `distance` = 4 bits, cut into a ring of 5 segments, have a segment from which every chain of l
consecutive segments differs in at most l * 4 / 5 bits (strong pigeonring principle). So the first segment is equal, the
first two differ in at most 1 bit, and of the three parts of the second segment two are equal: that gives 15 equi-join keys of
about 21 bits per distinct fingerprint. Within a key's bucket the remaining chain budgets (2 bits over three segments, 3 over
four) are tested before the full Hamming check, and only edges that join two parts of the bucket are emitted, never all
pairs. Buckets over BLOCK fingerprints are cut into pairs of blocks that other tasks take. Copies never meet: only distinct
fingerprints are keyed.

Components: alternating large-star and small-star steps over the fingerprints' edges, each written to the shared folder.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like any other; fewer words than
a shingle form one shingle; equal rows share a component; null ids are kept and never become a component's id unless all of
its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Stage, hot_keys, ship, slices, split_join, table

SEGMENTS = 5
DISTANCE = 4
BLOCK = 2048
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WIDTHS = [13, 13, 13, 13, 12]
_SHIFTS = [51, 38, 25, 12, 0]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of the text's shingles, repeats included."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255 * 64):  # bounded memory on very long texts
        bits = np.unpackbits(hashes[k : k + 255 * 64].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit majority of the shingles' hashes."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed long."""

    def run(batches):
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def _segment(i: int):
    i %= SEGMENTS
    return F.shiftrightunsigned("fp", _SHIFTS[i]).bitwiseAND(F.lit((1 << _WIDTHS[i]) - 1))


def _keys():
    """Per chain start i: segment i with two of the three parts of segment i + 1."""
    out = []
    for i in range(SEGMENTS):
        width = _WIDTHS[(i + 1) % SEGMENTS]
        a, b = width // 3, 2 * width // 3
        parts = [(1 << a) - 1, (1 << b) - (1 << a), (1 << width) - (1 << b)]
        for gone in range(3):
            mask = ((1 << width) - 1) ^ parts[gone]
            tag = i * 3 + gone
            out.append(F.lit(tag << 26) + F.shiftleft(_segment(i), 13) + _segment(i + 1).bitwiseAND(F.lit(mask)))
    return F.array(*out)


def _linked(tag: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within budget: the chain from the key's segment first, then all bits."""
    start = tag // 3
    seg = lambda x, i: (x >> np.uint64(_SHIFTS[i % SEGMENTS])) & np.uint64((1 << _WIDTHS[i % SEGMENTS]) - 1)
    rows = np.repeat(np.arange(len(a)), len(b))
    cols = np.tile(np.arange(len(b)), len(a))
    spent = np.zeros(len(rows), np.uint8)
    for chain in range(1, SEGMENTS):
        spent = spent + np.bitwise_count(seg(a[rows], start + chain) ^ seg(b[cols], start + chain))
        ok = spent * SEGMENTS <= (chain + 1) * DISTANCE
        rows, cols, spent = rows[ok], cols[ok], spent[ok]
    near = np.bitwise_count(a[rows] ^ b[cols]) <= DISTANCE
    return rows[near], cols[near]


def _forest(tag: int, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the bucket's links (between two blocks, or within one)."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges, other, step = [], left if right is None else right, max(1, 400_000 // max(1, len(left if right is None else right)))
    for k in range(0, len(left), step):
        rows, cols = _linked(tag, left[k : k + step], other)
        for x, y in zip(left[k + rows].view(np.int64).tolist(), other[cols].view(np.int64).tolist(), strict=True):
            if x != y and (p := root(x)) != (q := root(y)):
                parent[p] = q
                edges.append((x, y))
    return edges


def links(fps: DataFrame, stage: Stage) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect whatever lies within DISTANCE bits."""
    keyed = fps.select("fp", F.explode(_keys()).alias("key"))
    sizes = stage.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    hot = hot_keys(sizes, "key", sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    rows = split_join(keyed, sizes.drop("n"), "key", hot, "fp").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = rows.select("key", "fp", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("lo"), F.greatest(j, F.col("block")).alias("hi")))).alias("pair"))
    pairs = pairs.select("key", "pair.lo", "pair.hi", "block", "fp")

    def run(batches):
        def close(key, lo, hi, found):
            left = np.array(found[lo], np.int64).view(np.uint64)
            right = None if lo == hi else np.array(found.get(hi, []), np.int64).view(np.uint64)
            return _forest(key >> 26, left, right) if len(left) else []

        now, found, out = None, {}, []
        for b in slices(batches):
            for key, lo, hi, block, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, lo, hi) != now:
                    if now:
                        out += close(*now, found)
                    now, found = (key, lo, hi), {lo: []}
                found.setdefault(block, []).append(fp)
            if out:
                yield _edges(out)
                out = []
        if now:
            out = close(*now, found)
        if out:
            yield _edges(out)

    dealt = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a.min(1)), pa.array(a.max(1))], ["a", "b"])


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root): the least node that edges (a, b) connect each node to.

    Large-star and small-star steps alternate until every edge leads to its component's least node. A component's least node comes to
    have edges to all of its nodes, so the joins deal the rows of such nodes over many tasks."""
    now = stage.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        hot = hot_keys(least, "u", 2 * now.count())
        large = split_join(both, least.drop("n"), "u", hot, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.write(large.distinct())
        least_too = stage.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        hot = hot_keys(least_too, "u", large.count())
        small = split_join(large, least_too.drop("n"), "u", hot, "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stage.write(small.where("u != v").distinct())
        depth = new.select("v").distinct().join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = new.groupBy("u").count().where("count > 1").limit(1).count() if not depth else 1
        stage.drop(now, least, large, least_too)
        now = new
        if not depth and not many:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): component_id is the smallest id that links reach."""
    stage = Stage(docs.sparkSession, "simhash")
    fps = stage.write(fingerprints(docs, words=words, id_col=id_col, text_col=text_col))
    distinct = stage.write(fps.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), stage), stage)
    rooted = stage.write(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = stage.write(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = stage.write(split_join(rooted, least.drop("n"), "root", hot_keys(least, "root", rooted.count()), "fp").select("fp", "component_id"))
    copies = hot_keys(distinct, "fp", fps.count())
    stage.drop(distinct, rooted, least)
    return split_join(fps, named, "fp", copies, F.monotonically_increasing_id()).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidates(nodes: DataFrame, stage: Stage) -> DataFrame:
    """(a, b): pairs of nodes, the lesser first, that the pigeonring search of their fingerprints links. nodes: (node, fp); those of one fingerprint
    are paired with its least node."""
    fps = stage.write(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    found = stage.write(links(fps.select("fp"), stage).select(F.col("a").alias("fp"), "b"))
    firsts = fps.select("fp", "first")
    named = split_join(found, firsts, "fp", hot_keys(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp", found.count()), "b")
    named = stage.write(named.select(F.col("first").alias("x"), F.col("b").alias("fp")))
    both = split_join(named, firsts, "fp", hot_keys(named.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp", named.count()), "x")
    same = split_join(nodes, firsts, "fp", hot_keys(fps, "fp", nodes.count()), "node").where("node <> first")
    out = stage.write(both.select(F.least("x", "first").alias("a"), F.greatest("x", "first").alias("b")).unionByName(same.select(F.col("first").alias("a"), F.col("node").alias("b"))))
    stage.drop(fps, found, named)
    return out


def similar_texts(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_md5, root): near-duplicates by SimHash whose links are confirmed at a similarity of percent / 100 of whole shingle sets; pairs of that
    similarity whose fingerprints lie over DISTANCE bits apart are added."""
    from . import jaccard

    return jaccard.near_duplicates(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
