"""Conversation prefix trie from mergeable partial tries.

1. Turns are sorted over ranges of (conversation, turn, role, text), so a conversation of any length spreads over tasks; counts by
   (conversation, part) give each turn its position, and the rebuilding rule (heads of a shared conversation) is arithmetic on it.
2. A prefix is keyed by the XOR of 128-bit hashes of its (depth, role, text) entries. XOR is associative, so a conversation's running key is
   made in blocks of BLOCK turns plus what the blocks before it carry.
3. Each task combines its memberships into a partial table of nodes (members, smallest member, words); tables are merged by node key and bucket,
   with fewer buckets each round, until each node is one row. End lists merge likewise: ranges of (node, conversation) become chunks of joined ids, and
   chunks of one node are digested in order, so no list is ever held whole.
4. All nodes with the same smallest member lie on one path, a chain; a chain's head hangs from a node of another chain. The bottom-up rollup
   adds the chains' leaves and saved tokens to the chains they hang from by pointer doubling (as many rounds as the logarithm of
   how deeply chains hang), then sums each chain from its end upwards, in blocks again.

Defined results: rows without a conversation id belong to none and are left out; null role or text is empty; equal turns go by role, then by
text; repeated rows are turns each; a table without conversations has no root and gives an empty result; other columns are ignored. The shared
conversation of c is c - c % SHARE with the sign of c % SHARE that of c, as in SQL.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, hot_keys, ship, slices, split_join, table

BLOCK_BITS = 12
BUCKETS = (16, 1)
CHUNK = 10_000
SHARE, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def sorted_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, a, b, words, at): every turn's hashes and its place in the order of all turns, whose upper bits name the part."""
    given = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = given.sort("conv_id", F.asc_nulls_first("turn"), "role", "text")
    digest = lambda k: F.xxhash64(F.lit(k), "role", "text")
    return in_order.select("conv_id", digest(1).alias("a"), digest(2).alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("at"))


def _part() -> Column:
    return F.shiftright("at", 33)


def rebuilt(turns: DataFrame, stage: Stage, *, share: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n, size) of all conversations and (conv_id, size, depth, a, b, words) of all their rebuilt turns."""
    runs = turns.groupBy("conv_id", _part().alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage.write(runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n")))
    taken = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = runs.where("before = 0").select("conv_id", "n", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    k = F.least("h", F.coalesce("base_n", F.lit(0)))
    facts = stage.write(convs.join(of_base, "base", "left").select("conv_id", "base", "n", "h", k.alias("k"), (k + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")))
    placed = turns.withColumn("part", _part()).join(runs.drop("n").join(facts, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
    own = placed.where("pos >= h").select("conv_id", "size", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "a", "b", "words")
    lead = placed.where((F.col("conv_id") % share == 0) & (F.col("pos") < heads - 1)).select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    shared = facts.where("k > 0").select("conv_id", "base", "k", "size").join(lead, "base").where("pos < k")  # at most `share` rows with `heads` rows
    return facts, own.unionByName(shared.select("conv_id", "size", (F.col("pos") + 1).alias("depth"), "a", "b", "words"))


def memberships(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, ends): each conversation with the keys of all its prefixes and of their parents."""
    entry = [F.xxhash64(F.lit(3), "depth", "a", "b"), F.xxhash64(F.lit(4), "b", "depth", "a")]
    rows = turns.select("conv_id", "size", "depth", "words", entry[0].alias("z1"), entry[1].alias("z2"), F.shiftright(F.col("depth") - 1, BLOCK_BITS).alias("block"))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = rows.withColumns({f"r{i}": F.bit_xor(f"z{i}").over(within) for i in (1, 2)})
    blocks = rows.where(F.col("size") > 1 << BLOCK_BITS).groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("c1"), F.bit_xor("z2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of a conversation
    carry = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"c{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    full = keyed.join(carry, ["conv_id", "block"], "left").withColumns({f"k{i}": F.col(f"r{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)})
    below = full.select("conv_id", "depth", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i in (1, 2)], "words", (F.col("depth") == F.col("size")).alias("ends"))
    zero = F.lit(0).cast("long")
    roots = facts.select("conv_id", *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "words")], (F.col("size") == 0).alias("ends"))
    return below.unionByName(roots)


def merged(members: DataFrame) -> DataFrame:
    """One row a node: partial tables of the tasks, merged by node and bucket in rounds."""
    sums = members.select(*NODE, F.col("conv_id").alias("owner"), F.lit(1).cast("long").alias("n"), "p1", "p2", "words")
    for buckets in BUCKETS:
        keys = [*NODE, "bucket"] if buckets > 1 else NODE
        dealt = sums.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(buckets))) if buckets > 1 else sums
        sums = dealt.groupBy(*keys).agg(F.min("owner").alias("owner"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("p1", "p2", "words")])
    return sums


def end_digests(members: DataFrame, stage: Stage) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the digest of the ids of the conversations that end at a node, ascending and joined by commas."""
    names = [*NODE, "first", "ids", "ends_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "depth long, k1 long, k2 long, first long, ids string, ends_sha256 string"
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def chunks(batches):
        """Nodes that lie within a part are digested; those at its ends, and long lists, become chunks."""
        now, held, open_, out = None, [], True, []

        def close(whole: bool):
            ids = ",".join(map(str, held))
            out.append((*now, held[0], None if whole else ids, hashlib.sha256(ids.encode()).hexdigest() if whole else None))

        for b in slices(batches, 5000):
            for *key, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    if now is not None:
                        close(not open_)
                        open_ = False
                    now, held = key, []
                elif len(held) == CHUNK:
                    close(False)
                    held, open_ = [], True
                held.append(conv)
            if out:
                yield batch(out)
                out = []
        if now is not None:
            close(False)
            yield batch(out)

    def digest(batches):
        now, state = None, None
        for b in slices(batches, 100):
            out = []
            for *key, first, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, None, None, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield batch(out)
        if now is not None:
            yield batch([(*now, None, None, state.hexdigest())])

    ship(members.sparkSession)
    order = ["k1", "k2", "depth"]
    ends = members.where("ends").select(*NODE, "conv_id").repartitionByRange(*order, "conv_id").sortWithinPartitions(*order, "conv_id")
    parts = stage.write(ends.mapInArrow(chunks, schema))
    rest = parts.where("ids is not null").repartition(*order).sortWithinPartitions(*order, "first").mapInArrow(digest, schema)
    return parts.where("ids is null").unionByName(rest).select(*NODE, "ends_sha256")


def chains(nodes: DataFrame, stage: Stage) -> DataFrame:
    """(owner, head, last, up, at): each chain's depths and the node (up, at) that its head hangs from, null for the root's chain."""
    own = stage.write(nodes.groupBy("owner").agg(F.min(F.struct("depth", "p1", "p2")).alias("h"), F.max("depth").alias("last")).select("owner", F.col("h.depth").alias("head"), "last", (F.col("h.depth") - 1).alias("depth"), F.col("h.p1").alias("k1"), F.col("h.p2").alias("k2")))
    hot = hot_keys(own.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")), NODE, own.count())
    hung = split_join(own, nodes.select(*NODE, F.col("owner").alias("up")), NODE, hot, "owner", "left")
    return stage.write(hung.select("owner", "head", "last", "up", F.when(F.col("head") > 0, F.col("head") - 1).alias("at")))


def totals(forest: DataFrame, values: list[str], stage: Stage) -> DataFrame:
    """(owner, values): sums over all chains below and the chain itself, by pointer doubling. forest: owner, up, values.

    After round k a chain's sums hold what hangs from it over fewer than 2^k steps, and its pointer leads 2^k steps up."""
    now = stage.write(forest.select("owner", "up", *values))
    while not (moving := now.where("up is not null")).isEmpty():
        hot = hot_keys(moving.groupBy("up").agg(F.count(F.lit(1)).alias("n")), "up", now.count())
        further = split_join(moving.select("owner", "up"), now.select(F.col("owner").alias("up"), F.col("up").alias("up2")), "up", hot, "owner").select("owner", F.col("up2").alias("up"))
        more = moving.groupBy(F.col("up").alias("owner")).agg(*[F.sum(v).alias(f"{v}_more") for v in values])
        sums = now.drop("up").join(more, "owner", "left").join(further, "owner", "left")
        new = stage.write(sums.select("owner", "up", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values]))
        stage.drop(now)
        now = new
    return now.select("owner", *values)


def from_the_end(rows: DataFrame, values: list[str]) -> DataFrame:
    """(owner, depth, values) with each value summed over the chain's rows at this depth and below it, in blocks of depths."""
    blocked = rows.withColumn("block", F.shiftright("depth", BLOCK_BITS))
    within = Window.partitionBy("owner", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of a chain
    carry = blocked.groupBy("owner", "block").agg(*[F.sum(v).alias(v) for v in values]).select("owner", "block", *[F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"{v}_later") for v in values])
    run = blocked.withColumns({v: F.sum(v).over(within) for v in values}).join(carry, ["owner", "block"])
    return run.select("owner", "depth", *[c for c in rows.columns if c not in ("owner", "depth", *values)], *[(F.col(v) + F.col(f"{v}_later")).alias(v) for v in values])


def prefix_trie(conversations: DataFrame, *, share: int = SHARE, heads: int = HEADS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    stage = Stage(conversations.sparkSession, "trie")
    turns = stage.write(sorted_turns(conversations))
    facts, again = rebuilt(turns, stage, share=share, heads=heads)
    members = stage.write(memberships(facts, again))
    nodes = stage.write(merged(members).join(end_digests(members, stage), NODE, "left"))
    stage.drop(turns, members)
    hung = chains(nodes, stage)
    below = hung.where("up is not null")
    children = below.groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))
    shared = nodes.where("n > 1").select("owner", "depth", ((F.col("n") - 1) * F.col("words")).alias("saved"))
    is_leaf = hung.join(children, (hung["owner"] == children["owner"]) & (hung["last"] == children["depth"]), "left_anti").select("owner", F.lit(1).cast("long").alias("leaves"))
    forest = hung.join(is_leaf, "owner", "left").join(shared.groupBy("owner").agg(F.sum("saved").alias("saved")), "owner", "left")
    forest = stage.write(forest.select("owner", "head", "last", "up", "at", *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in ("leaves", "saved")]))
    whole = totals(forest, ["leaves", "saved"], stage)
    added = forest.where("up is not null").select("owner", F.col("up"), F.col("at")).join(whole, "owner").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hanging"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
    own = shared.join(added, ["owner", "depth"], "left").select("owner", "depth", F.coalesce("hanging", F.lit(0)).alias("hanging"), F.coalesce("leaves", F.lit(0)).alias("leaves"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"))
    rolled = from_the_end(own, ["leaves", "saved"])
    length = forest.select("owner", (F.col("last") - F.col("head") + 1).alias("n"))
    hot = hot_keys(length, "owner", nodes.count())
    told = split_join(nodes.join(rolled, ["owner", "depth"], "left"), forest.select("owner", "head", "last", "up", F.col("leaves").alias("end")), "owner", hot, "depth")
    return told.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("head"), F.col("owner")).otherwise(F.col("up")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"), F.coalesce(F.col("leaves") + F.col("end"), F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT DISTINCT conv_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
          lambda v, x: list_reduce([xor(v, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295) % 4 AS h FROM t),
c AS (SELECT conv_id, h, conv_id - conv_id % 20 AS base FROM crc),
u AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1000000 + t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT conv_id, text, row_number() OVER w AS depth, string_agg(sha256(role || chr(1) || text), '') OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS size FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
m AS (SELECT conv_id, depth, path, text, depth = size AS ends FROM p
      UNION ALL SELECT c.conv_id, 0, '', '', NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = c.conv_id) FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY depth, path),
k AS (SELECT a.path, a.depth, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND left(b.path, 64 * a.depth::INT) = a.path GROUP BY a.path, a.depth),
s AS (SELECT a.path, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens FROM n a JOIN n b ON b.depth >= a.depth AND left(b.path, 64 * a.depth::INT) = a.path JOIN k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN k ON k.path = n.path JOIN s ON s.path = n.path LEFT JOIN n q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.path = left(n.path, 64 * (n.depth - 1)::INT)
"""
