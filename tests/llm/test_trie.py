"""The conversation trie against a plain nested dictionary."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, trie
from tidemark.llm.common import Stage
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows):
    """(conv_id, depth) -> the other columns."""
    turns = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d < len(path):
                node["children"].add(path[: d + 1])
            else:
                node["ends"].append(c)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        node = nodes[path]
        below = node["children"]
        leaves[path] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(node["members"]) - 1) * words + sum(saved[x] for x in below)
    out = {}
    for path, node in nodes.items():
        parent = min(nodes[path[:-1]]["members"]) if path else None
        ids = ",".join(map(str, sorted(node["ends"])))
        out[min(node["members"]), len(path)] = (parent, len(node["members"]), len(node["children"]), leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest())
    assert len(out) == len(nodes)
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_op11_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_trie"](spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {k for _, k in got.dtypes[:-1]} == {"bigint"} and found(got) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_equal_brute_force(spark, monkeypatch, seed):
    """Deep and wide tries with small blocks, chunks and hot limits: long conversations, copies, prefixes of others, absent shared ones."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(trie, "CHUNK", 3)
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    rnd = random.Random(seed)
    long = [("user", f"turn {i} of it") for i in range(70)]
    rows = []
    for c in rnd.sample(range(2, 400), 60) + [0, 20, 40, 100, 7, 1000]:
        kind = rnd.random()
        said = long[: rnd.choice([70, 70, 40, 3])] if kind < 0.4 else [("user", "hello")] * rnd.randint(1, 3) if kind < 0.7 else [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "b c", ""])) for _ in range(rnd.randint(1, 6))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(said)]
    rnd.shuffle(rows)
    assert found(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_odd_rows(spark):
    """Nulls in every column, equal turns, repeated rows, ids below zero, very long texts and columns of clashing names."""
    rows = [(1, None, "user", "x y"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (1, 0, "", "tie b"), (1, 0, "", "tie a"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(-7, 3, "user", "é字\x1cword word"), (-20, 0, "user", "base"), (21, 0, "user", "w " * 300_000), (22, 0, "user", "w " * 300_000), (23, 1, "user", ""), (23, 0, "user", "")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("other") for c in ("owner", "depth", "n", "pos", "at", "words", "base")})
    assert found(trie.prefix_trie(df)) == brute(rows)
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)).count() == 0


def test_totals_of_chains_that_hang_deeply(spark):
    up = {i: i - 1 for i in range(1, 20)} | {i: 3 for i in range(20, 40)} | {0: None}
    forest = spark.createDataFrame([(c, p, 1, c) for c, p in up.items()], "owner long, up long, leaves long, saved long")
    under = {c: [] for c in up}
    for c in up:
        at = c
        while at is not None:
            under[at].append(c)
            at = up[at]
    got = {r.owner: (r.leaves, r.saved) for r in trie.totals(forest, ["leaves", "saved"], Stage(spark, "t")).collect()}
    assert got == {c: (len(x), sum(x)) for c, x in under.items()}
