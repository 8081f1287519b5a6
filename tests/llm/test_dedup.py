import random
import re

import pytest
import xxhash

from tidemark.llm import linededup, simhash
from tidemark.llm.common import Stage

from .conftest import ODD_TEXTS


def brute_lines(docs, min_words):
    """Longest earlier copies by comparing every pair of positions."""
    lines = [t.split("\n") if t else [] for _, t in docs]
    out = {}
    for d, mine in enumerate(lines):
        gone = set()
        for i in range(len(mine)):
            best = 0
            for e in range(d + 1):
                for j in range(i if e == d else len(lines[e])):
                    n = 0
                    while i + n < len(mine) and j + n < len(lines[e]) and mine[i + n] == lines[e][j + n]:
                        n += 1
                    best = max(best, n)
            if best and sum(len(x.split()) for x in mine[i : i + best]) >= min_words:
                gone.update(range(i, i + best))
        out[docs[d][0]] = (docs[d][1] if not gone else "\n".join(x for i, x in enumerate(mine) if i not in gone), len(gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, docs, seed):
    rnd = random.Random(seed)
    rows = [(i, "\n".join(rnd.choice(["a b", "c", "d e f", "", "g"]) for _ in range(rnd.randint(0, 14)))) for i in range(25)]
    rows += [(90, rows[3][1]), (91, rows[3][1] + "\n" + rows[4][1]), (92, None), (93, "")]
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.dedup_lines(docs(*rows), min_words=4).collect()}
    want = brute_lines(rows, 4)
    assert got == {k: v if k != 92 else (None, 0) for k, v in want.items()}


def test_line_dedup_splits_runs_that_very_many_hold(spark, docs, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rows = [(i, f"own {i}\na b c d\ncommon line here\nx{i % 3} y z w") for i in range(60)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.dedup_lines(docs(*rows), min_words=4).collect()}
    assert got == brute_lines(rows, 4)


def test_line_dedup_odd_rows(spark, docs):
    got = linededup.dedup_lines(docs(*ODD_TEXTS), min_words=3).collect()
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id < 10) == [(i, t or "") for i, t in enumerate(ODD_TEXTS[:10])]
    assert {r.doc_id: r.text for r in got}[11] == "" and set(docs().columns) < set(got[0].asDict())
    same = linededup.dedup_lines(docs((5, "p q r s\nt u v w"), (5, "p q r s\nt u v w"), (None, "p q r s\nz")), min_words=3).collect()
    assert sorted((r.doc_id or 0, r.text) for r in same) == [(0, "p q r s\nz"), (5, "t u v w"), (5, "t u v w")]
    assert linededup.dedup_lines(docs(), min_words=3).count() == 0


def slow_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [*ODD_TEXTS, "One Two THREE four\x0bfive\x1csix É", "a b a b a b a b"]:
        assert simhash.fingerprint(t, 4) == slow_fingerprint(t)


def near_values(rnd, n):
    out = [rnd.getrandbits(64) for _ in range(n)]
    for v in list(out):
        for _ in range(rnd.randint(0, 3)):
            v ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5)))
            out.append(v)
    return sorted(set(out))


def roots(values, edges):
    up = {v: v for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("block", [2048, 4])
def test_links_connect_all_within_four_bits(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = near_values(random.Random(block), 150) + [1, 2, 3, 7, 15, 31, 63, 127]
    values = sorted(set(values))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, Stage(spark, "t")).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    full = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert roots(values, edges) == roots(values, full)
    assert len(edges) < 15 * len(values)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 130))
    assert simhash.components(spark.createDataFrame([], "a long, b long"), Stage(spark, "t")).count() == 0


def test_near_duplicates_of_odd_rows(spark, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(*ODD_TEXTS)).collect()}
    assert got[0].fingerprint == "0" * 16 and got[3].component_id == 0 and got[11].component_id == 10
    assert simhash.near_duplicates(docs()).count() == 0
    base = " ".join(f"w{i}" for i in range(400))
    near = simhash.near_duplicates(docs((9, base), (4, base + " more"), (4, base + " more"), (None, "other words entirely in this one"))).collect()
    assert sorted(str(r.component_id) for r in near) == ["4", "4", "4", "None"]


def test_components_split_hot_nodes(spark, monkeypatch):
    """Stars whose centre holds most edges are dealt by its neighbours."""
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 4)
    edges = [(1000, i) for i in range(300)] + [(2000 + i, 3000 + i) for i in range(50)] + [(299, 5000), (5000, 5001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "t")).collect()}
    want = roots(sorted({x for e in edges for x in e}), edges)
    assert got == {k: v for k, v in want.items() if k != v}
    binary = spark.createDataFrame([(a.to_bytes(4), b.to_bytes(4)) for a, b in edges], "a binary, b binary")
    assert {int.from_bytes(r.node): int.from_bytes(r.root) for r in simhash.components(binary, Stage(spark, "t")).collect()} == got


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_a_join(spark, how):
    from tidemark.llm.common import split_join

    rows = spark.createDataFrame([(k, i) for k in (1, 2, 3, None) for i in range(40)], "k long, v long")
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (5, "d")], "k long, f string")
    plain = sorted(map(str, rows.join(facts, "k", how).select("k", "v", "f").collect()))
    for hot in ([1], [1, 2, 7]):
        assert sorted(map(str, split_join(rows, facts, "k", hot, "v", how).select("k", "v", "f").collect())) == plain


def test_line_dedup_replaces_columns_of_its_outputs_names(spark, docs):
    from pyspark.sql import functions as F

    df = docs("p q r s\nt u", "p q r s\nv").withColumns({"removed": F.lit("x"), "n_lines": F.lit("y"), "_text_key": F.lit("kept"), "key": F.lit("kept"), "id": F.lit(1)})
    got = linededup.dedup_lines(df, min_words=3)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text_key", "key", "id", "removed", "n_lines", "removed_lines"]
    assert sorted((r.text, r._text_key, r.key, r.removed_lines) for r in got.collect()) == [("p q r s\nt u", "kept", "kept", 0), ("v", "kept", "kept", 1)]
