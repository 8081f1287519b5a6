"""Whitening against numpy and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def check(got, vectors, components=32):
    """got: result rows; vectors: (id, floats) that take part, in any order."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    want = sorted((k, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for (k, _), r in zip(vectors, x, strict=True))
    off = np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x], float) / n
    e, v = np.linalg.eigh(off.T @ off / n)
    e, v = e[::-1], v[:, ::-1]
    kept = min(components, int((e > 1e-10 * e[0]).sum()))
    one = [r for r in got if r.component == 1]
    assert sorted((r.vec_id, r.deviation) for r in one) == want and len(got) == kept * n
    assert all(r.n == n and 0 <= r.identity_error <= 1e-4 for r in got)
    trace = sum(w for _, w in want) / n**3
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-6)
    for c, rows in by.items():
        plain = {}
        for (k, _), p in zip(vectors, off @ v[:, c - 1] / np.sqrt(e[c - 1]), strict=True):
            plain.setdefault(k, []).append(p)
        assert plain.keys() == rows.keys()
        if all(abs(e[c - 1] - e[i]) > 1e-6 * e[0] for i in range(d) if i != c - 1):  # simple eigenvalues have one direction
            gaps = [max(abs(a - b) for k in plain for a, b in zip(sorted(rows[k]), sorted(sign * y for y in plain[k]), strict=True)) for sign in (1, -1)]
            assert min(gaps) < 1e-6


def test_op13_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, SF).collect(), rows)


def run(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.withColumns({c: F.lit("other") for c in extra}).write.parquet(str(tmp_path / "embeddings.parquet"))
    return QUERIES["op13_whitening"](spark, str(tmp_path)).collect()


def test_odd_rows(spark, tmp_path):
    """Nulls, non-finite entries and other lengths take no part; repeated rows, null ids, constant dimensions and clashing names do no harm."""
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(0, 1, 5)] + [2.5]) for i in range(40)]
    good += [good[3], (3, [float(x) for x in rng.normal(0, 1, 6)])]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (53, [float("nan")] + [1.0] * 5), (54, [float("inf")] + [1.0] * 5), (55, [1.0, 2.0])]
    check(run(spark, tmp_path / "a", good + bad, ("x", "deviation", "component", "whitened", "n")), good)
    constant = [(k, v[:5] + [2.5]) for k, v in good]
    got = run(spark, tmp_path / "b", constant)
    check(got, constant)
    assert {r.component for r in got} == {1, 2, 3, 4, 5}
    null_id = run(spark, tmp_path / "c", [(None, good[0][1]), *good[1:]])
    assert sum(r.vec_id is None for r in null_id) == len({r.component for r in null_id})


def test_few_rows(spark, tmp_path):
    assert run(spark, tmp_path / "none", []) == []
    assert run(spark, tmp_path / "bad", [(1, None)]) == []
    assert run(spark, tmp_path / "one", [(1, [0.5, 0.25])]) == []
    assert run(spark, tmp_path / "equal", [(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []
    got = run(spark, tmp_path / "two", [(1, [0.5, 0.25]), (2, [1.5, 0.25])])
    assert sorted((r.vec_id, abs(r.whitened), r.deviation) for r in got) == [(1, 1.0, 64**2), (2, 1.0, 64**2)] and got[0].explained == pytest.approx(1)


def test_deviations_beyond_64_bits_are_decimals(spark):
    rows = spark.createDataFrame([(i, [(-1) ** i * 3e7]) for i in range(40)], "vec_id long, embedding array<double>")
    model, white, error = whitening.whiten(rows)
    x = [math.floor(64 * (-1) ** i * 3e7) + 1_000_000 for i in range(40)]
    assert {int(r.deviation) for r in white.collect()} == {(40 * v - sum(x)) ** 2 for v in x} and error < 1e-9
    assert white.schema["deviation"].dataType.simpleString() == "decimal(38,0)"
    assert model.total == pytest.approx(model.eigenvalues[0])
