"""Min-max hashing against all pairs of shingle sets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard, minhash
from tidemark.llm.queries import QUERIES

from .conftest import ODD_TEXTS
from .test_dedup import roots
from .test_pipeline import family

SF = "/root/testdata/sf0.001"


def brute(texts, words=5, percent=85):
    """doc_id -> (n_shingles, component_id, kept) by comparing all pairs."""
    cut = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in texts.items()}
    sets = {d: frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset() for d, w in cut.items()}
    some = sorted({s for s in sets.values() if s}, key=sorted)
    root = roots(range(len(some)), [(i, j) for i, a in enumerate(some) for j, b in enumerate(some[:i]) if 100 * len(a & b) >= percent * len(a | b)])
    number, least = {s: i for i, s in enumerate(some)}, {}
    for d in sorted(texts):
        if sets[d]:
            least.setdefault(root[number[sets[d]]], d)
    own = {d: least[root[number[s]]] if s else d for d, s in sets.items()}
    return {d: (len(sets[d]), own[d], own[d] == d) for d in texts}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_op12_over_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute(texts)
    assert found(QUERIES["op12_minhash"](spark, SF)) == want and any(not kept for _, _, kept in want.values())


@pytest.mark.parametrize("limits", [(256, 16 << 20, 256), (3, 16 << 20, 2), (256, 4000, 2)])
def test_components_equal_brute_force(spark, docs, monkeypatch, limits):
    """Families of near copies in large and small blocks, by rows and by bytes, with hot keys split."""
    monkeypatch.setattr(jaccard, "BLOCK", limits[0])
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", limits[1])
    monkeypatch.setattr(common, "HOT_LEAST", limits[2])
    rng = np.random.default_rng(sum(limits))
    texts = dict(enumerate(t for size, changes in ((40, 3), (25, 5), (2, 3), (8, 7), (1, 2)) for t in family(rng, size, changes)))
    texts |= {500: "", 501: None, 502: "one two", 503: "One  two", 504: texts[3], 505: " \n"}
    assert found(minhash.near_duplicates(docs(*texts.items()))) == brute(texts)


def test_odd_rows(spark, docs):
    rows = list(enumerate(ODD_TEXTS))
    clash = docs(*rows).withColumns({c: F.lit("x") for c in ("node", "size", "keys", "root", "kept", "component_id")})
    assert found(minhash.near_duplicates(clash)) == brute(dict(rows))
    assert minhash.near_duplicates(docs()).count() == 0
    same = "a b c d e f g"
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs((7, same), (7, same), (None, same), (None, "z z"), (None, None))).collect())
    assert got == [("7", 3, "7", True), ("7", 3, "7", True), ("None", 0, "None", True), ("None", 1, "None", True), ("None", 3, "7", False)]
    long = "lorem ipsum dolor sit amet " * 200_000
    assert found(minhash.near_duplicates(docs((1, long), (2, long + "and one more")))) == brute({1: long, 2: long + "and one more"})


def test_estimates_are_unbiased_and_vary_less_than_as_many_minima():
    """The sketch's mean over many pairs is the similarity; the same hash evaluations spent on minima alone vary more."""
    rng = np.random.default_rng(1)
    told, minima, s = [], [], 0.85
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 200, np.uint64) * np.uint64(2)
        a, b = np.sort(x[:185]), np.sort(np.concatenate([x[:170], x[185:]]))
        p, q = minhash.sketch(a), minhash.sketch(b)
        told.append(minhash.estimate(p, q))
        minima.append(float((p[:, 0] == q[:, 0]).mean()))
    assert abs(np.mean(told) - s) < 0.01 and np.var(told) < 0.75 * np.var(minima)


def test_bands_miss_no_pair_at_the_threshold():
    rng, missed = np.random.default_rng(2), 0
    for _ in range(3000):
        x = rng.integers(0, 1 << 63, 100, np.uint64) * np.uint64(2)
        a, b = np.sort(x[:92]), np.sort(np.concatenate([x[:85], x[92:]]))
        missed += not set(minhash.bands(a)) & set(minhash.bands(b))
    assert missed == 0
