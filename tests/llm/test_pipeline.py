import re

import numpy as np
import public_tokenizers as vocabularies
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tidemark.llm import jaccard, packing, simhash
from tidemark.llm.common import Stage

from .test_dedup import brute_lines, roots, slow_fingerprint
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_documents(spark):
    """Each stage against a plain version of its rule, on what the stage before kept."""
    stage, docs = Stage(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, step in p.STAGES:
        seen.append(stage.write(step(spark, seen[-1], SF)))
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    first, lang, lines, near, private, packed = map(lambda df: df, seen)
    assert all(d.columns == p.COLUMNS for d in seen[1:5])
    assert texts(lang).items() <= texts(first).items()
    assert lang.count() >= 0.95 * first.where("text rlike '\\\\p{L}'").count()
    cut = brute_lines(sorted(texts(lang).items()), 25)
    whole = {d: len(t.split("\n")) for d, t in texts(lang).items()}
    assert texts(lines) == {d: t for d, (t, gone) in cut.items() if not gone or gone < whole[d]}
    assert texts(near) == {d: texts(lines)[d] for d in brute_groups(texts(lines)).values()}
    assert texts(private).keys() == texts(near).keys()
    assert private.where("text rlike '[A-Za-z0-9]@mail[0-9]'").count() == 0
    assert private.where(F.length("text") != F.col("n_chars")).count() == 0
    check_packing(packed.collect(), texts(private), packing.WINDOW)


def brute_groups(texts):
    """text -> smallest id of its group, comparing all pairs of shingle sets."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in texts.items()}
    sets = {d: frozenset(" ".join(w[i : i + p.WORDS]) for i in range(max(1, len(w) - p.WORDS + 1))) if w else frozenset() for d, w in words.items()}
    some = sorted(set(sets.values()), key=sorted)
    near = [(i, j) for i, a in enumerate(some) for j, b in enumerate(some[:i]) if a and b and 5 * len(a & b) >= 4 * len(a | b)]
    root, number = roots(range(len(some)), near), {x: i for i, x in enumerate(some)}
    groups = {}
    for d in sorted(texts):
        groups.setdefault(root[number[sets[d]]], d)
    return groups


def family(rng, size, changes):
    """Texts of 120 words, each a changed copy of one or of the text before."""
    base = [f"w{x}" for x in rng.integers(0, 9000, 120)]
    out = [list(base)]
    for _ in range(size - 1):
        new = list(out[-1] if rng.random() < 0.5 else base)
        for at in rng.choice(120, int(rng.integers(1, changes)), replace=False):
            new[at] = f"x{rng.integers(0, 10**6)}"
        out.append(new)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("block", [256, 3])
def test_groups_equal_brute_force(spark, docs, monkeypatch, block):
    """Families of near copies of all sizes, some above and some below the similarity, in small blocks too."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(block)
    texts = dict(enumerate(t for size, changes in ((40, 3), (25, 6), (2, 3), (8, 9), (1, 2)) for t in family(rng, size, changes)))
    texts |= {500: "", 501: None, 502: "one two", 503: "One  two", 504: texts[3]}
    got = {}
    for r in simhash.similar_texts(docs(*texts.items())).collect():
        got.setdefault(bytes(r.root), set()).add(r.doc_id)
    assert sorted(min(g) for g in got.values()) == sorted(brute_groups(texts).values())


def test_near_duplicates_go_through_the_pigeonring_search(spark, docs):
    """Fingerprints of at most four differing bits are candidates without any band, and links once their sets reach the similarity."""
    texts = family(np.random.default_rng(1), 40, 4) + ["one two three", "three two one"]
    stage, prints = Stage(spark, "test"), [slow_fingerprint(t, p.WORDS) for t in texts]
    signed = stage.write(jaccard.signatures(docs(*texts), words=p.WORDS, keys=lambda grams: [], fingerprints=True))
    node = {r.doc_id: bytes(r.node) for r in signed.collect()}
    found = simhash.candidates(signed.select("node", "fp"), stage)
    number = {n: d for d, n in node.items()}
    edges = [(number[bytes(r.a)], number[bytes(r.b)]) for r in found.collect()]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert near and roots(range(len(texts)), edges) == roots(range(len(texts)), near)
    sets = [set(jaccard.shingles(t, p.WORDS).tolist()) for t in texts]
    nodes = signed.select("node", F.struct("doc_id", "text_md5").alias("row"), "size", "keys")
    got = jaccard.links(nodes, docs(*texts), stage, words=p.WORDS, percent=p.SIMILAR, found=found).collect()
    assert {(bytes(r.a), bytes(r.b)) for r in got} == {tuple(sorted((node[i], node[j]))) for i, j in edges if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} != set()


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_vocabulary_is_a_parameter():
    assert vocabularies.path("byte_bpe_50k.tiktoken").endswith(".tiktoken")


def test_near_copies_over_four_bits_apart_go_and_pairs_below_the_similarity_stay(spark, docs):
    """Copies of similarity 0.8 to 0.95 go however far their SimHashes are; copies below 0.8 stay however near."""
    rng = np.random.default_rng(5)
    rows, below, far = [], set(), 0
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
        other = list(words)
        for at in rng.choice(200, int(rng.integers(1, 9)), replace=False):
            other[at] = f"new{at}"
        a, b = (" ".join(w) for w in (words, other))
        x, y = ({" ".join(w[i : i + p.WORDS]) for i in range(200 - p.WORDS + 1)} for w in (words, other))
        if 5 * len(x & y) >= 4 * len(x | y):
            far += (slow_fingerprint(a, p.WORDS) ^ slow_fingerprint(b, p.WORDS)).bit_count() > 4
        else:
            below.add(2 * k + 1)
        rows += [(2 * k, a), (2 * k + 1, b)]
    kept = {r.doc_id for r in p.near_duplicates(spark, docs(*rows), "").collect()}
    assert far and below
    assert kept == {2 * k for k in range(40)} | below


def test_ids_that_are_null_or_shared_lose_no_clean_document(spark, docs):
    """One row of each group stays, whatever the ids are, and always the same one."""
    a = [f"a{i}" for i in range(60)]
    near, b = " ".join([*a[:59], "z"]), " ".join(f"b{i}" for i in range(60))
    a = " ".join(a)
    others = [(None, f"first clean text {' '.join(f'n{i}' for i in range(20))}"), (None, f"second clean text {' '.join(f'm{i}' for i in range(20))}"), (None, None)]
    rows = [(3, near), (5, a), (5, b), (7, b), (5, b), (None, a), *others]
    for some in (rows, rows[::-1]):
        kept = p.near_duplicates(spark, docs(*some), "")
        assert kept.columns == p.COLUMNS
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, near), (5, b), *others], key=str)
