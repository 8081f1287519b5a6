import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken

from tidemark.llm import bpe, packing
from tidemark.llm.packing import combinations, plan

from .conftest import ODD_TEXTS

MULTI = vocabularies.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = packing.public_vocabulary()
ALPHABET = ["a", "b", "the", " ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'", "é", "1", "²", "!", "\U0001f600", "字", "\r", "​", "<|endoftext|>"]


def mixtures(n):
    rnd = random.Random(5)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 16))) for _ in range(n)]


def test_segment_tree_equals_the_library():
    own = bpe.Encoder(MULTI, vocabularies.PATTERN)
    library = tiktoken.Encoding("x", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    for t in [*mixtures(3000), *[x or "" for x in ODD_TEXTS]]:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bounded_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "WORD_ENTRIES", 3)
    own, text = bpe.Encoder(MULTI, vocabularies.PATTERN), "one two three four five six seven"
    assert own.decode(own.encode(text)) == text.encode() and len(own.seen) <= 3 and len(own.words) <= 3


def test_encode_documents(spark, docs):
    rows = bpe.encode_documents(docs(*ODD_TEXTS), MULTI, vocabularies.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in rows) == [(i, (t or "").encode()) for i, t in enumerate(ODD_TEXTS)]
    d = {r.doc_id: r for r in bpe.digest_documents(docs(*ODD_TEXTS), MULTI, vocabularies.PATTERN).collect()}
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digest_documents(docs(), MULTI, vocabularies.PATTERN).count() == 0


def test_ids_are_the_tokenizer_files():
    """By the tokenizer as it comes: strings of added tokens in texts are one id."""
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(VOCABULARY.tokenizer), packing.Tokens(VOCABULARY)
    assert np.frombuffer(own.encode("a <|endoftext|> b"), "<u4").tolist().count(50256) == 1
    for t in [*mixtures(3000), *[x or "" for x in ODD_TEXTS if len(x or "") < 5000]]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_added_tokens_that_take_in_neighbours_are_refused(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"added_tokens": [{"id": 1, "content": "<x>", "single_word": false, "lstrip": true, "rstrip": false, "normalized": false}]}')
    with pytest.raises(ValueError, match="<x>"):
        packing.Vocabulary(str(path), "", "").added()


def check_packing(rows, texts, window):
    own = packing.Tokens(VOCABULARY)
    ids = {d: own.encode(t) + b"\x01\0\0\0" for d, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id]) // 4
    assert by_doc.keys() == ids.keys()
    for d, some in by_doc.items():
        at = 0
        for r in sorted(some, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d]) // 4
    sizes = []
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        sizes.append(at)
    assert sum(s < window for s in sizes) <= 1


@pytest.mark.parametrize("window", [16, 64])
def test_packing_covers_every_id_once(spark, docs, window):
    rnd = random.Random(window)
    texts = dict(enumerate([*ODD_TEXTS, *(" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 90))) for _ in range(150))]))
    rows = packing.pack_documents(docs(*texts.values()).repartition(3), VOCABULARY, window=window).collect()
    check_packing(rows, texts, window)


def test_packing_of_one_length_and_of_nothing(spark, docs):
    texts = {i: "alpha beta gamma delta" for i in range(40)}
    check_packing(packing.pack_documents(docs(*texts.values()), VOCABULARY, window=16).collect(), texts, 16)
    assert packing.pack_documents(docs(), VOCABULARY, window=16).count() == 0


def test_packing_keeps_repeated_rows_and_null_ids(spark, docs):
    rows = packing.pack_documents(docs((1, "a b c"), (1, "a b c"), (None, "d e")), VOCABULARY, window=2).collect()
    assert sorted(str((r.doc_id, r.start)) for r in rows) == sorted(str(x) for x in [(1, 0), (1, 2), (1, 0), (1, 2), (None, 0), (None, 2)])


def test_combinations_fill_the_window():
    lengths, times = combinations(np.array([1, 3, 5, 8, 16]), 16)
    assert ((lengths * times).sum(1) == 16).all() and len({tuple(map(tuple, x)) for x in np.stack([lengths, times], 2)}) == len(lengths)


def test_plan_never_places_more_than_there_is():
    h = np.random.default_rng(0).integers(0, 30, 65)
    h[0] = 0
    rows, taken, base, first = plan(h, 64)
    assert (taken <= h).all() and taken.sum() > 0.5 * h.sum()


def exact_nnls(a, h):
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    while True:
        g = a.T @ (h - a @ x)
        g[free] = -np.inf
        if free.all() or g.max() <= 1e-9 * max(1.0, np.abs(h).max()):
            return x
        free[g.argmax()] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], h, rcond=None)[0]
            if z[free].min() > -1e-12:
                x = np.maximum(z, 0)
                break
            bad = free & (z <= 0)
            x += np.min(x[bad] / (x[bad] - z[bad] + 1e-300)) * (z - x)
            free &= x > 1e-12


@pytest.mark.parametrize("seed", range(6))
def test_repeat_counts_are_near_the_least_squares_solution(seed):
    rng = np.random.default_rng(seed)
    window = 24
    h = np.zeros(window + 1)
    h[rng.choice(np.arange(1, window + 1), 9, replace=False)] = rng.integers(1, 60, 9)
    lengths, times = combinations(np.flatnonzero(h), window)
    if not len(lengths):
        return
    a = np.zeros((window + 1, len(lengths)))
    for k, (some, m) in enumerate(zip(lengths, times, strict=True)):
        for length, count in zip(some, m, strict=True):
            a[length, k] += count
    x = packing.repeats(lengths, times, h)
    best = a @ exact_nnls(a, h) - h
    assert (x >= 0).all()
    assert np.linalg.norm(a @ x - h) <= np.linalg.norm(best) + 0.02 * np.linalg.norm(h)


def test_greedy_fills_windows_with_residuals():
    left = np.zeros(65, np.int64)
    left[[30, 17, 9, 8]] = 1
    assert sorted(packing.greedy(left, 64)) == [8, 9, 17, 30]
    left[8] = 0
    assert packing.greedy(left, 64) is None and packing.greedy(left * 0, 64) is None
    h = np.zeros(257, np.int64)
    np.add.at(h, np.random.default_rng(1).lognormal(3.2, 0.9, 20_000).astype(int).clip(1, 256), 1)
    for scale, share in ((1, 0.03), (1000, 0.001)):  # lengths as texts have them: what is left to cut does not grow with the documents
        assert (h * scale - plan(h * scale, 256)[1]).sum() <= share * scale * h.sum()


def test_many_and_few_cuts_give_the_same(spark, docs, monkeypatch):
    texts = {i: "alpha beta gamma delta " * (i % 7 + 1) for i in range(60)}
    few = packing.pack_documents(docs(*texts.values()), VOCABULARY, window=16).collect()
    monkeypatch.setattr(packing, "FEW_CUTS", 0)
    assert sorted(few) == sorted(packing.pack_documents(docs(*texts.values()), VOCABULARY, window=16).collect())


def test_long_matches_are_not_kept():
    own = bpe.Encoder(MULTI, vocabularies.PATTERN)
    own.encode("x" * 5000 + " " + "y" * 5000 + " short")
    assert max(map(len, own.seen)) <= bpe.CACHE_CHARS and max(map(len, own.words)) <= bpe.CACHE_CHARS
