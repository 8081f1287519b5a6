"""Texts of a few million characters that look alike all over: dotted runs, spaces, digit groups, one letter, one line."""

import hashlib
import re

import pytest

import corpus_pipeline
from tidemark.llm import bpe, chat, fingerprint, langid, linededup, minhash, packing, pii, simhash, trie
from tidemark.llm.common import Stage

KEY = "k"
MILLION = 1_000_000
LONG = [
    "x@" + "a." * MILLION + "com", " " * (2 * MILLION), "1 " * 300_000, "a" * (2 * MILLION), "a.b@" * 300_000, "one line " * 200_000, "a line\n" * 200_000,
    "4111 1111 1111 1111 " * 20_000, "-" * MILLION, "::" * 300_000, "1." * 300_000, "AB12 " * 200_000, "password=" * 100_000, "(555) " * 100_000, "字" * MILLION,
]
IDS = [t[:9].replace(" ", "_").replace("\n", "_") for t in LONG]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_vocabulary().tokenizer)


def test_white_space_beyond_the_matchers_stack(library):
    own = packing.tokens(packing.public_vocabulary())
    for text in (" " * (2 * MILLION), "a" + " \n" * MILLION + "b <|endoftext|> c" + "\t" * 150_000 + "d"):
        import numpy as np

        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs):
    rows = packing.pack_documents(docs(*LONG), packing.public_vocabulary()).collect()
    for d, text in enumerate(LONG):
        parts = sorted((r.start, r.length) for r in rows if r.doc_id == d)
        assert [s for s, _ in parts[1:]] == [s + n for s, n in parts[:-1]] and text


def test_pii(spark, docs):
    got = {r.doc_id: r for r in pii.pseudonymise(docs(*LONG), KEY).collect()}
    for d, text in enumerate(LONG):
        if text.startswith("x@"):
            assert re.fullmatch(r"u[0-9a-f]{12}@mail[.]invalid", got[d].text)
        elif text.startswith("4111"):
            assert got[d].n_replaced == 20_000 and len(set(got[d].text.split(" "))) == 5
        elif not text.startswith(("a.b@", "password")):
            assert got[d].text == text and got[d].n_replaced == 0, text[:9]


def test_byte_bpe(spark, docs):
    import public_tokenizers as vocabularies

    some = [t[:300_000] for t in LONG]
    got = {r.doc_id: r for r in bpe.digest_documents(docs(*some), vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN).collect()}
    assert all(got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t in enumerate(some))


def test_near_duplicates_and_fingerprints(spark, docs):
    for found in (simhash.near_duplicates(docs(*LONG)), minhash.near_duplicates(docs(*LONG)), simhash.similar_texts(docs(*LONG)), fingerprint.fingerprint_documents(docs(*LONG))):
        assert sorted(r.doc_id for r in found.collect()) == list(range(len(LONG)))


def test_line_dedup(spark, docs):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(*LONG, LONG[5]), min_words=25).collect()}
    assert got[6].text.split("\n") == ["a line"] * (got[6].n_lines - got[6].removed_lines - 1) + [""] or got[6].removed_lines > 0
    assert got[len(LONG)].removed_lines == 1 and all(got[d].text == t for d, t in enumerate(LONG) if "\n" not in t)


def test_conversations(spark):
    rows = spark.createDataFrame([(20, i, "assistant", t) for i, t in enumerate(LONG)], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.format_log(chat.conversation_log(rows))).collect()
    assert (r.n_turns, r.loss_chars) == (len(LONG), sum(map(len, LONG)))
    assert trie.prefix_trie(rows).count() == len(LONG) + 1


def test_stages_of_the_pipeline(spark, docs):
    stage, df = Stage(spark, "long"), docs(*LONG)
    for name, step in corpus_pipeline.STAGES[1:]:
        df = stage.write(step(spark, df, ""))
        assert df.count() > 0, name
    model = langid.train(docs(*[f"some words of a text {i}" for i in range(30)]), ~langid.held_out())
    assert langid.predict(docs(*LONG), model).count() == len(LONG)
