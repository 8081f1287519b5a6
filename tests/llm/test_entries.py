"""The registered queries over the whole tables of the smallest scale, against brute force."""

import hashlib
import re
import zlib

import public_tokenizers as vocabularies
import pytest
import tiktoken

from tidemark.llm import bpe, chat, packing, pii
from tidemark.llm.queries import QUERIES

from .test_dedup import brute_lines, roots, slow_fingerprint
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    return {r.doc_id: r.text for r in rows}, {r.doc_id: r.lang for r in rows}


def test_op1(spark, texts):
    check_packing(QUERIES["op1_packing"](spark, SF).collect(), texts[0], packing.WINDOW)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_op2(spark, texts):
    """Outside of candidates nothing changes, all values of the tables' kinds go, and equal values stay equal."""
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, SF).collect()}
    assert got.keys() == texts[0].keys()
    kinds = {"mail": r"[a-z.0-9]+@[a-z0-9.]+[a-z]", "card": r"(?<!\d)\d{16}(?!\d)", "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}", "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "key": r"AKIA[0-9A-Z]{16}"}
    seen, changed = {}, 0
    for d, text in texts[0].items():
        new = got[d].text
        if text is None:
            assert new is None
            continue
        for kind, pattern in kinds.items():
            a, b = (re.findall(pattern, x) for x in (text, new))
            if kind == "mail":
                b = re.findall(r"u[0-9a-f]{12}@mail[.]invalid", new)
            if kind == "card":
                assert [luhn(x) for x in a] == [luhn(x) for x in b]
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                if kind != "card" or luhn(x):
                    assert x != y and seen.setdefault(x, y) == y
                    changed += 1
        if not re.search("[0-9@=:]|AKIA", text):
            assert new == text and got[d].n_replaced == 0
    assert changed > 5 and len(set(seen.values())) == len(seen)


def test_op3(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    assert rows.keys() == texts[0].keys()
    right = total = 0
    for d, text in texts[0].items():
        r = rows[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out and texts[1][d]:
            total += 1
            right += r.lang_pred == texts[1][d]
    assert total > 20 and right >= 0.95 * total


def test_op4(spark, texts):
    ranks = bpe.load_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    ids = {d: library.encode_ordinary(t or "") for d, t in texts[0].items()}
    assert got == {d: (len(x), sha(",".join(map(str, x)).encode()), sha((texts[0][d] or "").encode())) for d, x in ids.items()}


def test_op8(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    turns[-7] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    got = {r.conv_id: r for r in QUERIES["op8_chat"](spark, SF).collect()}
    assert got.keys() == turns.keys() and chat.PROBE == "\\### Assistant: </turn> ok"
    for c, rows in turns.items():
        r, said = got[c], "".join(t for role, t in rows if role == "assistant")
        assert r.n_turns == len(rows) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.formatted_chars > sum(len(b) for _, b in rows)


def test_op9(spark, texts):
    prints = {d: slow_fingerprint(t) for d, t in texts[0].items()}
    some = sorted(set(prints.values()))
    root = roots(some, [(a, b) for i, a in enumerate(some) for b in some[:i] if (a ^ b).bit_count() <= 4])
    least = {}
    for d in sorted(prints):
        least.setdefault(root[prints[d]], d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {d: (f"{v:016x}", least[root[v]]) for d, v in prints.items()}


def test_op10(spark, texts):
    got = {r.doc_id: (r.text, r.removed_lines) for r in QUERIES["op10_line_dedup"](spark, SF).collect()}
    want = brute_lines(sorted((d, t) for d, t in texts[0].items()), 25)
    assert got == {d: (None if texts[0][d] is None else t, n) for d, (t, n) in want.items()}


def test_queries_run_on_a_given_key(spark):
    spark.conf.set(pii.KEY_SETTING, "another key")
    other = {r.doc_id: r.text for r in QUERIES["op2_pii"](spark, SF).collect()}
    spark.conf.unset(pii.KEY_SETTING)
    assert other != {r.doc_id: r.text for r in QUERIES["op2_pii"](spark, SF).collect()}
