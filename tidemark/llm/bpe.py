"""Byte-level BPE by a segment tree over byte positions.

The tree's leaves hold, for each live token start, the rank of the pair that begins there, with the position as the tie
breaker; its root is the leftmost pair of least rank. A merge changes three leaves (the merged pair, the absorbed token and
the live neighbour on the left), so a match of n bytes takes O(n log n) steps however long it is.

Equal matches meet often, so a worker keeps what it has encoded of up to CACHE_CHARS characters in bounded tables (CACHE_ENTRIES,
WORD_ENTRIES) that start anew when full.

Defined results: null and empty text give no ids and the digests of nothing; repeated rows and doc_ids are encoded each on
their own; columns other than the id and text columns are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ship, slices, table

CACHE_ENTRIES = 800_000
WORD_ENTRIES = 300_000
CACHE_CHARS = 64
_NEVER = 1 << 62
_POS = 32
_MASK = (1 << _POS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the splitting pattern."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    size = 1 << max(0, (n - 2).bit_length())
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << _POS | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (least := tree[1]) != _NEVER:
        i = least & _MASK
        gone = after[i]
        end = after[gone] if gone < n else n
        after[i] = end
        if end <= n:
            before[end] = i
        put(gone, _NEVER) if gone < n - 1 else None
        if end < n and (r := get(piece[i : after[end]])) is not None:
            put(i, r << _POS | i)
        else:
            put(i, _NEVER)
        if (p := before[i]) >= 0:
            put(p, _NEVER if (r := get(piece[p:end])) is None else r << _POS | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes and decodes texts with one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _match(self, match: str) -> tuple[int, ...]:
        ids = self.seen.get(match)
        if ids is None:
            ids = tuple(merge(match.encode(), self.ranks))
            if len(match) <= CACHE_CHARS:
                if len(self.seen) >= CACHE_ENTRIES:
                    self.seen = {}
                self.seen[match] = ids
        return ids

    def _matches(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._match, self.split(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text.

        Every match of the pattern ends before a space that a non-space follows, so such a text is cut there and each
        " word" looked up; texts with other runs of white space go through the pattern as they are."""
        if not text:
            return []
        first, *rest = text.split(" ")
        words, out = self.words, [self._matches(first)]
        for w in rest:
            ids = words.get(w)
            if ids is None:
                if not w or w[0].isspace():
                    return list(self._matches(text))
                ids = self._matches(" " + w)
                if len(w) <= CACHE_CHARS:
                    if len(words) >= WORD_ENTRIES:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of each row; null text counts as empty."""

    def run(batches):
        enc = encoder(path, pattern)
        for b in slices(batches):
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(enc.decode, ids), pa.binary())], [id_col, "ids", "decoded"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, with digests taken where the ids are made, so that
    the ids need not travel back through Arrow."""

    def run(batches):
        enc = encoder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t or "")
                n.append(len(ids))
                a.append(sha(",".join(map(enc.decimals.__getitem__, ids)).encode()))
                d.append(sha(enc.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return digest_documents(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
