"""Packing of token sequences by non-negative least squares over shallow length combinations.

1. Tasks tokenize whole texts and keep, per document, its full windows and one remainder shorter than a window: the ids'
   checksum and length, not the ids. Their table is written to the shared folder.
2. The histogram of remainder lengths has at most `window` bins whatever the input's size, and only it goes to the driver.
   There every pair and triple of occupied lengths that fills a window exactly, and every k-fold length with its complement,
   is a column; multiplicative updates solve min |Ax - h| with x >= 0 for the repeat counts; the counts are rounded down and a
   sweep over the columns places what still fits exactly.
3. The residual lengths are packed greedily: from the longest on, a window takes what is longest and fits until it is full, and is
   repeated as often as the residual counts allow. The pieces that fill no window (few, unless some length is far commoner than
   what complements it) are laid end to end, longest first, and cut at window boundaries, so only the last sequence can be short.
4. Each piece gets its number among the pieces of its length from counts per (task, length), so neither a common length nor a
   common source meets in one task, and looks up its place in the plan, whose size is bounded by the window.
5. Documents whose remainder was cut are tokenized once more for the checksums of the two parts. Up to FEW_CUTS of them are
   sent to the tasks that read the texts; more are joined by a shuffle.

Defined results: null and empty texts hold only the end id; equal rows are packed each; null ids are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, load_ranks
from .common import Stage, ship, slices, table

WINDOW = 2048
END_ID = 1
NNLS_STEPS = 150
FEW_CUTS = 100_000
LONG_SPACE = 100_000


class Vocabulary(NamedTuple):
    """A tokenizer file, the rank file of the same vocabulary and the pattern that splits texts before merging."""

    tokenizer: str
    ranks: str
    pattern: str

    def added(self) -> dict[str, int]:
        """The tokens that the tokenizer file adds: each is one id wherever a text holds its string."""
        with open(self.tokenizer, encoding="utf-8") as f:
            some = json.load(f)["added_tokens"]
        if bad := [t["content"] for t in some if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
            raise ValueError(f"added tokens that take in what is beside them: {bad}")
        return {t["content"]: t["id"] for t in some}


class Tokens:
    """Ids of whole texts as little-endian 32-bit words.

    The ids are those of the tokenizer file, added tokens included. They are made from its rank file, which gives the same ids (the
    tests compare them) in a quarter of the time, without a table of words that would grow with the corpus. That library's matcher backtracks over white
    space on a stack of bounded size, so texts with runs of LONG_SPACE or more are encoded by the segment tree."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.vocabulary, self.added, self.own = vocabulary, vocabulary.added(), None
        self.encoding = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=load_ranks(vocabulary.ranks), special_tokens=self.added)

    def _by_segment_tree(self, text: str) -> np.ndarray:
        self.own = self.own or Encoder(self.vocabulary.ranks, self.vocabulary.pattern)
        longest_first = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        ids = []
        for part in re.split(f"({longest_first})", text) if self.added else [text]:
            ids += [self.added[part]] if part in self.added else self.own.encode(part)
        return np.array(ids, "<u4")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) >= LONG_SPACE and any(len(x) >= LONG_SPACE for x in re.findall(r"\s+", text)):
            return self._by_segment_tree(text).tobytes()
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


_tokens: dict[Vocabulary, Tokens] = {}


def tokens(vocabulary: Vocabulary) -> Tokens:
    """The worker's tokenizer, kept between tasks."""
    if vocabulary not in _tokens:
        _tokens[vocabulary] = Tokens(vocabulary)
    return _tokens[vocabulary]


def pieces(docs: DataFrame, vocabulary: Vocabulary, window: int) -> DataFrame:
    """Per document its full windows and its remainder: (doc_id, row_key, task, start, length, ids_crc32, doc_tokens)."""
    end = struct.pack("<I", END_ID)

    def run(batches):
        from pyspark import TaskContext

        task, enc = TaskContext.get().partitionId(), tokens(vocabulary)
        for b in slices(batches):
            rows = [], [], [], [], []
            for k, ids in enumerate(map(enc.encode, b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, window):
                    for column, v in zip(rows, (k, s, min(window, n - s), crc32(ids[4 * s : 4 * (s + window)]), n), strict=True):
                        column.append(v)
            at = pa.array(rows[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(2).take(at), pa.array([task] * len(at), pa.int64()), *(pa.array(x, pa.int64()) for x in rows[1:])],
                ["doc_id", "row_key", "task", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, row_key long, task long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(present: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of up to three (length, multiplicity) entries that fill a window exactly; length 0 pads."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    lengths, times = [], []

    def add(*entries):
        n = len(entries[0][0])
        lengths.append(np.stack([*(e[0] for e in entries), *[np.zeros(n, int)] * (3 - len(entries))], 1))
        times.append(np.stack([*(np.broadcast_to(e[1], n) for e in entries), *[np.zeros(n, int)] * (3 - len(entries))], 1))

    one = np.ones(1, int)
    if have[window]:
        add((np.array([window]), one))
    low = present[present < window]
    pair = low[(low * 2 < window) & have[window - low]]
    add((pair, one), (window - pair, one))
    for a in low[low * 3 < window]:
        b = low[(low > a) & (low * 2 < window - a)]
        b = b[have[window - a - b]]
        add((np.full(len(b), a), one), (b, one), (window - a - b, one))
    for k in range(2, window + 1):
        each = low[low * k <= window]
        if not len(each):
            break
        rest = window - k * each
        exact, other = each[rest == 0], (rest > 0) & have[rest] & (rest != each)
        add((exact, np.array([k])))
        add((each[other], np.array([k])), (rest[other], one))
    return np.concatenate(lengths), np.concatenate(times)


def repeats(lengths: np.ndarray, times: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares for the repeat counts: min |Ax - h|, x >= 0, by multiplicative updates."""
    h = histogram.astype(float)
    x = np.min(np.where(times > 0, h[lengths] / np.maximum(times, 1), np.inf), 1) / 4
    top = (times * h[lengths]).sum(1)
    for _ in range(NNLS_STEPS):
        fit = np.bincount(lengths.ravel(), (times * x[:, None]).ravel(), len(h))
        x *= top / np.maximum((times * fit[lengths]).sum(1), 1e-9)
    return x


def greedy(left: np.ndarray, window: int) -> list[int] | None:
    """The lengths of one full window: the longest that there is, then what is longest and fits, ended by a length or a pair that
    fills it. None if that fails."""
    have = left.copy()
    some = np.flatnonzero(have)
    if not len(some):
        return None
    out = [int(some[-1])]
    have[out[0]] -= 1
    room = window - out[0]
    while room:
        if have[room]:
            return [*out, room]
        low = np.flatnonzero(have[:room])
        pair = low[(have[room - low] > 0) & ((2 * low != room) | (have[low] > 1))]
        if len(pair):
            return [*out, int(pair[-1]), room - int(pair[-1])]
        if not len(low):
            return None
        out.append(int(low[-1]))
        have[low[-1]] -= 1
        room -= int(low[-1])
    return out


def plan(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where the pieces of each length go.

    Returns rows (length, first number, sequence, times per sequence, offset) sorted by length and number, then for each
    length the number of its first unplaced piece and that piece's position in the row of leftovers, and the leftovers' first
    sequence."""
    left, next_seq, rows = histogram.copy(), 0, []
    taken = np.zeros_like(histogram)
    present = np.flatnonzero(histogram)

    def put(entries: list[tuple[int, int]], n: int) -> None:
        nonlocal next_seq
        at = 0
        for a, m in entries:
            rows.append((a, int(taken[a]), next_seq, m, at))
            taken[a] += n * m
            left[a] -= n * m
            at += a * m
        next_seq += n

    if len(present):
        lengths, times = combinations(present, window)
        x = repeats(lengths, times, histogram) if len(lengths) else np.zeros(0)
        order = np.argsort(-x, kind="stable")
        for exact in (False, True):
            for p in order:
                entries = [(int(a), int(m)) for a, m in zip(lengths[p], times[p], strict=True) if m]
                fits = min(int(left[a]) // m for a, m in entries)
                n = fits if exact else min(int(x[p]), fits)
                if n <= 0:
                    if not exact and x[p] < 1:
                        break
                    continue
                put(entries, n)
        open_ = left.copy()
        while open_.any():
            found = greedy(open_, window)
            if found is None:
                open_[np.flatnonzero(open_)[-1]] = 0  # no window with this length as its longest can be filled
                continue
            entries = sorted(Counter(found).items(), reverse=True)
            n = min(int(open_[a]) // m for a, m in entries)
            put(entries, n)
            for a, m in entries:
                open_[a] -= n * m
    base, at = np.zeros(window + 1, np.int64), 0
    for a in range(window, 0, -1):
        base[a] = at
        at += a * int(left[a])
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table_, taken, base, next_seq


def place(numbered: DataFrame, histogram: np.ndarray, window: int) -> DataFrame:
    """The pieces with sequence_id and offset; a cut piece becomes two rows whose ids_crc32 is null."""
    spark = numbered.sparkSession
    shared = spark.sparkContext.broadcast(plan(histogram, window))

    def run(batches):
        rows, taken, base, first = shared.value
        big = 1 << 40
        keys = rows[:, 0] * big + rows[:, 1]
        for b in slices(batches):
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            start, doc = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("start", "doc_tokens"))
            crc = b.column(b.schema.get_field_index("ids_crc32")).to_numpy()
            planned = number < taken[length]
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            if planned.any():
                r = rows[np.searchsorted(keys, length[planned] * big + number[planned], "right") - 1]
                nth = number[planned] - r[:, 1]
                seq[planned], off[planned] = r[:, 2] + nth // r[:, 3], r[:, 4] + nth % r[:, 3] * length[planned]
            over = base[length[~planned]] + (number[~planned] - taken[length[~planned]]) * length[~planned]
            seq[~planned], off[~planned] = first + over // window, over % window
            room = np.minimum(length, window - off)
            cut = np.flatnonzero(room < length)
            at = np.concatenate([np.arange(len(length)), cut])
            tail = np.arange(len(at)) >= len(length)
            part = np.where(tail, length[at] - room[at], room[at])
            is_cut = np.isin(at, cut)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(start[at] + np.where(tail, room[at], 0)), pa.array(part), pa.array(crc[at], mask=is_cut), pa.array(doc[at]), pa.array(seq[at] + tail), pa.array(np.where(tail, 0, off[at]))],
                ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.select("doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "number").mapInArrow(run, f"doc_id {kind}, row_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def slice_checksums(docs: DataFrame, cuts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row_key, start, length, ids_crc32) of the cut pieces, by tokenizing their documents once more."""
    end = struct.pack("<I", END_ID)

    def run(batches):
        enc = tokens(vocabulary)
        for b in slices(batches):
            start, length = b.column(2).to_pylist(), b.column(3).to_pylist()
            crc = [crc32((ids + end)[4 * s : 4 * (s + n)]) for ids, s, n in zip(map(enc.encode, b.column(1).to_pylist()), start, length, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(crc, pa.int64())], ["row_key", "start", "length", "ids_crc32"])

    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("row_key"))
    wanted = cuts.select("row_key", "start", "length").distinct()
    if cuts.count() <= FEW_CUTS:
        wanted = F.broadcast(wanted)  # so many rows of 24 bytes at most; texts are not shuffled
    out = keyed.join(wanted, "row_key").select("row_key", "text", "start", "length")
    return out.mapInArrow(run, "row_key long, start long, length long, ids_crc32 long").dropDuplicates(["row_key", "start", "length"])


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, *, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    stage = Stage(spark, "packing")
    cut = stage.write(pieces(docs, vocabulary, window))
    counts = cut.groupBy("task", "length").count()
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `window` rows
        histogram[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    in_task = Window.partitionBy("task", "length").orderBy("doc_id", "start", "row_key")
    numbered = cut.withColumn("nth", F.row_number().over(in_task) - 1).join(offsets, ["task", "length"]).withColumn("number", (F.col("nth") + F.col("before")).cast("long"))
    placed = stage.write(place(numbered, histogram, window))
    stage.drop(cut)
    cuts = placed.where(F.col("ids_crc32").isNull()).drop("ids_crc32")
    sums = slice_checksums(docs, cuts, vocabulary)
    mended = cuts.join(sums, ["row_key", "start", "length"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.where(F.col("ids_crc32").isNotNull()).select(columns).unionByName(mended.select(columns))


def public_vocabulary() -> Vocabulary:
    import public_tokenizers as vocabularies

    return Vocabulary(vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_vocabulary())
