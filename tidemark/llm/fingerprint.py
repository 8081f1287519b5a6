"""Document fingerprints by invertible Bloom lookup tables over hashed paragraphs.

A text is cut into paragraphs: lines, within them sentences, and overlong sentences at words that their hash picks, so that an edit
moves few cuts. Each paragraph's digest (the n-th equal one counts as a paragraph of its own) goes to three cells, which sum counts,
digests and check digests. Subtracting two texts' tables leaves what differs; peeling cells that hold one digest recovers the
differing digests. A table too small for the difference does not empty: both are built anew at a size that its counts
suggest, and then twice that, until it does. Likeness is the share of common paragraphs among all (Jaccard, with repeats).

Neighbours: rows are dealt by ranges of doc_id and sorted, so a task meets a document and the next one together and each
text is shuffled once. Every range is also given a copy of the first row of the following one, which its last row is compared with.
Document ids are numbers.

Defined results: null text counts as empty; two empty texts have likeness 1; equal ids are ordered by text; null ids come
last; a single row is its own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import ship, slices, table

CELLS = 24
LONG_SENTENCE = 600
FIELD_CELLS = 1 << 17
RETRIES = 12
PART_BYTES = 256 << 20
MAX_PARTS = 20_000
_SENTENCES = re.compile(r"[^\n.!?]+[\n.!?]*|[\n.!?]+").findall
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def paragraphs(text: str) -> list[str]:
    out = []
    for s in _SENTENCES(text):
        if len(s) <= LONG_SENTENCE:
            out.append(s)
            continue
        part = []
        for w in s.split(" "):
            part.append(w)
            if zlib.crc32(w.encode()) % 16 == 0:
                out.append(" ".join(part))
                part = []
        out.append(" ".join(part))
    return out


def digests(text: str) -> np.ndarray:
    """A digest for each paragraph, sorted; the n-th of equal paragraphs has its own. Equal digests count once."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen.get(p, 0)
        seen[p] = n + 1
        out.append(xxh3_64_intdigest(p if not n else f"{p}\0{n}"))
    return np.unique(np.array(out, np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x632BE59B)) * _ODD[0]
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def _cells_of(keys: np.ndarray, third: int, salt: int) -> np.ndarray:
    """Three cells for each key, one in each third of the table: from three fields of one hash, or, in a large table, from a hash each."""
    n = np.uint64(third)
    if third > FIELD_CELLS:
        return np.concatenate([((_mix(keys, 3 * salt + k + 1) >> np.uint64(32)) * n >> np.uint64(32)).astype(np.int64) + k * third for k in range(3)])
    h, field = _mix(keys, salt + 1), np.uint64((1 << 21) - 1)
    part = [(((h >> np.uint64(21 * k)) & field) * n >> np.uint64(21)).astype(np.int64) + k * third for k in range(3)]
    return np.concatenate(part)


class Sketch:
    """cells x (count, digest sum, check sum), all modulo 2^64."""

    def __init__(self, counts, sums, checks, salt=0):
        self.counts, self.sums, self.checks, self.salt = counts, sums, checks, salt

    @classmethod
    def of(cls, keys: np.ndarray, cells: int = CELLS, salt: int = 0) -> Sketch:
        return cls.between(keys, keys[:0], cells, salt)

    @classmethod
    def between(cls, a: np.ndarray, b: np.ndarray, cells: int, salt: int) -> Sketch:
        """The table of a minus the table of b: cells are sums, so both texts' digests are entered at once, b's negated."""
        keys = np.concatenate([a, b])
        check = _mix(keys, 0)
        sign = np.ones(len(keys), np.int64)
        if len(b):
            sign[len(a) :] = -1
            keys, plain = keys.copy(), keys
            check[len(a) :] = -check[len(a) :]
            keys[len(a) :] = -keys[len(a) :]
        else:
            plain = keys
        at = _cells_of(plain, cells // 3, salt)
        counts, sums, checks = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        np.add.at(counts, at, np.concatenate([sign, sign, sign]))
        np.add.at(sums, at, np.concatenate([keys, keys, keys]))
        np.add.at(checks, at, np.concatenate([check, check, check]))
        return cls(counts, sums, checks, salt)

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.counts - other.counts, self.sums - other.sums, self.checks - other.checks, self.salt)

    def guess(self) -> int:
        """How many digests a difference seems to hold, from the spread of its counts within each third."""
        third = len(self.counts) // 3
        spread = self.counts - self.counts.reshape(3, third).mean(1).repeat(third)
        return max(abs(int(self.counts[:third].sum())), int((spread**2).sum() / (3 - 3 / third)))

    def peel(self) -> int | None:
        """How many digests the difference holds; None if the table is too small for it."""
        counts, sums, checks, found, third = self.counts.copy(), self.sums.copy(), self.checks.copy(), 0, len(self.counts) // 3
        while True:
            at = np.flatnonzero((counts == 1) | (counts == -1))
            sign = counts[at].astype(np.uint64)
            keys = sums[at] * sign
            check = _mix(keys, 0)
            pure = check == checks[at] * sign
            if not pure.any():
                break
            keys, first = np.unique(keys[pure], return_index=True)
            sign, check = sign[pure][first], check[pure][first]
            cells = _cells_of(keys, third, self.salt)
            signed, checked = keys * sign, check * sign
            np.subtract.at(counts, cells, np.concatenate([sign, sign, sign]).view(np.int64))
            np.subtract.at(sums, cells, np.concatenate([signed, signed, signed]))
            np.subtract.at(checks, cells, np.concatenate([checked, checked, checked]))
            found += len(keys)
        return None if counts.any() or sums.any() or checks.any() else found

    def text(self) -> str:
        packed = b"".join(x.astype(kind).tobytes() for x, kind in ((self.counts, "<u4"), (self.sums, "<u8"), (self.checks, "<u8")))
        return base64.b64encode(packed).decode()


def difference(a: np.ndarray, b: np.ndarray, base_a: Sketch, base_b: Sketch) -> int:
    """How many paragraph digests are in one text only, by subtracting and peeling, larger on failure.

    The small tables of the fingerprints tell small differences; larger ones are entered anew from the digests of both texts. After
    RETRIES failures, which random hashes practically never give, the digests themselves are compared."""
    diff = base_a - base_b
    guess = diff.guess()
    if guess <= CELLS and (n := diff.peel()) is not None:
        return n
    cells = 3 * max(CELLS // 3 * 2, min(guess, len(a) + len(b)) * 2 // 3)
    for salt in range(1, RETRIES + 1):
        if (n := Sketch.between(a, b, cells, salt).peel()) is not None:
            return n
        cells = 3 * min(2 * cells // 3, 2 * (len(a) + len(b)) + CELLS)
    return len(np.setxor1d(a, b, assume_unique=True))


class Print:
    """A text with its paragraph digests and fingerprint."""

    def __init__(self, text: str):
        self.value, self.keys = text, digests(text)
        self.sketch = Sketch.of(self.keys)

    def like(self, other: Print) -> float:
        both = len(self.keys) + len(other.keys)
        if not both:
            return 1.0
        common = (both - difference(self.keys, other.keys, self.sketch, other.sketch)) / 2
        return common / (both - common)


def compare(this: Print, following: Print) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = len(this.value)
    edited = Print(this.value[: n - n // 3] + following.value[: n // 3])
    return n, hashlib.sha256(edited.value.encode()).hexdigest(), this.sketch.text(), edited.sketch.text(), this.like(edited), this.like(following)


_OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _parts(docs: DataFrame) -> int:
    """How many ranges: one for each shuffle partition, and more where the optimizer's size of the table says so."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size // PART_BYTES if size < 1 << 60 else 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known, MAX_PARTS))


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, part, ahead): parts are ranges of descending doc_id; rows with ahead = 1 are the first row of the following part.

    At most `parts` bounds go to the driver, and a row finds its part among them by binary search. The bounds are plain numbers in the plan, so a
    task that runs again deals its rows as before."""
    shares = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("b")).first()["b"] if shares else None
    bounds = sorted(set(bounds or ()), reverse=True)
    part = F.lit(0)
    if bounds:
        held = F.array(*[F.lit(b) for b in bounds])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        part = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(held, at + k - 1) > F.col("doc_id"), at + k).otherwise(at))
    own = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(part).alias("part"))
    last = Window.orderBy("part")  # one short row for each part
    firsts = own.groupBy("part").agg(F.max("doc_id").alias("first_id"))
    order = firsts.select("part", "first_id", F.coalesce(F.lag("part").over(last), F.max("part").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    heads = own.join(F.broadcast(order), (own["part"] == order["part"]) & own["doc_id"].eqNullSafe(order["first_id"])).groupBy("before", "doc_id").agg(F.max("text").alias("text"))
    rows = own.withColumn("ahead", F.lit(0)).unionByName(heads.select("doc_id", "text", F.col("before").alias("part"), F.lit(1).alias("ahead")))
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("ahead", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likeness to that and to the next document by descending id."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")

    def run(batches):
        before = None
        for b in slices(batches):
            found = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = Print(text or "")
                if before is not None:
                    found.append((before[0], *compare(before[1], now)))
                before = doc, now
            if found:
                columns = list(zip(*found, strict=True))
                kinds = [("doc_id", b.schema.field(0).type), *_OUT]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    dealt = _dealt(docs, _parts(docs))
    return dealt.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_DDL}")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
