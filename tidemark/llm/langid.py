"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one separator, and n-grams of 1 to 3 characters are hashed
into 2^BITS features with weight (1 + ln count) * idf, scaled to unit length. Document frequencies are counted over all
learnable documents. The weights are learned by follow-the-regularised-leader (proximal, per coordinate) with elastic-net
penalties, in one task over a sample of at most MAX_FIT different learnable documents; every fifth of them only fits the temperature that
calibrates the scores. The model's size is bounded by features and languages; it is broadcast.

Learnable: non-null text with a letter and non-null language in documents that the caller selects. Only the text is ever an input of a
prediction. Defined results: null text and text without a letter give `und` and score 0, and so does everything if nothing is
learnable; equal scores go to the first language by name; repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, ship, slices, table, without

BITS = 16
MAX_FIT = 6000
#: How many different texts of a language the sample holds about, where an even share would hold fewer; a tenth of the sample goes to all such floors.
FLOOR = 50
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2e-4, 1e-4
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their counts in the whole text; none if it has no letter."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _is_letter()[c]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(letter, c, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([np.zeros(1, np.uint32), c[keep], np.zeros(1, np.uint32)]).astype(np.uint64)
    odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    one = (c + np.uint64(1)) * odd
    two = (one[:-1] ^ (one[:-1] >> np.uint64(31))) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * odd + c[2:] * np.uint64(0x165667B19E3779F9)
    n = np.bincount(np.concatenate([((x ^ (x >> np.uint64(32))) * odd >> shift) for x in (one, two, three)]).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def weights(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (features x languages), biases and temperature from (features, values, language) rows."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros((size, languages)), np.zeros((size, languages))

    def current(at):
        sign = np.sign(z[at])
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - sign * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    learn, check = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            at, x, y = learn[i]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = current(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = current(np.arange(size))
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in check]).reshape(-1, languages)
    target = np.array([y for _, _, y in check], int)
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean() if len(target) else 0.0
    low, high = np.log(0.05), np.log(20.0)
    for _ in range(40):  # golden-section search over the log of the temperature
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return w[:-1], w[-1], float(np.exp((low + high) / 2)) if len(target) else 1.0


class Model:
    """Languages with idf, weights, biases and temperature."""

    def __init__(self, languages, idf, w, bias, temperature):
        self.languages, self.idf, self.w, self.bias, self.temperature = languages, idf, w, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax((weights(at, n, self.idf) @ self.w[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(docs: DataFrame, learnable: Column, *, text: str = "text", lang: str = "lang", max_fit: int = MAX_FIT) -> Model:
    """Learns from the text and language of the learnable documents. max_fit bounds the sample that the weights are fitted on: an even share of the rows, and of
    rare languages some FLOOR texts, all if they have fewer. With more than max_fit / 10 languages there are no floors."""
    spark = docs.sparkSession
    ship(spark)
    stage = Stage(spark, "langid")
    known = docs.where(learnable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    by_lang = stage.write(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")))
    size, n_langs = by_lang.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    share = min(1.0, max_fit * 0.9 / max(size, 1))
    floor = min(FLOOR, int(max_fit * 0.1 / max(n_langs, 1)))

    def document_frequencies(batches):
        total, docs_seen = np.zeros(1 << BITS, np.int64), 0
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                at, _ = counts(t)
                total[at] += 1
                docs_seen += len(at) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs_seen))], ["feature", "n"])

    idf, seen = np.zeros(1 << BITS), 0
    for feature, n in known.select("text").mapInArrow(document_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():  # at most 2^BITS + 1 rows
        if feature < 0:
            seen = n
        else:
            idf[feature] = n
    idf = np.log((1 + seen) / (1 + idf)) + 1

    def featurize(batches):
        for b in slices(batches):
            rows = [(*counts(t), y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            rows = [r for r in rows if len(r[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.string())], ["at", "n", "lang"])

    own = by_lang.where(F.col("texts") * share < floor).select("lang", (F.lit(float(floor)) / F.col("texts")).alias("own_share"))  # at most max_fit / 10 rows, or none
    drawn = F.pmod(F.xxhash64("text"), F.lit(10**12)) < F.coalesce("own_share", F.lit(share)) * 10**12
    picked = known.join(F.broadcast(own), "lang", "left").where(drawn).select("text", "lang").dropDuplicates().limit(max_fit)  # a group of copies counts once
    sample = stage.write(picked.mapInArrow(featurize, "at array<long>, n array<long>, lang string"))
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 1)), np.zeros(1), 1.0)
    number = {x: i for i, x in enumerate(languages)}

    def fitted(batches):
        rows = []
        for b in slices(batches):
            for at, n, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.array(at)
                rows.append((at, weights(at, np.array(n), idf), number[y]))
        if rows:
            rows.sort(key=lambda r: (len(r[0]), r[2], r[1][0]))
            w, bias, t = fit(rows, len(languages))
            yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()]), pa.array([bias.astype("<f8").tobytes()]), pa.array([t])], ["w", "bias", "t"])

    r = sample.coalesce(1).mapInArrow(fitted, "w binary, bias binary, t double").first()
    stage.drop(sample, by_lang)
    return Model(languages, idf, np.frombuffer(r["w"], "<f4").reshape(1 << BITS, -1).astype(np.float64), np.frombuffer(r["bias"], "<f8"), r["t"])


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score, which take the place of columns of their names."""
    docs = without(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            found = [m.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
