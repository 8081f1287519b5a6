"""Small neural networks for squared error, trained by synchronous full-batch steps whose gradients tasks sum up.

A step is one pass over the written rows: each task adds its rows' gradients up, a vector a fold; the vectors are summed along a tree of exchanges (by fold and
bucket of parts, then by fold), and one vector a fold goes to the driver, which makes the step of all folds and ships the new weights with the next pass. All
folds train in the same passes, so a walk-forward reads its rows once an epoch and not once a fold and epoch. Rows are written as blocks of doubles, which a
pass hands on whole. A task holds SLICE rows' activations at a time, those of recurrent cells in arrays that the next slice writes over.

Features and label are standardised by each fold's own training rows, from one row of moments a session. Weights start from draws seeded by seed and fold, and
vectors are added in the order of their parts, so a model depends on the seed and on how the rows are split into parts, the latter within rounding.

A missing, NaN or infinite feature counts as the training rows' mean; a row without a finite label trains nothing. Folds without training rows have no model
and predict null. Constant features and labels are scaled by 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import Stage
from ..workers import ship

SLICE = 4096
#: Parts whose vectors one task of the first exchange adds up.
FAN_IN = 64
#: The decay rates and the floor of Adam.
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Options:
    """kind: "dense" (one hidden layer of tanh), or "gru" and "lstm", which read the features as a sequence of single values, first to last."""

    kind: str = "dense"
    hidden: int = 32
    epochs: int = 40
    rate: float = 1e-3
    decay: float = 0.0
    seed: int = 7


class _Room:
    """Arrays by name that are written anew for each slice of rows, so that their memory is taken once."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size)
        return self.held[name][:size].reshape(shape)


_room = _Room()


def _squash(a: np.ndarray, gates: int) -> np.ndarray:
    """In place the logistic function of the first rows, and tanh x = 2 logistic(2x) - 1 of the others, by one exponential a value."""
    own = a[gates:]
    own *= 2
    np.negative(a, out=a)
    with np.errstate(over="ignore"):
        np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)
    own *= 2
    own -= 1
    return a


def shapes(options: Options, inputs: int) -> list[tuple[int, ...]]:
    """Of the input weights, the recurrent ones, the biases, the candidate's own bias (gru), the head and its bias."""
    h = options.hidden
    if options.kind == "dense":
        return [(inputs, h), (h,), (h,), (1,)]
    if options.kind == "gru":
        return [(1, 3 * h), (h, 3 * h), (3 * h,), (h,), (h,), (1,)]
    if options.kind == "lstm":
        return [(1, 4 * h), (h, 4 * h), (4 * h,), (h,), (1,)]
    raise ValueError(f"unknown kind of network: {options.kind}")


def split(weights: np.ndarray, options: Options, inputs: int) -> list[np.ndarray]:
    sizes = [int(np.prod(s)) for s in shapes(options, inputs)]
    return [w.reshape(s) for w, s in zip(np.split(weights, np.cumsum(sizes)[:-1]), shapes(options, inputs), strict=True)]


def start(options: Options, inputs: int, fold: int) -> np.ndarray:
    """The first weights, uniform within 1 / sqrt(hidden)."""
    n = sum(int(np.prod(s)) for s in shapes(options, inputs))
    return np.random.default_rng([options.seed, fold]).uniform(-1, 1, n) / np.sqrt(options.hidden)


def _stacked(weights: np.ndarray, options: Options, inputs: int) -> np.ndarray:
    """All of a cell's weights as one matrix over (hidden state, value, 1). Rows of gru: both gates, the state's part of the candidate, the value's; of lstm: the
    three gates, the candidate."""
    w, u, b, *own, _, _ = split(weights, options, inputs)
    h = options.hidden
    whole = np.vstack([u, w, b]).T
    if options.kind == "lstm":
        return whole[_lstm_order(h)]
    state, value = whole[2 * h :].copy(), whole[2 * h :].copy()
    state[:, h], state[:, h + 1], value[:, :h] = 0, own[0], 0
    return np.vstack([whole[: 2 * h], state, value])


def _lstm_order(h: int) -> np.ndarray:
    """The weights hold the candidate before the last gate."""
    return np.r_[: 2 * h, 3 * h : 4 * h, 2 * h : 3 * h]


def forward(weights: np.ndarray, x: np.ndarray, options: Options) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Predictions, what the way back needs, and the last hidden state. Recurrent cells hold a column a row, in arrays that the next call writes over."""
    n, steps, h = len(x), x.shape[1], options.hidden
    if options.kind == "dense":
        w, b, head, bias = split(weights, options, steps)
        last = np.tanh(x @ w + b)
        return last @ head + bias[0], (), last
    *_, head, bias = split(weights, options, steps)
    whole = _stacked(weights, options, steps)
    inputs, kept, more = _room("inputs", steps + 1, h + 2, n), _room("kept", steps, 4 * h, n), _room("more", steps, 2 * h, n)
    inputs[:, h + 1], inputs[:steps, h], inputs[0, :h] = 1, x.T, 0
    c = np.zeros((h, n))
    for t in range(steps):
        k, state = np.dot(whole, inputs[t], out=kept[t]), inputs[t + 1, :h]
        if options.kind == "gru":
            r, z, q, new = np.split(_squash(k[: 2 * h], 2 * h), 2) + np.split(k[2 * h :], 2)
            new += r * q
            _squash(new, 0)
            np.multiply(z, np.subtract(inputs[t, :h], new, out=more[t, :h]), out=state)
            state += new
        else:
            i, f, o, g = np.split(_squash(k, 3 * h), 4)
            more[t, h:] = c
            c *= f
            c += i * g
            more[t, :h] = c
            np.multiply(o, _squash(more[t, :h], 0), out=state)
    last = inputs[steps, :h]
    return head @ last + bias[0], (whole, inputs, kept, more), last


def gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray, options: Options) -> np.ndarray:
    """The gradient of half the sum of squared errors."""
    pred, back, last = forward(weights, x, options)
    miss, head, h = pred - y, split(weights, options, x.shape[1])[-2], options.hidden
    if options.kind == "dense":
        da = miss[:, None] * head * (1 - last * last)
        return np.concatenate([(x.T @ da).ravel(), da.sum(0), last.T @ miss, [miss.sum()]])
    whole, inputs, kept, more = back
    n, steps = x.shape[0], x.shape[1]
    d, total, dh, dc = _room("d", 4 * h, n), 0.0, np.outer(head, miss), np.zeros((h, n))
    before = whole[: 3 * h if options.kind == "gru" else 4 * h, :h].T.copy()
    for t in reversed(range(steps)):
        if options.kind == "gru":
            (r, z, q, new), (dr, dz, dq, dn) = np.split(kept[t], 4), np.split(d, 4)
            open_ = 1 - z
            open_ *= dh
            np.subtract(1, np.multiply(new, new, out=dn), out=dn)
            dn *= open_
            np.multiply(dn, r, out=dq)
            np.subtract(1, r, out=dr)
            dr *= q
            dr *= dq
            np.multiply(open_, z, out=dz)
            dz *= more[t, :h]
            dh *= z
            dh += before @ d[: 3 * h]
        else:
            (i, f, o, g), (di, df, do, dg), out = np.split(kept[t], 4), np.split(d, 4), more[t, :h]
            s = out * out
            np.subtract(1, s, out=s)
            s *= o
            s *= dh
            dc += s
            np.subtract(1, kept[t, : 3 * h], out=d[: 3 * h])
            d[: 3 * h] *= kept[t, : 3 * h]
            for one, a, b in ((di, dc, g), (df, dc, more[t, h:]), (do, dh, out)):
                one *= a
                one *= b
            np.subtract(1, np.multiply(g, g, out=dg), out=dg)
            dg *= dc
            dg *= i
            dc *= f
            dh = before @ d
        total = total + inputs[t] @ d.T
    if options.kind == "gru":
        plain = np.r_[: 2 * h, 3 * h : 4 * h]
        own = [total[h, plain], total[:h, : 3 * h].ravel(), total[h + 1, plain], total[h + 1, 2 * h : 3 * h]]
    else:
        total = total[:, _lstm_order(h)]  # its own inverse
        own = [total[h], total[:h].ravel(), total[h + 1]]
    return np.concatenate([*own, last @ miss, [miss.sum()]])


@dataclass
class Steps:
    """Adam's state of one fold."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    done: int = 0

    def step(self, g: np.ndarray, options: Options) -> None:
        g = g + options.decay * self.weights
        self.done += 1
        self.mean = BETA1 * self.mean + (1 - BETA1) * g
        self.square = BETA2 * self.square + (1 - BETA2) * g * g
        self.weights = self.weights - options.rate * (self.mean / (1 - BETA1**self.done)) / (np.sqrt(self.square / (1 - BETA2**self.done)) + TINY)


@dataclass
class Model:
    """By fold: centres and scales of the features and, last, of the label; weights."""

    features: list[str]
    options: Options
    centre: dict[int, np.ndarray] = field(default_factory=dict)
    scale: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def standard(self, fold: int, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - self.centre[fold][:-1]) / self.scale[fold][:-1])

    def predict(self, fold: int, x: np.ndarray) -> np.ndarray:
        own, out = self.standard(fold, x), [np.zeros(0)]
        for k in range(0, len(own), SLICE):
            out.append(forward(self.weights[fold], own[k : k + SLICE], self.options)[0])
        return np.concatenate(out) * self.scale[fold][-1] + self.centre[fold][-1]


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)  # NaN is over every number


def _matrix(b: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([b.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])


def moments(rows: DataFrame, member: np.ndarray, columns: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each fold, a row of member (folds x sessions): its training rows and the columns' means and deviations over them, merged from one row a session."""
    told = rows.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), *[g(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(columns) for k, g in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()
    rows_of, k = np.zeros(member.shape[1], np.int64), len(columns)
    n, m, v = (np.zeros((member.shape[1], k)) for _ in range(3))
    for r in told:
        rows_of[r["idx"]] = r["n"]
        for i in range(k):
            n[r["idx"], i], m[r["idx"], i], v[r["idx"], i] = r[f"n{i}"], r[f"m{i}"] or 0.0, r[f"v{i}"] or 0.0
    out = []
    for own in member:
        total = np.maximum(n[own].sum(0), 1)
        centre = (n[own] * m[own]).sum(0) / total
        spread = np.sqrt((n[own] * (v[own] + (m[own] - centre) ** 2)).sum(0) / total)
        out.append((int(rows_of[own].sum()), centre, np.where(spread > 1e-12, spread, 1.0)))
    return out


def _added(parts: DataFrame) -> DataFrame:
    """parts (fold, part, g) of an exchange -> the sums of each task's rows by fold and bucket, added in the order of parts."""

    def run(batches):
        found = sorted((f, p, g) for b in batches for f, p, g in zip(*(c.to_pylist() for c in b.columns), strict=True))
        sums: dict[tuple[int, int], np.ndarray] = {}
        for f, p, g in found:
            key = (f, p // FAN_IN)
            sums[key] = sums[key] + np.array(g) if key in sums else np.array(g)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["fold", "part", "g"])

    return parts.mapInArrow(run, parts.schema)


def packed(rows: DataFrame, inputs: int) -> DataFrame:
    """(block): rows (idx, y, x0..), batch by batch, as the bytes of a matrix of doubles with a row a column, so that a pass hands on whole matrices."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(_matrix(b, 0, inputs + 2).T).tobytes()], pa.binary())], ["block"])

    return rows.mapInArrow(run, "block binary")


def gradients(held: DataFrame, member: np.ndarray, folds: list[int], model: Model) -> dict[int, np.ndarray]:
    """Each fold's gradient at its weights, over all its training rows, of packed blocks."""
    n = len(model.features)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        part = 0
        for b in batches:
            for block in b.column(0):
                values = np.frombuffer(block.as_buffer()).reshape(n + 2, -1)
                of = member[:, values[0].astype(np.int64)]
                for k, f in enumerate(folds):
                    own = values[1:, of[k]] if not of[k].all() else values[1:]
                    for at in range(0, own.shape[1], SLICE):
                        y, x = own[0, at : at + SLICE], own[1:, at : at + SLICE].T
                        g = gradient(model.weights[f], model.standard(f, x), (y - model.centre[f][-1]) / model.scale[f][-1], model.options)
                        sums[f] = sums[f] + g if f in sums else g
            part = b.column(1)[0].as_py() if b.num_rows else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([part] * len(sums), pa.int64()), pa.array([g.tolist() for g in sums.values()], pa.list_(pa.float64()))], ["fold", "part", "g"])

    numbered = held.select("block", F.spark_partition_id().cast("long").alias("part"))
    sums, width = numbered.mapInArrow(run, "fold long, part long, g array<double>"), held.rdd.getNumPartitions()
    while width > 1:
        width = -(-width // FAN_IN)
        sums = _added(sums.repartition(len(folds) * width, "fold", F.floor(F.col("part") / FAN_IN)))
    return {r["fold"]: np.array(r["g"]) for r in sums.collect()}  # one row a fold


def fit(rows: DataFrame, training: DataFrame, features: list[str], *, label: str = "label", options: Options = Options()) -> Model:
    """A model for each fold of training (fold, idx), which has a row a fold and session."""
    ship(rows.sparkSession)
    stage = Stage(rows.sparkSession, "network")
    model = Model(features, options)
    shapes(options, len(features))
    given = rows.where(_finite(label).isNotNull()).select(F.col("idx").cast("long").alias("idx"), _finite(label).alias("y"), *[_finite(f).alias(f"x{i}") for i, f in enumerate(features)])
    pairs = training.select(F.col("fold").cast("long"), F.col("idx").cast("long")).distinct().collect()
    top = given.agg(F.max("idx")).first()[0]
    folds = sorted({p[0] for p in pairs})
    member = np.zeros((len(folds), max((p[1] for p in pairs), default=0) + 1 if top is None else max(top, *(p[1] for p in pairs), 0) + 1), bool)
    for fold, idx in pairs:
        member[folds.index(fold), idx] = True
    found = moments(given, member, [*(f"x{i}" for i in range(len(features))), "y"])
    some = [k for k, (n, _, _) in enumerate(found) if n]
    member, count = member[some], {folds[k]: found[k][0] for k in some}
    for k in some:
        _, model.centre[folds[k]], model.scale[folds[k]] = found[k]
    state = {f: Steps(w, np.zeros_like(w), np.zeros_like(w)) for f in count for w in [start(options, len(features), f)]}
    model.weights = {f: s.weights for f, s in state.items()}
    held = stage.write(packed(given, len(features)))
    for _ in range(options.epochs if state else 0):
        for f, g in gradients(held, member, list(state), model).items():
            state[f].step(g / count[f], options)
        model.weights = {f: s.weights for f, s in state.items()}
    stage.drop(held)
    return model


def predict(rows: DataFrame, model: Model, sessions: DataFrame, *, label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, trade_date, fold, pred, label) of the rows of the sessions (fold, idx), and the sessions' string columns `keep`."""
    ship(rows.sparkSession)
    kind = rows.schema["symbol"].dataType.simpleString()
    n = len(model.features)

    def run(batches):
        for b in batches:
            x, fold, out = _matrix(b, 0, n), b.column(n).to_numpy(), np.full(b.num_rows, np.nan)
            for f in np.unique(fold):
                if f in model.weights:
                    out[fold == f] = model.predict(int(f), x[fold == f])
            yield pa.RecordBatch.from_arrays([b.column(n + 1), b.column(n + 2), b.column(n), pa.array(out, mask=np.isnan(out)), b.column(n + 3), *b.columns[n + 4 :]], ["symbol", "trade_date", "fold", "pred", label, *keep])

    at = rows.join(F.broadcast(sessions.select("fold", "idx", *keep)), "idx")  # a row a fold and session
    given = at.select(*[_finite(f).alias(f"x{i}") for i, f in enumerate(model.features)], F.col("fold").cast("long").alias("fold"), "symbol", "trade_date", F.col(label).cast("double").alias(label), *keep)
    return given.mapInArrow(run, f"symbol {kind}, trade_date date, fold long, pred double, {label} double" + "".join(f", {k} string" for k in keep))


def walk_forward(rows: DataFrame, calendar: DataFrame, folds: DataFrame, features: list[str], *, label: str = "label", options: Options = Options()) -> DataFrame:
    """Out-of-sample predictions as ridge_walk_forward gives them."""
    from .validation import expanding_sessions, test_sessions

    folds = Stage(rows.sparkSession, "folds").write(folds)
    model = fit(rows, expanding_sessions(calendar, folds), features, label=label, options=options)
    return predict(rows, model, test_sessions(calendar, folds), label=label)


def ensemble(learners: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Predictions (symbol, trade_date, fold, pred, label) of several learners, as (learner, ...), and under the learner "ensemble" their mean where all of them
    have one. A learner's rows are unique by symbol, day and fold."""
    each = [p.select(F.lit(n).alias("learner"), "symbol", "trade_date", "fold", "pred", label) for n, p in learners.items()]
    union = each[0]
    for e in each[1:]:
        union = union.unionByName(e)
    mean = union.groupBy("symbol", "trade_date", "fold").agg(F.when(F.count("pred") == len(each), F.avg("pred")).alias("pred"), F.first(label, ignorenulls=True).alias(label))
    return union.unionByName(mean.where("pred is not null").withColumn("learner", F.lit("ensemble")))
