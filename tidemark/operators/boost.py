"""Gradient-boosted trees for squared error, grown from gradient histograms that tasks sum up.

Features are cut into bins at quantiles once. A level of a tree is one pass: each task walks its rows down the trees so far, and adds their gradients into
histograms by (fold, node, feature, bin); the tables are summed by key, a window accumulates each feature's bins, and the split of the largest gain of
each node, a row a fold and node, goes to the driver. Leaves need no pass, as the split's own sums are theirs. All folds' trees grow in the same passes, so a
walk-forward reads its rows once a level and not once a fold and level.

Walking down the trees so far costs more with each tree, so after every KEEP trees the rows are written with their predictions.

Ties: of equal gains the feature that comes first and then the lower bin splits. A missing value falls into the lowest bin. Folds without training rows
have no model and predict null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stage
from ..workers import ship

KEEP = 10


@dataclass(frozen=True)
class Options:
    trees: int = 30
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    penalty: float = 1.0
    least_rows: int = 20
    least_gain: float = 1e-9


@dataclass
class Tree:
    """Nodes by heap number (children of k: 2k + 1 and 2k + 2). A row goes right if its bin is over the node's; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at, first = np.zeros(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1]
        flat, inner, feature = bins.ravel(), self.feature >= 0, np.maximum(self.feature, 0)
        while True:
            on = inner[at]
            if not on.any():
                return at
            at = np.where(on, 2 * at + 1 + (flat[first + feature[at]] > self.bin[at]), at)


@dataclass
class Model:
    """Bin edges by feature, and each fold's mean and trees."""

    features: list[str]
    edges: list[np.ndarray]
    base: dict[int, float]
    trees: dict[int, list[Tree]] = field(default_factory=dict)

    def cut(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, np.nan_to_num(x, nan=-np.inf), "left") for e, x in zip(self.edges, columns, strict=True)]).astype(np.uint8) if columns else np.zeros((0, 0), np.uint8)

    def predict(self, fold: int, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base[fold])
        for t in self.trees[fold]:
            out += t.value[t.leaves(bins)]
        return out


def edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of the bins but the last: distinct approximate quantiles."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(x if x is not None else [], float)) for x in found]


def _binned(rows: DataFrame, model: Model, label: str, folds: list[int]) -> DataFrame:
    """(idx, bins binary, y, preds array): the label's rows with each fold's prediction so far."""
    base = [model.base.get(f, 0.0) for f in folds]

    def run(batches):
        for b in batches:
            columns = [b.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(len(model.features))]
            cut = model.cut(columns)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in cut], pa.binary()), b.column(1), pa.array([base] * b.num_rows, pa.list_(pa.float64()))], ["idx", "bins", "y", "preds"])

    given = rows.where(F.col(label).isNotNull()).select(F.col("idx").cast("long").alias("idx"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in model.features])
    return given.mapInArrow(run, "idx long, bins binary, y double, preds array<double>")


def _unpacked(b: pa.RecordBatch, features: int, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cut = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, features)
    return b.column(0).to_numpy(), cut, b.column(2).to_numpy(), b.column(3).flatten().to_numpy().reshape(b.num_rows, folds)


def _histograms(rows: DataFrame, member: np.ndarray, folds: list[int], growing: list[list[Tree]], features: int, bins: int) -> DataFrame:
    """(fold, node, feature, bin, g, n): sums of residuals and counts of training rows at the nodes where growing trees stand."""

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            idx, cut, y, preds = _unpacked(b, features, len(folds))
            slots = cut + np.arange(features) * bins
            for k in range(len(folds)):
                here = np.flatnonzero(member[k, idx])
                if not len(here) or not growing[k]:
                    continue
                some, rest = cut[here], y[here] - preds[here, k]
                for t in growing[k][:-1]:
                    rest = rest - t.value[t.leaves(some)]
                at = growing[k][-1].leaves(some)
                # all nodes, features and bins are counted at once
                nodes, place = np.unique(at, return_inverse=True)
                keys, size = (place[:, None] * (features * bins) + slots[here]).ravel(), len(nodes) * features * bins
                h = np.stack([np.bincount(keys, np.repeat(rest, features), size), np.bincount(keys, minlength=size)], 1).reshape(len(nodes), features, bins, 2)
                for node, own in zip(nodes.tolist(), h, strict=True):
                    if (k, node) in total:
                        total[k, node] += own
                    else:
                        total[k, node] = own.copy()
        for (k, node), h in total.items():
            f, c = np.nonzero(h[:, :, 1])
            yield pa.RecordBatch.from_arrays([pa.array([folds[k]] * len(f), pa.int64()), pa.array([node] * len(f), pa.int64()), pa.array(f), pa.array(c), pa.array(h[f, c, 0]), pa.array(h[f, c, 1].astype(np.int64))], ["fold", "node", "feature", "bin", "g", "n"])

    parts = rows.mapInArrow(run, "fold long, node long, feature long, bin long, g double, n long")
    return parts.groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def best_splits(histograms: DataFrame, options: Options) -> DataFrame:
    """(fold, node, g, n, split): each node's sums and its best split (gain, feature, bin, lg, ln), null if none is allowed."""
    by = Window.partitionBy("fold", "node", "feature")
    run = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = histograms.select("fold", "node", "feature", "bin", F.sum("g").over(run).alias("lg"), F.sum("n").over(run).alias("ln"), F.sum("g").over(by).alias("g"), F.sum("n").over(by).alias("n"))
    worth = lambda g, n: g * g / (n + options.penalty)
    gain = worth(F.col("lg"), F.col("ln")) + worth(F.col("g") - F.col("lg"), F.col("n") - F.col("ln")) - worth(F.col("g"), F.col("n"))
    allowed = (F.col("ln") >= options.least_rows) & (F.col("n") - F.col("ln") >= options.least_rows) & (gain > options.least_gain)
    # gains that are equal but for the order of sums count as equal
    told = h.withColumn("s", F.when(allowed, F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "lg", "ln")))
    return told.groupBy("fold", "node").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.max("s").alias("split"))


def fit(rows: DataFrame, training: DataFrame, features: list[str], *, label: str = "label", options: Options = Options()) -> Model:
    """A model for each fold of training (fold, idx), which has a row a fold and session."""
    ship(rows.sparkSession)
    stage = Stage(rows.sparkSession, "boost")
    pairs = training.select(F.col("fold").cast("long"), F.col("idx").cast("long")).distinct().collect()
    folds, last = sorted({p[0] for p in pairs}), max((p[1] for p in pairs), default=-1)
    top = rows.agg(F.max("idx")).first()[0]
    member = np.zeros((len(folds), max(last, top if top is not None else -1) + 1), bool)
    for fold, idx in pairs:
        member[folds.index(fold), idx] = True
    model = Model(features, edges(rows, features, options.bins), {})
    means = rows.where(F.col(label).isNotNull()).join(training, "idx").groupBy("fold").agg(F.avg(label).alias("m")).collect()
    model.base = {r["fold"]: r["m"] for r in means}
    folds_in = [f for f in folds if f in model.base]
    member = member[[folds.index(f) for f in folds_in]]
    model.trees = {f: [] for f in folds_in}
    if not folds_in:
        return model
    held = stage.write(_binned(rows, model, label, folds_in))
    since: dict[int, list[Tree]] = {f: [] for f in folds_in}
    size = 2 ** (options.depth + 1) - 1
    for _ in range(options.trees):
        growing = {f: Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for f in folds_in}
        open_ = {(f, 0) for f in folds_in}
        for _level in range(options.depth):
            found = best_splits(_histograms(held, member, folds_in, [[*since[f], growing[f]] for f in folds_in], len(features), options.bins), options).collect()
            after = set()
            for r in found:
                f, node, s = r["fold"], r["node"], r["split"]
                if (f, node) not in open_:
                    continue
                worth = lambda g, n: options.rate * g / (n + options.penalty)
                t = growing[f]
                t.value[node] = worth(r["g"], r["n"])
                if s is not None:
                    t.feature[node], t.bin[node] = -s["f"], -s["b"]
                    t.value[2 * node + 1], t.value[2 * node + 2] = worth(s["lg"], s["ln"]), worth(r["g"] - s["lg"], r["n"] - s["ln"])
                    after |= {(f, 2 * node + 1), (f, 2 * node + 2)}
            open_ = after
            if not open_:
                break
        for f in folds_in:
            since[f].append(growing[f])
            model.trees[f].append(growing[f])
        if len(since[folds_in[0]]) == KEEP:
            new = stage.write(_advanced(held, [since[f] for f in folds_in], len(features)))
            stage.drop(held)
            held, since = new, {f: [] for f in folds_in}
    stage.drop(held)
    return model


def _advanced(rows: DataFrame, trees: list[list[Tree]], features: int) -> DataFrame:
    """The rows with the trees' values added to each fold's prediction."""

    def run(batches):
        for b in batches:
            _, cut, _, preds = _unpacked(b, features, len(trees))
            preds = preds + np.column_stack([sum((t.value[t.leaves(cut)] for t in own), np.zeros(len(cut))) for own in trees])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(preds.tolist(), pa.list_(pa.float64()))], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def predict(rows: DataFrame, model: Model, sessions: DataFrame, *, label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, trade_date, fold, pred, label) of the rows of the sessions (fold, idx), and the sessions' string columns `keep`."""
    ship(rows.sparkSession)
    kind = rows.schema["symbol"].dataType.simpleString()
    n = len(model.features)

    def run(batches):
        for b in batches:
            cut = model.cut([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])
            fold, out = b.column(n).to_numpy(), np.full(b.num_rows, np.nan)
            for f in np.unique(fold):
                if f in model.base:
                    out[fold == f] = model.predict(int(f), cut[fold == f])
            yield pa.RecordBatch.from_arrays([b.column(n + 1), b.column(n + 2), b.column(n), pa.array(out, mask=np.isnan(out)), b.column(n + 3), *b.columns[n + 4 :]], ["symbol", "trade_date", "fold", "pred", label, *keep])

    at = rows.join(F.broadcast(sessions.select("fold", "idx", *keep)), "idx")  # a row a fold and session
    given = at.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(model.features)], F.col("fold").cast("long").alias("fold"), "symbol", "trade_date", F.col(label).cast("double").alias(label), *keep)
    return given.mapInArrow(run, f"symbol {kind}, trade_date date, fold long, pred double, {label} double" + "".join(f", {k} string" for k in keep))


def walk_forward(rows: DataFrame, calendar: DataFrame, folds: DataFrame, features: list[str], *, label: str = "label", options: Options = Options()) -> DataFrame:
    """Out-of-sample predictions as ridge_walk_forward gives them."""
    from .validation import expanding_sessions, test_sessions

    folds = Stage(rows.sparkSession, "folds").write(folds)
    model = fit(rows, expanding_sessions(calendar, folds), features, label=label, options=options)
    return predict(rows, model, test_sessions(calendar, folds), label=label)
