"""Histogram trees and boosted trees of all held-out windows at once.

Each fold imputes medians, cuts every input into at most BINS bins at quantiles of its own training rows, and grows trees of
limited depth on sums of gradients, curvatures and rows by bin: a leaf's value is -rate * G / (H + l2), a split has at
least `least` rows on either side and the largest gain G * G / (H + l2) above its parent's. A single tree is one round at rate 1
without penalty (with 0/1 labels its splits are those of Gini impurity).

The rows are binned once. Training rows of a fold that share the bins of all inputs take the same way through every tree, so they
are added up beforehand: what a tree asks of them are their number, weight and weighted sums of cost and label. Inputs are states at
the end of a second, so the work grows with the distinct states, not with the fills of a second; without equal rows nothing is lost.
A level of the trees of all folds, feature sets and targets is one pass: tasks add up
histograms, these are dealt out by fold, forest, node and input and summed as they stream in, and only the best split of each
input returns to the driver, so what it holds grows with the numbers of folds and inputs, not with the rows. Folds of at most
LOCAL_ROWS distinct states, counted beforehand, are grown by the same steps inside one task for each forest instead, as 300 passes
over little data are all overhead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.operators.folds import ALL, Panel, arrays, chunks, fold_medians
from lotline.sources.scratch import removed, written

BINS = 255
#: Weighted points that stand for the known values of an input in a window; as many distinct values are kept exactly.
POINTS = 4096
#: Summaries of an input and window that a task of the first merge sees, as a share of all: one of so many.
SALTS = 32
#: Distinct states of a fold that one task holds (some 100 bytes each).
LOCAL_ROWS = 1_000_000
#: Rounds whose trees are evaluated anew in each pass before the sums are written.
STATE_ROUNDS = 10
DEPTH = 3
NODES, LEAVES = (1 << DEPTH) - 1, 1 << DEPTH
#: Gains that differ by less, relatively, are equal; the first input and bin is taken.
SAME = 1e-9

COST, LABEL = "cost", "label"


@dataclass(frozen=True)
class Spec:
    """One kind of forest over some inputs."""

    inputs: tuple[str, ...]
    rounds: int = 100
    rate: float = 0.05
    least: int = 100
    l2: float = 1.0
    curvature: float = 1e-3  #: least sum of curvatures on either side
    logistic: bool = True  #: whether the label's forest is boosted on the log loss


def single_tree(inputs: tuple[str, ...], least: int = 100) -> Spec:
    return Spec(inputs, 1, 1.0, least, 0.0, 0.0, False)


@dataclass
class Tree:
    """A complete tree: inputs (-1: no split, all rows go left) and bins of its NODES, values of its LEAVES."""

    inputs: np.ndarray
    bins: np.ndarray
    values: np.ndarray


#: Bit of each node of a tree in a row's code, and by code the place at each depth: a row's way follows from which nodes send it right.
CODES = np.arange(1 << NODES, dtype=np.uint8)


def _places() -> list[np.ndarray]:
    at, out = np.zeros(1 << NODES, np.uint8), []
    for d in range(DEPTH + 1):
        out.append(at)
        at = 2 * at + (CODES >> (at + (1 << d) - 1) & 1)
    return out


PLACES = _places()


def codes(columns: np.ndarray, tree: Tree, depth: int = DEPTH) -> np.ndarray:
    """Which of a tree's nodes above a depth would send each row right, a bit each. columns: inputs x rows, so that a node compares one run of bytes."""
    out = np.zeros(columns.shape[1], np.uint8)
    for node in range((1 << depth) - 1):
        if tree.inputs[node] >= 0:
            out |= (columns[tree.inputs[node]] > np.uint8(tree.bins[node])).view(np.uint8) << np.uint8(node)
    return out


def place(columns: np.ndarray, tree: Tree, depth: int = DEPTH) -> np.ndarray:
    """The node of each row (column of inputs x rows) at a depth, counted from the left."""
    return PLACES[depth][codes(columns, tree, depth)]


def value(columns: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(columns.shape[1])
    for tree in trees:
        out += tree.values[PLACES[DEPTH]][codes(columns, tree)]
    return out


def gradients(raw: np.ndarray, target: np.ndarray, weight: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and curvatures of rows with the same raw value; target: their weighted sum of the target."""
    if not logistic:
        return raw * weight - target, weight
    p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
    return p * weight - target, p * (1 - p) * weight


def histograms(columns: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """nodes x inputs x bins x (gradient, curvature, rows), an input after the other, so that what is counted stays near."""
    out, size = np.empty((nodes, len(columns), BINS + 1, 3)), nodes * (BINS + 1)
    first = node.astype(np.int64) * (BINS + 1)
    for j, bins in enumerate(columns):
        key = first + bins
        for k, sums in enumerate((np.bincount(key, g, size), np.bincount(key, h, size), np.bincount(key, rows, size))):
            out[:, j, :, k] = sums.reshape(nodes, BINS + 1)
    return out


def best_bin(sums: np.ndarray, spec: Spec) -> tuple[float, int, np.ndarray, np.ndarray] | None:
    """(gain, bin, left sums, all sums) of the best split of a node by one input; rows of the bin and below go left."""
    left = np.cumsum(sums, axis=0)
    total = left[-1]
    right = total - left
    ok = (left[:, 2] >= spec.least) & (right[:, 2] >= spec.least) & (left[:, 1] >= spec.curvature) & (right[:, 1] >= spec.curvature)
    ok &= (left[:, 1] + spec.l2 > 0) & (right[:, 1] + spec.l2 > 0)
    if not ok.any():
        return None
    part = lambda x: x[:, 0] ** 2 / np.where(ok, x[:, 1] + spec.l2, 1)
    gain = np.where(ok, part(left) + part(right) - total[0] ** 2 / (total[1] + spec.l2), -np.inf)
    top = gain.max()
    if top <= SAME * max(1e-300, total[0] ** 2 / (total[1] + spec.l2)) or top <= 0:
        return None
    at = int(np.argmax(gain >= top * (1 - SAME)))
    return float(gain[at]), at, left[at], total


class Growing:
    """A tree whose levels are split one after the other."""

    def __init__(self, spec: Spec):
        self.spec, self.depth = spec, 0
        self.tree = Tree(np.full(NODES, -1), np.zeros(NODES, np.int64), np.zeros(LEAVES))
        self.open = {0}
        self.totals: dict[int, np.ndarray] = {}  # sums of the nodes of the present depth

    def split(self, found: dict[int, list[tuple[int, tuple | None]]], sums: dict[int, np.ndarray] | None = None) -> None:
        """found: for each open node the best split by each input, in order of the input; sums: of the root at first."""
        if self.depth == 0:
            self.totals = dict(sums or {})
        nodes, below = set(), {}
        for node in range(1 << self.depth):
            best = [(f, x) for f, x in found.get(node, []) if x is not None] if node in self.open else []
            if best:
                top = max(x[0] for _, x in best)
                f, (_, at, left, total) = next((f, x) for f, x in best if x[0] >= top * (1 - SAME))
                self.tree.inputs[node + (1 << self.depth) - 1], self.tree.bins[node + (1 << self.depth) - 1] = f, at
                below[2 * node], below[2 * node + 1] = left, total - left
                nodes |= {2 * node, 2 * node + 1}
            elif node in self.totals:
                below[2 * node] = self.totals[node]
        self.totals, self.open, self.depth = below, nodes, self.depth + 1
        if self.depth == DEPTH:
            for leaf, s in below.items():
                self.tree.values[leaf] = -self.spec.rate * s[0] / (s[1] + self.spec.l2) if s[1] + self.spec.l2 > 0 else 0.0

    def done(self) -> bool:
        return self.depth == DEPTH


def grow_local(bins: np.ndarray, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, spec: Spec, logistic: bool, base: float) -> list[Tree]:
    """A forest over states (states x inputs) that are all here, each of so many rows."""
    raw, trees, bins = np.full(len(bins), base), [], np.ascontiguousarray(bins.T)
    for _ in range(spec.rounds):
        g, h = gradients(raw, target, weight, logistic)
        growing = Growing(spec)
        while not growing.done():
            found, depth = {}, growing.depth
            if growing.open:
                sums = histograms(bins, place(bins, growing.tree, depth), 1 << depth, g, h, rows)
                found = {n: [(f, best_bin(sums[n, f], spec)) for f in range(len(bins))] for n in growing.open}
            growing.split(found, {0: np.array([g.sum(), h.sum(), rows.sum()])})
        trees.append(growing.tree)
        raw += growing.tree.values[place(bins, growing.tree)]
    return trees


# ---------------------------------------------------------------- bins


def condensed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their weights; more than POINTS are replaced by as many quantiles of equal weight."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values))
    if len(values) <= POINTS:
        return values, weights
    below, step = np.cumsum(weights), weights.sum() / POINTS
    some, counts = np.unique(np.searchsorted(below, (np.arange(POINTS) + 0.5) * step), return_counts=True)
    return values[some.clip(max=len(values) - 1)], counts * step


def merged(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Summaries (keys..., values, weights) added up by key as they stream in; what is held for a key stays below a few times POINTS."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for *key, values, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = held.setdefault(tuple(key), [[], [], 0])
            own[0].append(np.frombuffer(values, np.float64))
            own[1].append(np.frombuffer(weights, np.float64))
            own[2] += len(own[0][-1])
            if own[2] > 4 * POINTS:
                v, w = condensed(np.concatenate(own[0]), np.concatenate(own[1]))
                own[:] = [v], [w], len(v)
    yield from (summary(key, *condensed(np.concatenate(v), np.concatenate(w))) for key, (v, w, _) in held.items())


def summary(key: tuple, values: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    names = ["window", "input", "salt"][: len(key)]
    return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([values.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], [*names, "points", "weights"])


def window_points(panel: Panel) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By window and input: points of its known values and the rows that each stands for."""
    n = len(panel.features)

    def run(batches):
        def single():
            for batch in batches:
                window, _, _, _, x = arrays(batch, n)
                for i in np.unique(window).tolist():
                    for j in range(n):
                        v = x[window == i, j]
                        v = v[~np.isnan(v)] + 0.0
                        if len(v):
                            yield summary((i, j), *condensed(v, np.ones(len(v))))

        for batch in merged(single(), 2):
            key = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            yield summary((*key, salt(batch)), *(np.frombuffer(batch.column(k)[0].as_py(), np.float64) for k in (2, 3)))

    def salt(batch):
        from pyspark import TaskContext

        return TaskContext.get().partitionId() % SALTS

    first = panel.rows.select("window", "y", "b", "w", "x").mapInArrow(run, "window int, input int, salt int, points binary, weights binary")
    some = first.repartition("window", "input", "salt").mapInArrow(lambda b: merged(b, 3), first.schema)
    every = some.drop("salt").repartition("window", "input").mapInArrow(lambda b: merged(b, 2), "window int, input int, points binary, weights binary")
    return {(r[0], r[1]): (np.frombuffer(bytes(r[2]), np.float64), np.frombuffer(bytes(r[3]), np.float64)) for r in every.toLocalIterator()}


def fold_edges(panel: Panel, fill: dict[int, np.ndarray]) -> dict[int, list[np.ndarray]]:
    """The upper edges of all bins but the last, by fold and input.

    Midpoints between the distinct values where a fold has at most BINS of them, else quantiles of the training rows, from
    at most POINTS points for each window and input, and the imputed value with the weight of the rows that don't know theirs.
    """
    points = window_points(panel)
    rows = {r["window"]: r["count"] for r in panel.rows.groupBy("window").count().collect()}
    out = {}
    for fold in panel.folds():
        out[fold] = []
        use = [w for w in rows if w != fold]
        for j in range(len(panel.features)):
            own = [points[w, j] for w in use if (w, j) in points]
            unknown = sum(rows[w] for w in use) - sum(float(w.sum()) for _, w in own)
            values = np.concatenate([v for v, _ in own] + [[fill[fold][j]] * (unknown > 0.5)])
            weights = np.concatenate([w for _, w in own] + [[unknown] * (unknown > 0.5)])
            distinct, at = np.unique(values, return_inverse=True)
            if len(distinct) <= BINS:
                out[fold].append((distinct[1:] + distinct[:-1]) / 2)
            else:
                share = np.cumsum(np.bincount(at, weights)) / weights.sum()
                out[fold].append(np.unique(distinct[np.searchsorted(share, np.arange(1, BINS) / BINS).clip(0, len(distinct) - 2)]))
    return out


def binned(x: np.ndarray, fill: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value; unknown ones are imputed."""
    z = np.where(np.isnan(x), fill, x)
    return np.column_stack([np.searchsorted(e, z[:, j], "left") for j, e in enumerate(edges)]).astype(np.uint8) if z.shape[1] else np.zeros((len(z), 0), np.uint8)


# ---------------------------------------------------------------- forests of all folds


@dataclass
class Forests:
    """Trees by (fold, name, target) with the value that they start from; fills and edges by fold."""

    features: tuple[str, ...]
    specs: dict[str, Spec]
    fill: dict[int, np.ndarray]
    edges: dict[int, list[np.ndarray]]
    base: dict[tuple[int, str], float]
    trees: dict[tuple[int, str, str], list[Tree]]

    def columns(self, name: str) -> list[int]:
        return [self.features.index(c) for c in self.specs[name].inputs]

    def predict(self, x: np.ndarray, fold: int, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Cost and probability of a favourable pair for rows of inputs (NaN: unknown)."""
        at = self.columns(name)
        bins = np.ascontiguousarray(binned(x[:, at], self.fill[fold][at], [self.edges[fold][j] for j in at]).T)
        raw = [self.base[fold, target] if target == COST or not self.specs[name].logistic else logit(self.base[fold, target]) for target in (COST, LABEL)]
        cost, label = (r + value(bins, self.trees[fold, name, target]) for r, target in zip(raw, (COST, LABEL), strict=True))
        return cost, 1 / (1 + np.exp(-np.clip(label, -700, 700))) if self.specs[name].logistic else np.clip(label, 0, 1)


def logit(p: float) -> float:
    return math.log(p / (1 - p)) if 0 < p < 1 else math.copysign(700.0, p - 0.5)


def forest_models(fitted: Forests) -> dict[str, Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]]:
    return {name: (lambda x, fold, name=name: fitted.predict(x, fold, name)) for name in fitted.specs}


def alike(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bytes, and which of them each row is."""
    if not bins.shape[1]:
        return bins[:1], np.zeros(len(bins), np.int64)
    _, first, at = np.unique(np.ascontiguousarray(bins).view(np.dtype((np.void, bins.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return bins[first], at


def training_states(panel: Panel, fill: dict[int, np.ndarray], edges: dict[int, list[np.ndarray]], folds: list[int]) -> DataFrame:
    """(fold, n, y, b, w, bins): the training rows of each fold that share all bins as one: their number, weighted sums of cost and label, and weight."""
    n = len(panel.features)

    def run(batches):
        for window, y, b, w, x in chunks(batches, n):
            for fold in folds:
                own = window != fold
                if not own.any():
                    continue
                states, at = alike(binned(x[own], fill[fold], edges[fold]))
                sums = [np.bincount(at, v, len(states)) for v in (np.ones(len(at)), (w * y)[own], (w * b)[own], w[own])]
                offsets = pa.py_buffer((np.arange(len(states) + 1) * n).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(states), [None, offsets, pa.py_buffer(np.ascontiguousarray(states))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(states), fold, np.int32)), *(pa.array(v) for v in sums), packed], ["fold", "n", "y", "b", "w", "bins"])

    parts = panel.rows.select("window", "y", "b", "w", "x").mapInArrow(run, "fold int, n double, y double, b double, w double, bins binary")
    return parts.groupBy("fold", "bins").agg(*[F.sum(c).alias(c) for c in ("n", "y", "b", "w")]).select("fold", "n", "y", "b", "w", "bins")


def unpacked(column: pa.Array, n: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), n) if len(column) else np.zeros((0, n), np.uint8)


TREE = "fold int, forest int, round int, inputs array<int>, bins array<int>, values array<double>"


def fit_forests(panel: Panel, specs: dict[str, Spec], folds: list[int] | None = None, local_rows: int = LOCAL_ROWS) -> Forests:
    """The forests of cost and label of each spec for the folds (all by default).

    A fold without training rows has the base values 0 and 0.5 and trees without splits; one class only gives the probability 0 or 1.
    """
    folds = panel.folds() if folds is None else folds
    fill = fold_medians(panel)
    edges = fold_edges(panel, fill)
    sums = {r["window"]: np.array([r["n"], r["w"], r["y"], r["b"]], float) for r in panel.rows.groupBy("window").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("b")).alias("b")).collect()}
    base = {}
    for fold in folds:
        n, w, y, b = sum((s for i, s in sums.items() if i != fold), np.zeros(4))
        base[fold, COST], base[fold, LABEL] = (y / w, b / w) if n else (0.0, 0.5)
    out = Forests(panel.features, specs, fill, edges, base, {})
    forests = [(name, target) for name in specs for target in (COST, LABEL)]
    states = written(training_states(panel, fill, edges, folds), "states")
    held = {r["fold"]: r["count"] for r in states.groupBy("fold").count().collect()}
    small = [f for f in folds if held.get(f, 0) <= local_rows]
    large = [f for f in folds if held.get(f, 0) > local_rows]
    if small:
        _fit_small(states.where(F.col("fold").isin(small)), out, forests, small)
    if large:
        _fit_large(states.where(F.col("fold").isin(large)), out, forests, large)
    removed(states)
    return out


def _start(model: Forests, fold: int, name: str, target: str) -> tuple[float, bool]:
    logistic = target == LABEL and model.specs[name].logistic
    base = model.base[fold, target]
    return (logit(base) if logistic else base), logistic


def _trees(rows: list, model: Forests, forests: list[tuple[str, str]]) -> None:
    for r in sorted(rows, key=lambda r: (r["fold"], r["forest"], r["round"])):
        tree = Tree(np.array(r["inputs"]), np.array(r["bins"]), np.array(r["values"]))
        model.trees.setdefault((r["fold"], *forests[r["forest"]]), []).append(tree)


def _fit_small(states: DataFrame, model: Forests, forests: list[tuple[str, str]], folds: list[int]) -> None:
    """One task for each forest of a fold; only trees return."""
    n = len(model.features)
    plan = [(model.specs[name], model.columns(name), target) for name, target in forests]
    starts = {(fold, i): _start(model, fold, *f) for fold in folds for i, f in enumerate(forests)}
    types = pa.schema([("fold", pa.int32()), ("forest", pa.int32()), ("round", pa.int32()), ("inputs", pa.list_(pa.int32())), ("bins", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        every, columns = unpacked(table["bins"].combine_chunks(), n), {c: table[c].to_numpy() for c in ("fold", "forest", "n", "y", "b", "w")}
        for fold, forest in sorted(set(zip(columns["fold"].tolist(), columns["forest"].tolist(), strict=True))):
            spec, inputs, target = plan[forest]
            own = np.flatnonzero((columns["fold"] == fold) & (columns["forest"] == forest))
            own = own[np.lexsort(every[own].T[::-1])] if n else own  # sums don't depend on the order in which states arrive
            base, logistic = starts[fold, forest]
            trees = grow_local(every[own][:, inputs], columns["n"][own], columns["y" if target == COST else "b"][own], columns["w"][own], spec, logistic, base)
            rows = [{"fold": fold, "forest": forest, "round": r, "inputs": t.inputs.tolist(), "bins": t.bins.tolist(), "values": t.values.tolist()} for r, t in enumerate(trees)]
            yield from pa.Table.from_pylist(rows, types).to_batches()

    number = (F.array_position(F.lit(folds), F.col("fold")) - 1) * len(forests) + F.col("forest")
    rows = states.withColumn("forest", F.explode(F.lit(list(range(len(forests)))))).repartitionById(len(folds) * len(forests), number.cast("int"))
    _trees(rows.mapInArrow(run, TREE).collect(), model, forests)
    for fold in folds:
        for name, target in forests:
            model.trees.setdefault((fold, name, target), [])


def _fit_large(states: DataFrame, model: Forests, forests: list[tuple[str, str]], folds: list[int]) -> None:
    """Level by level, a pass for all folds and forests together."""
    n, spark = len(model.features), states.sparkSession
    plan = [(model.specs[name], model.columns(name), target) for name, target in forests]
    starts = {(fold, i): _start(model, fold, *f) for fold in folds for i, f in enumerate(forests)}
    width = len(forests)
    state = written(states.withColumn("raw", F.array_repeat(F.lit(0.0), width)), "state")
    recent: dict[tuple[int, int], list[Tree]] = {k: [] for k in starts}
    for r in range(max(spec.rounds for spec, _, _ in plan)):
        active = [k for k in starts if r < plan[k[1]][0].rounds]
        growing = {k: Growing(plan[k[1]][0]) for k in active}
        for _ in range(DEPTH):
            asked = [k for k in active if growing[k].open]
            found, roots = _level(state, spark, n, plan, starts, recent, {k: growing[k] for k in asked}, width) if asked else ({}, {})
            for k in active:
                growing[k].split(found.get(k, {}), roots.get(k))
        for k in active:
            recent[k].append(growing[k].tree)
            model.trees.setdefault((k[0], *forests[k[1]]), []).append(growing[k].tree)
        if (r + 1) % STATE_ROUNDS == 0:
            old, state = state, written(_advanced(state, spark, n, plan, recent, width), "state")
            removed(old)
            recent = {k: [] for k in starts}
    removed(state)


def _batch(batch: pa.RecordBatch, n: int, width: int) -> tuple:
    raw = batch.column(6).flatten().to_numpy().reshape(len(batch), width)
    return *(batch.column(i).to_numpy() for i in range(5)), unpacked(batch.column(5), n), raw


def _advanced(state: DataFrame, spark, n: int, plan: list, recent: dict, width: int) -> DataFrame:
    """state with the values of the recent trees added to raw."""
    shared = spark.sparkContext.broadcast(recent)

    def run(batches):
        for batch in batches:
            fold, *_, bins, raw = _batch(batch, n, width)
            raw = raw.copy()
            for (f, i), trees in shared.value.items():
                own = fold == f
                raw[own, i] += value(np.ascontiguousarray(bins[own].T)[plan[i][1]], trees)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.array(raw.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), lists], batch.schema.names)

    return state.mapInArrow(run, state.schema)


def _level(state: DataFrame, spark, n: int, plan: list, starts: dict, recent: dict, growing: dict, width: int) -> tuple[dict, dict]:
    """The best split of each open node by each input, and the root's sums of each forest."""
    shared = spark.sparkContext.broadcast((starts, recent, {k: (g.tree, g.depth, sorted(g.open)) for k, g in growing.items()}))

    def partial(batches):
        starts, recent, asked = shared.value
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            fold, rows, y, b, w, bins, raw = _batch(batch, n, width)
            last, every = None, bins.T
            for (f, i), (tree, depth, nodes) in sorted(asked.items(), key=lambda x: x[0]):
                if f != last:
                    own, last = np.flatnonzero(fold == f), f
                    inputs = np.ascontiguousarray(every[:, own])
                if not len(own):
                    continue
                spec, columns, target = plan[i]
                some = inputs[columns]
                base, logistic = starts[f, i]
                g, h = gradients(base + raw[own, i] + value(some, recent[f, i]), (y if target == COST else b)[own], w[own], logistic)
                sums = histograms(some, place(some, tree, depth), 1 << depth, g, h, rows[own])
                for node in nodes:
                    total[f, i, node] = total.get((f, i, node), 0) + sums[node]
        for (f, i, node), sums in total.items():
            m = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, v, np.int32)) for v in (f, i, node)] + [pa.array(np.arange(m, dtype=np.int32)), pa.array([s.tobytes() for s in sums], pa.binary())], ["fold", "forest", "node", "input", "sums"])

    def best(batches: Iterator[pa.RecordBatch]):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(key)
                total[key] = total.get(key, 0) + np.frombuffer(sums, np.float64).reshape(BINS + 1, 3)
        rows = []
        for key, sums in total.items():
            split = best_bin(sums, plan[key[1]][0])
            rows.append((*key, *((split[0], split[1], split[2].tolist()) if split else (None, None, None)), sums.sum(axis=0).tolist()))
        types = [pa.int32()] * 4 + [pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["fold", "forest", "node", "input", "gain", "bin", "left_sums", "all_sums"])

    parts = state.mapInArrow(partial, "fold int, forest int, node int, input int, sums binary")
    dealt = parts.repartition("fold", "forest", "node", "input")
    found: dict[tuple, dict] = {}
    roots: dict[tuple, dict] = {}
    rows = dealt.mapInArrow(best, "fold int, forest int, node int, input int, gain double, bin int, left_sums array<double>, all_sums array<double>").collect()
    for r in sorted(rows, key=lambda r: (r["fold"], r["forest"], r["node"], r["input"])):
        k = r["fold"], r["forest"]
        split = None if r["gain"] is None else (r["gain"], r["bin"], np.array(r["left_sums"]), np.array(r["all_sums"]))
        found.setdefault(k, {}).setdefault(r["node"], []).append((r["input"], split))
        roots.setdefault(k, {}).setdefault(r["node"], np.array(r["all_sums"]))
    return found, roots


def permutation_models(fitted: Forests, name: str, groups: dict[str, tuple[str, ...]], swapped: dict[str, int]) -> dict[str, Callable]:
    """Models over inputs followed by permuted inputs: `name` as it is ('' ), and with each group's columns exchanged.

    swapped: where the permuted values of a group's first column stand among the inputs; those of its others follow.
    """
    n = len(fitted.features)

    def scorer(group: str | None) -> Callable:
        def predict(x: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray]:
            z = x[:, :n].copy()
            if group is not None:
                for j, c in enumerate(groups[group]):
                    z[:, fitted.features.index(c)] = x[:, swapped[group] + j]
            return fitted.predict(z, fold, name)

        return predict

    return {"": scorer(None)} | {g: scorer(g) for g in groups}


__all__ = ["ALL", "Forests", "Spec", "fit_forests", "forest_models", "permutation_models", "single_tree"]
