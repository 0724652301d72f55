"""Linear models of all held-out windows at once.

A fold trains on every window but one; fold ALL trains on all. Nothing is refitted by filtering the table for each fold:
medians are found by radix selection on counts a window, ridge regressions are solved from weighted moments a window, a
fold's being the total minus its own, and logistic regressions take Newton steps whose gradients and Hessians are summed
for all folds and feature sets in one pass. Only counts, moments and Hessians reach the driver; their
size depends on the numbers of windows and features, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.operators.metrics import classification_measures, regression_measures
from lotline.sources.scratch import removed, written

#: The fold that holds nothing out.
ALL = -1
#: Bits of a double's order that a pass of the selection settles.
RADIX = 11
#: Rows whose values are counted together by a pass of the selection.
COUNTED = 1 << 17
#: Penalties of the ridge and the logistic regression on standardised inputs.
ALPHA, C = 1.0, 1.0
#: A logistic fit has ended when no coefficient moves by more, or after so many passes.
TOLERANCE, MAX_STEPS = 1e-9, 60


@dataclass
class Panel:
    """Rows as (window, y, b, w, x): number of the window, cost, favourable (0/1), weight and inputs (NaN: unknown; the bytes of their doubles, as
    every pass over the rows reads them), and key columns."""

    rows: DataFrame
    windows: list[str]
    features: tuple[str, ...]
    keys: tuple[str, ...] = ()

    def folds(self) -> list[int]:
        return [*range(len(self.windows)), ALL]

    def close(self) -> None:
        removed(self.rows)


def prepare(panel: DataFrame, features: tuple[str, ...], keys: tuple[str, ...] = (), windows: list[str] | None = None) -> Panel:
    """Writes the columns that models read, once. Rows without window, cost, label or a positive weight can't be fitted or scored and are left out.

    windows: their order, where it must agree with another panel's; windows are few by nature, their names are collected.
    """
    ok = F.col("window_id").isNotNull() & F.col("pair_cost").isNotNull() & F.col("favorable").isNotNull() & (F.col("paired_shares") > 0)
    value: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    rows = panel.where(ok).select(*[F.col(k).alias(f"key_{k}") for k in keys], "window_id", F.col("pair_cost").cast("double").alias("y"), F.col("favorable").cast("int").cast("double").alias("b"), F.col("paired_shares").cast("double").alias("w"), *[value(c).alias(f"x{i}") for i, c in enumerate(features)])
    kept = rows.columns[: len(rows.columns) - len(features)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)])
    rows = written(rows.mapInArrow(lambda batches: _packed(batches, len(kept)), f"{schema}, x binary"), "panel")
    names = windows or [r[0] for r in rows.select("window_id").distinct().orderBy("window_id").collect()]
    number = F.array_position(F.lit(names) if names else F.array(F.lit("")), F.col("window_id")).cast("int") - 1
    return Panel(rows.withColumn("window", number).drop("window_id"), names, tuple(features), tuple(keys))


def _packed(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[pa.RecordBatch]:
    """The first columns of each batch and the bytes of its other ones, doubles, row by row."""
    for batch in batches:
        n = batch.num_columns - kept
        x = np.empty((len(batch), n))
        for i in range(n):
            x[:, i] = batch.column(kept + i).to_numpy(zero_copy_only=False)
        ends = np.arange(len(batch) + 1, dtype=np.int32) * np.int32(8 * n)
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(x)])], [*batch.schema.names[:kept], "x"])


def arrays(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """window, y, b, w and the rows x n inputs of a batch of (window, y, b, w, x)."""
    packed = batch.column(4)
    if len(batch) and n:
        _, ends, data = packed.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(packed.type) else np.int32)
        x = np.frombuffer(data, np.float64, len(batch) * n, int(ends[packed.offset])).reshape(len(batch), n)
    else:
        x = np.empty((len(batch), n))
    return *(batch.column(i).to_numpy() for i in range(4)), x


def _sums(parts: Iterator[tuple[tuple, np.ndarray]], keys: int) -> Iterator[pa.RecordBatch]:
    """(keys..., pos, value) of every value of each array that isn't 0."""
    for key, values in parts:
        some = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(some), k, np.int32)) for k in key), pa.array(some.astype(np.int32)), pa.array(values[some].astype(np.float64))], [*(f"k{i}" for i in range(keys)), "pos", "value"])


def added(data: DataFrame, run: Callable, shape: Callable[[tuple], int], keys: int) -> dict[tuple, np.ndarray]:
    """Arrays by key, summed over what run() gives for each task."""
    schema = ", ".join(f"k{i} int" for i in range(keys)) + ", pos int, value double"
    names = [f"k{i}" for i in range(keys)]
    out: dict[tuple, np.ndarray] = {}
    for *key, pos, value in data.mapInArrow(lambda batches: _sums(run(batches), keys), schema).groupBy(*names, "pos").agg(F.sum("value")).collect():
        key = tuple(key)
        if key not in out:
            out[key] = np.zeros(shape(key))
        out[key][pos] = value
    return out


# ---------------------------------------------------------------- medians


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0 counts as 0."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def from_bits(u: int) -> float:
    return float(np.array([u ^ (1 << 63) if u >> 63 else u ^ ((1 << 64) - 1)], np.uint64).view(np.float64)[0])


def chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """window, y, b, w and inputs of COUNTED rows or so at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(arrays(batch, n))
        size += len(batch)
        if size >= COUNTED:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _counted(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below the bound in order, and how often each occurs."""
    if bound > 4 * COUNTED:
        return np.unique(keys, return_counts=True)
    counts = np.bincount(keys, minlength=1)
    some = np.flatnonzero(counts)
    return some, counts[some]


def fold_medians(panel: Panel) -> dict[int, np.ndarray]:
    """The interpolated median of each input over each fold's training rows that know it; 0 where none does.

    A pass settles the next RADIX bits of both middle values of every fold and input from counts by window; a pass returns at most
    2 ** RADIX counts for each window, input and prefix in question, whatever the number of rows.
    """
    n, w = len(panel.features), len(panel.windows)
    data = panel.rows.select("window", "y", "b", "w", "x")
    targets: dict[tuple, list[int]] = {}  # (fold, input, side): prefix, rank that is left
    left = 64
    while left:
        bits = min(RADIX, left)
        left -= bits
        active = [np.array(sorted({t[0] for k, t in targets.items() if k[1] == f}), np.uint64) for f in range(n)] if targets else [np.zeros(1, np.uint64)] * n
        first = not targets

        def run(batches, bits=bits, left=left, active=active, first=first):
            for window, _, _, _, x in chunks(batches, n):
                for f in range(n):
                    known = ~np.isnan(x[:, f])
                    u, own = ordered_bits(x[known, f]), window[known].astype(np.int64)
                    if first:
                        at = np.zeros(len(u), np.int64)
                    else:
                        prefix = u >> np.uint64(left + bits)
                        at = np.minimum(np.searchsorted(active[f], prefix), len(active[f]) - 1)
                        hit = active[f][at] == prefix if len(active[f]) else np.zeros(len(u), bool)
                        u, own, at = u[hit], own[hit], at[hit]
                    digit = ((u >> np.uint64(left)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    keys, counts = _counted((at * w + own << bits) | digit, max(1, len(active[f])) * w << bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), f, np.int32)), pa.array((keys >> bits) // w), pa.array(((keys >> bits) % w).astype(np.int32)), pa.array((keys & ((1 << bits) - 1)).astype(np.int32)), pa.array(counts)], ["f", "at", "window", "digit", "n"])

        counts: dict[tuple[int, int], np.ndarray] = {}
        for f, at, window, digit, c in data.mapInArrow(run, "f int, at bigint, window int, digit int, n bigint").groupBy("f", "at", "window", "digit").agg(F.sum("n")).collect():
            counts.setdefault((f, at), np.zeros((w, 1 << bits), np.int64))[window, digit] = c
        if first:
            for fold in panel.folds():
                for f in range(n):
                    c = counts.get((f, 0), np.zeros((w, 1), np.int64))
                    known = int(c.sum() - (c[fold].sum() if fold != ALL else 0))
                    if known:
                        targets[fold, f, 0], targets[fold, f, 1] = [0, (known - 1) // 2], [0, known // 2]
        for (fold, f, _), t in targets.items():
            c = counts[f, 0 if first else int(np.searchsorted(active[f], np.uint64(t[0])))]
            below = np.cumsum(c.sum(axis=0) - (c[fold] if fold != ALL else 0))
            digit = int(np.searchsorted(below, t[1], "right"))
            t[1] -= int(below[digit - 1]) if digit else 0
            t[0] = t[0] << bits | digit
    middle = lambda fold, f: sum(from_bits(targets[fold, f, s][0]) for s in (0, 1)) / 2 if (fold, f, 0) in targets else 0.0
    return {fold: np.array([middle(fold, f) for f in range(n)]) for fold in panel.folds()}


# ---------------------------------------------------------------- ridge and logistic regression


@dataclass
class LinearFolds:
    """Coefficients of each fold and feature set on the imputed inputs, intercept first; `cost` and `logit` by (fold, set)."""

    features: tuple[str, ...]
    sets: dict[str, tuple[str, ...]]
    fill: dict[int, np.ndarray]
    cost: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)
    logit: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)

    def columns(self, name: str) -> list[int]:
        return [self.features.index(c) for c in self.sets[name]]

    def predict(self, x: np.ndarray, fold: int, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Cost and probability of a favourable pair for rows of inputs (NaN: unknown)."""
        z = np.where(np.isnan(x), self.fill[fold], x)[:, self.columns(name)]
        a, b = self.cost[fold, name], self.logit[fold, name]
        return z @ a[1:] + a[0], 1 / (1 + np.exp(-np.clip(z @ b[1:] + b[0], -700, 700)))


def window_moments(panel: Panel, centre: np.ndarray) -> dict[tuple[int], np.ndarray]:
    """By window: the weighted products of (1, known inputs, unknown flags, y, b), then n, sums and squares of the known inputs and counts of the unknown.

    Inputs are taken from `centre`, unknown ones as 0, so the moments after imputing any value follow without another pass.
    """
    n = len(panel.features)
    size = 2 * n + 3

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            window, y, b, w, x = arrays(batch, n)
            unknown = np.isnan(x)
            known = np.where(unknown, 0.0, x - centre)
            z = np.column_stack((np.ones(len(y)), known, unknown, y, b))
            for i in np.unique(window).tolist():
                own = window == i
                products = (z[own] * w[own, None]).T @ z[own]
                plain = np.concatenate(([own.sum()], known[own].sum(axis=0), (known[own] ** 2).sum(axis=0), unknown[own].sum(axis=0)))
                total[i] = total.get(i, 0) + np.concatenate((products.ravel(), plain))
        yield from (((i,), t) for i, t in total.items())

    return added(panel.rows.select("window", "y", "b", "w", "x"), run, lambda _: size * size + 3 * n + 1, 1)


def _scales(plain: np.ndarray, fill: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unweighted means and deviations of the inputs after imputing (from the centre); a constant input has deviation 1."""
    rows, sums, squares, unknown = plain[0], plain[1 : n + 1], plain[n + 1 : 2 * n + 1], plain[2 * n + 1 :]
    mean = (sums + fill * unknown) / max(1.0, rows)
    square = (squares + fill**2 * unknown) / max(1.0, rows)
    spread = square - mean**2
    return mean, np.sqrt(np.where(spread <= 1e-13 * np.maximum(square, 1e-300), 1.0, spread))


def fit_linear(panel: Panel, sets: dict[str, tuple[str, ...]], alpha: float = ALPHA, c: float = C) -> LinearFolds:
    """Ridge of the cost and logistic regression of the label, weighted, on median-imputed and standardised inputs, for every fold and set.

    A fold whose training rows hold one class only has the probability 0 or 1 (a logit of 700 either way); a fold without training rows has a cost of 0 and a probability of 0.5.
    """
    n = len(panel.features)
    out = LinearFolds(panel.features, dict(sets), fold_medians(panel))
    centre = out.fill[ALL]
    moments = window_moments(panel, centre)
    size = 2 * n + 3
    every = sum(moments.values(), np.zeros(size * size + 3 * n + 1))
    scale: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    todo: dict[tuple[int, str], dict] = {}
    for fold in panel.folds():
        m = every - moments.get((fold,), 0 * every)
        fill = out.fill[fold] - centre
        mean, spread = _scales(m[size * size :], fill, n)
        scale[fold] = fill, mean, spread
        change = np.zeros((n + 3, size))  # (1, imputed and standardised inputs, y, b) from the products' columns
        change[0, 0] = change[n + 1, size - 2] = change[n + 2, size - 1] = 1
        for j in range(n):
            change[j + 1, 0], change[j + 1, j + 1], change[j + 1, n + j + 1] = -mean[j] / spread[j], 1 / spread[j], fill[j] / spread[j]
        g = change @ m[: size * size].reshape(size, size) @ change.T
        weight, label = g[0, 0], g[0, n + 2]
        for name in sets:
            at = np.array([0, *(j + 1 for j in out.columns(name))])
            k = len(at)
            if weight <= 1e-9 * every[0]:
                out.cost[fold, name] = out.logit[fold, name] = np.zeros(k)
                continue
            centred = g[np.ix_(at[1:], at[1:])] - np.outer(g[0, at[1:]], g[0, at[1:]]) / weight
            beta = np.linalg.solve(centred + alpha * np.eye(k - 1), g[at[1:], n + 1] - g[0, at[1:]] * g[0, n + 1] / weight)
            out.cost[fold, name] = unscaled(np.concatenate(([(g[0, n + 1] - beta @ g[0, at[1:]]) / weight], beta)), at[1:] - 1, centre, mean, spread)
            if min(label, weight - label) <= 1e-12 * weight:
                out.logit[fold, name] = np.concatenate(([700.0 if label > weight / 2 else -700.0], np.zeros(k - 1)))
            else:
                todo[fold, name] = {"beta": np.concatenate(([math.log(label / (weight - label))], np.zeros(k - 1))), "step": np.zeros(k), "loss": math.inf}
    newton(panel, out, todo, scale, centre, c)
    for (fold, name), t in todo.items():
        out.logit[fold, name] = unscaled(t["beta"], np.array(out.columns(name), int), centre, *scale[fold][1:])
    return out


def unscaled(beta: np.ndarray, columns: np.ndarray, centre: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Coefficients for inputs as they are, from those for standardised ones; intercept first."""
    slope = beta[1:] / spread[columns]
    return np.concatenate(([beta[0] - slope @ (centre + mean)[columns]], slope))


def newton(panel: Panel, model: LinearFolds, todo: dict[tuple[int, str], dict], scale: dict, centre: np.ndarray, c: float) -> None:
    """Minimises c x weighted log loss + half the squared slopes for each (fold, set) of todo; a pass serves all that haven't ended."""
    n = len(panel.features)
    names = list(model.sets)
    columns = {name: model.columns(name) for name in names}
    at = [np.array([0, *(j + 1 for j in columns[name])]) for name in names]
    data = panel.rows.select("window", "y", "b", "w", "x")
    open_ = set(todo)
    for _ in range(MAX_STEPS):
        if not open_:
            return
        asked: dict[int, list[tuple[int, np.ndarray]]] = {}
        for fold, name in sorted(open_):
            beta = np.zeros(n + 1)
            beta[at[names.index(name)]] = todo[fold, name]["beta"]
            asked.setdefault(fold, []).append((names.index(name), beta))

        def run(batches, asked=asked):
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                window, _, b, w, x = arrays(batch, n)
                x = (x - centre).T.copy()
                unknown = np.isnan(x)
                for fold, fits in asked.items():
                    fill, mean, spread = (c[:, None] for c in scale[fold])
                    use = window != fold
                    if not use.any():
                        continue
                    own, label, weight = (x, b, w) if use.all() else (x[:, use], b[use], w[use])
                    z = np.ones((n + 1, len(label)))
                    z[1:] = (np.where(unknown if use.all() else unknown[:, use], fill, own) - mean) / spread
                    margin = np.array([beta for _, beta in fits]) @ z  # a row a set: inputs that aren't in it have the coefficient 0
                    small = np.exp(-np.abs(margin))
                    p = np.where(margin >= 0, 1.0, small) / (1 + small)
                    loss = (np.maximum(margin, 0) + np.log(1 + small) - label * margin) @ weight
                    gradient, curve = (weight * (p - label)) @ z.T, weight * p * (1 - p)
                    for j, (s, _) in enumerate(fits):
                        q = z[at[s]]
                        part = np.concatenate(([loss[j]], gradient[j, at[s]], ((q * curve[j]) @ q.T).ravel()))
                        total[fold, s] = total.get((fold, s), 0) + part
            yield from total.items()

        size = lambda key: (k := len(columns[names[key[1]]]) + 1) * (k + 1) + 1
        for (fold, s), v in added(data, run, size, 2).items():
            t, k = todo[fold, names[s]], len(columns[names[s]]) + 1
            slopes = np.concatenate(([0.0], t["beta"][1:]))
            loss, gradient = c * v[0] + slopes @ slopes / 2, c * v[1 : k + 1] + slopes
            if loss > t["loss"] + 1e-12 * abs(t["loss"]):  # too long a step: half of it
                t["step"] = t["step"] / 2
                t["beta"] = t["beta"] - t["step"]
            else:
                hessian = c * v[k + 1 :].reshape(k, k) + np.diag([0.0] + [1.0] * (k - 1))
                t["loss"], t["step"] = loss, -np.linalg.solve(hessian, gradient)
                t["beta"] = t["beta"] + t["step"]
            if np.abs(t["step"]).max() <= TOLERANCE:
                open_.discard((fold, names[s]))


# ---------------------------------------------------------------- scores


SCORED = "window_id string, model string, pair_cost double, favorable double, paired_shares double, predicted double, probability double"


def scored(panel: Panel, models: dict[str, Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]], fold: int | None = None) -> DataFrame:
    """(key columns, window_id, model, pair_cost, favorable, paired_shares, predicted, probability): each row by each model of the fold that holds its
    window out, or of `fold`. models: functions of (inputs, fold)."""
    n, names, keys = len(panel.features), panel.windows, [f"key_{k}" for k in panel.keys]
    rows = panel.rows.select("window", "y", "b", "w", "x", *keys)
    fields = [*panel.keys, *(f.split()[0] for f in SCORED.split(", "))]
    schema = ", ".join([*(f"`{k}` {panel.rows.schema[f'key_{k}'].dataType.simpleString()}" for k in panel.keys), SCORED])

    def run(batches):
        for batch in batches:
            window, y, b, w, x = arrays(batch, n)
            for i in np.unique(window).tolist():
                own = np.flatnonzero(window == i)
                kept = batch.take(pa.array(own))
                for name, predict in models.items():
                    cost, probability = predict(x[own], i if fold is None else fold)
                    text = lambda s: pa.repeat(pa.scalar(s, pa.string()), len(own))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([*(kept.column(5 + j) for j in range(len(keys))), text(names[i]), text(name), pa.array(y[own]), pa.array(b[own]), pa.array(w[own]), pa.array(cost), pa.array(probability)], fields)

    return rows.mapInArrow(run, schema)


def fold_metrics(rows: DataFrame, by: tuple[str, ...] = ("model", "window_id")) -> DataFrame:
    """A row of errors for each model and window: rows, weight, weighted_mae, mae, weighted_bias, weighted_brier, weighted_log_loss."""
    return rows.groupBy(*by).agg(*regression_measures(), *classification_measures(), F.sum("paired_shares").alias("weight"))


def held_out_linear(panel: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """Errors of every feature set on every window by models of the other windows."""
    features = tuple(dict.fromkeys(c for s in sets.values() for c in s))
    p = prepare(panel, features)
    fitted = fit_linear(p, sets)
    out = written(fold_metrics(scored(p, linear_models(fitted))), "metrics")
    p.close()
    return out


def linear_models(fitted: LinearFolds) -> dict[str, Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]]:
    return {name: (lambda x, fold, name=name: fitted.predict(x, fold, name)) for name in fitted.sets}
