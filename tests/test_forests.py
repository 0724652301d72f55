"""Histogram trees of all folds against plain recursive trees, inside tasks and by passes."""

import math

import numpy as np
import pytest

from lotline.operators import folds, forests
from tests.test_folds import FEATURES, imputed, matrix, panel_rows, table, usable

SPECS = {
    "tree": forests.single_tree(("a", "b"), least=10),
    "boosted": forests.Spec(FEATURES, rounds=4, rate=0.3, least=8),
    "few": forests.Spec(("b",), rounds=3, rate=0.5, least=5),
}


def rounded_rows(seed, windows=3, n=260):
    """Inputs with few distinct values, so that a fold's bins are its values."""
    return [(*r[:2], None if r[2] is None else round(r[2], 0), r[3], None if r[4] is None or math.isnan(r[4]) else round(r[4] - 1e6, 1), *r[5:]) for r in panel_rows(seed, n, windows)]


def plain_tree(x, g, h, spec, depth=0):
    """A function of a row: the value of its leaf. Candidates are all midpoints of all inputs; ties go to the first."""
    score = lambda at: g[at].sum() ** 2 / (h[at].sum() + spec.l2)
    every = np.ones(len(g), bool)
    best = (0.0, None)
    for j in range(x.shape[1]) if depth < 3 else ():
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= spec.least and min(h[left].sum(), h[~left].sum()) >= spec.curvature:
                gain = score(left) + score(~left) - score(every)
                if gain > best[0] * (1 + 1e-9) + 1e-9 * score(every):
                    best = (gain, (j, cut))
    if best[1] is None:
        leaf = -spec.rate * g.sum() / (h.sum() + spec.l2)
        return lambda row: leaf
    j, cut = best[1]
    left = x[:, j] <= cut
    low, high = plain_tree(x[left], g[left], h[left], spec, depth + 1), plain_tree(x[~left], g[~left], h[~left], spec, depth + 1)
    return lambda row: low(row) if row[j] <= cut else high(row)


def plain_forest(x, t, target, w, spec, logistic):
    mean = np.average(target, weights=w)
    raw, out = (np.full(len(v), math.log(mean / (1 - mean)) if logistic else mean) for v in (x, t))
    for _ in range(spec.rounds):
        if logistic:
            p = 1 / (1 + np.exp(-raw))
            g, h = (p - target) * w, p * (1 - p) * w
        else:
            g, h = (raw - target) * w, w
        tree = plain_tree(x, g, h, spec)
        raw, out = raw + np.array([tree(r) for r in x]), out + np.array([tree(r) for r in t])
    return 1 / (1 + np.exp(-out)) if logistic else out


def refit(rows, held, spec):
    train, test = [r for r in rows if r[1] != held], [r for r in rows if r[1] == held]
    x, t, _ = imputed(matrix(train), matrix(test))
    at = [FEATURES.index(c) for c in spec.inputs]
    y, b, w = (np.array([float(r[i]) for r in train]) for i in (6, 7, 8))
    cost, label = plain_forest(x[:, at], t[:, at], y, w, spec, False), plain_forest(x[:, at], t[:, at], b, w, spec, spec.logistic)
    return {r[0]: (c, p) for r, c, p in zip(test, cost, label, strict=True)}


@pytest.mark.parametrize("seed,local_rows", [(0, 10**6), (0, 0), (5, 175)])
def test_every_fold_equals_plain_trees(spark, monkeypatch, seed, local_rows):
    monkeypatch.setattr(forests, "STATE_ROUNDS", 2)
    rows = rounded_rows(seed)
    p = folds.prepare(table(spark, rows).repartition(3), FEATURES, keys=("id",))
    fitted = forests.fit_forests(p, SPECS, folds=[0, 1, 2], local_rows=local_rows)
    got = {(r["model"], r["id"]): r for r in folds.scored(p, forests.forest_models(fitted)).collect()}
    p.close()
    rows, splits = usable(rows), 0
    for name, spec in SPECS.items():
        for held in ("w0", "w1", "w2"):
            for key, (cost, probability) in refit(rows, held, spec).items():
                r = got[name, key]
                assert math.isclose(r["predicted"], cost, abs_tol=1e-9) and math.isclose(r["probability"], probability, abs_tol=1e-9), (name, held)
    for trees in fitted.trees.values():
        splits += sum((t.inputs >= 0).sum() for t in trees)
    assert splits > 50


@pytest.mark.parametrize("points", [4096, 1024])
def test_bins_of_many_values_hold_like_numbers_of_rows(spark, monkeypatch, points):
    monkeypatch.setattr(forests, "POINTS", points)
    rows = [(f"k{i}", f"w{i % 2}", math.sin(i) * 1000, None, None, None, 1.0, True, 1.0) for i in range(8000)]
    p = folds.prepare(table(spark, rows), FEATURES)
    fill = folds.fold_medians(p)
    edges = forests.fold_edges(p, fill)
    p.close()
    for fold in p.folds():
        x = np.array([r[2] for r in rows if r[1] != (p.windows[fold] if fold != folds.ALL else None)])
        counts = np.bincount(np.searchsorted(edges[fold][0], x, "left"))
        assert 240 < len(counts) <= forests.BINS and counts.max() < 2.2 * len(x) / forests.BINS
        assert len(edges[fold][1]) == 0  # an input that is never known has one bin


def test_forests_of_one_class_one_window_and_no_rows(spark):
    rows = [(f"k{i}", f"w{i % 2}", float(i), 1.0, None, None, 1.0 + i, i % 2 == 0, 1.0) for i in range(60)]
    for local_rows in (10**6, 0):
        for some in (rows, [r for r in rows if r[1] == "w0"], []):
            p = folds.prepare(table(spark, some), FEATURES, keys=("id",))
            fitted = forests.fit_forests(p, SPECS, local_rows=local_rows)
            got = folds.scored(p, forests.forest_models(fitted)).collect()
            p.close()
            assert len(got) == len(SPECS) * len(some)
            assert all(math.isfinite(r["predicted"]) and 0 <= r["probability"] <= 1 for r in got)


def test_rows_find_their_leaves_by_codes():
    """Inputs x rows: a way down node by node and the codes of all nodes agree, with nodes that don't split."""
    rng = np.random.default_rng(3)
    columns = rng.integers(0, 256, (5, 400)).astype(np.uint8)
    for _ in range(20):
        tree = forests.Tree(rng.integers(-1, 5, forests.NODES), rng.integers(0, 255, forests.NODES), rng.random(forests.LEAVES))
        for depth in range(forests.DEPTH + 1):
            at = np.zeros(400, int)
            for d in range(depth):
                node = at + (1 << d) - 1
                at = 2 * at + np.array([tree.inputs[k] >= 0 and columns[tree.inputs[k], i] > tree.bins[k] for i, k in enumerate(node)])
            assert (forests.place(columns, tree, depth) == at).all()
        assert (forests.value(columns, [tree, tree]) == 2 * tree.values[at]).all()


def test_rows_of_equal_bins_are_grown_as_one(spark, monkeypatch):
    """Forests over many rows of few states need no more than the states: each fold has 3000 rows and at most 120 states."""
    held = []
    for name in ("_fit_small", "_fit_large"):
        monkeypatch.setattr(forests, name, lambda states, *rest, f=getattr(forests, name): held.append(states.count()) or f(states, *rest))
    rng = np.random.default_rng(7)
    at = [(float(i % 3), i // 3 % 10, i // 30 % 12) for i in range(4500)]
    rows = [(f"k{i}", f"w{u:.0f}", float(a), float(b), None, None, 1 + 0.1 * a + rng.normal(), bool(rng.random() < 0.3 + 0.04 * b), float(rng.integers(1, 9)) / 4) for i, (u, a, b) in enumerate(at)]
    specs = {"boosted": forests.Spec(FEATURES, rounds=3, rate=0.3, least=40)}
    p = folds.prepare(table(spark, rows).repartition(3), FEATURES, keys=("id",))
    for local_rows in (200, 0):
        fitted = forests.fit_forests(p, specs, folds=[0, 1, 2], local_rows=local_rows)
        got = {r["id"]: r for r in folds.scored(p, forests.forest_models(fitted)).collect()}
        for held_out in ("w0", "w2"):
            for key, (cost, probability) in refit(rows, held_out, specs["boosted"]).items():
                assert math.isclose(got[key]["predicted"], cost, abs_tol=1e-9) and math.isclose(got[key]["probability"], probability, abs_tol=1e-9)
    p.close()
    assert len(held) == 2 and max(held) <= 3 * 120
