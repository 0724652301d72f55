"""Models of all held-out windows at once against a plain refit of each fold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.operators import folds, metrics

SETS = {"one": ("a",), "two": ("b", "c"), "all": ("a", "b", "c", "d")}
FEATURES = ("a", "b", "c", "d")


def panel_rows(seed=0, n=400, windows=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(3, 2), rng.choice([0.0, -0.0, 1.0, 5.0, None]), rng.choice([None, float("nan"), 1e6 + rng.random()])
        cost = 1 + 0.05 * a - 0.02 * (b or 0) + rng.gauss(0, 0.1)
        rows.append((f"k{i}", f"w{rng.randrange(windows)}", a if rng.random() < 0.9 else None, b, c, None, cost, cost < 1.1, rng.uniform(0.1, 9)))
    rows += [("none", "w0", 1.0, 1.0, 1.0, None, None, True, 1.0), ("zero", "w1", 1.0, 1.0, 1.0, None, 1.0, True, 0.0), ("lost", None, 1.0, 1.0, 1.0, None, 1.0, False, 1.0)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, window_id string, a double, b double, c double, d double, pair_cost double, favorable boolean, paired_shares double")


def usable(rows):
    return [r for r in rows if r[1] is not None and r[6] is not None and r[8] > 0]


def matrix(rows):
    return np.array([[np.nan if v is None else v for v in r[2:6]] for r in rows], float).reshape(len(rows), 4)


def imputed(train, test):
    fill = []
    for j in range(4):
        known = train[~np.isnan(train[:, j]), j]
        fill.append(np.median(known) if len(known) else 0.0)
    return np.where(np.isnan(train), fill, train), np.where(np.isnan(test), fill, test), fill


def refit(rows, held, names):
    """Textbook ridge and logistic regression on the other windows' rows."""
    train, test = [r for r in rows if r[1] != held], [r for r in rows if r[1] == held]
    x, t, _ = imputed(matrix(train), matrix(test))
    at = [FEATURES.index(c) for c in names]
    x, t = x[:, at], t[:, at]
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread <= 1e-9 * np.maximum(1, np.abs(mean)), 1, spread)
    x, t = (x - mean) / spread, (t - mean) / spread
    y, b, w = (np.array([float(r[i]) for r in train]) for i in (6, 7, 8))
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    beta = np.linalg.solve(((x - xm) * w[:, None]).T @ (x - xm) + np.eye(len(at)), ((x - xm) * w[:, None]).T @ (y - ym))
    q, theta = np.column_stack((np.ones(len(x)), x)), np.zeros(len(at) + 1)
    penalty = np.diag([0.0] + [1.0] * len(at))
    for _ in range(60):
        p = 1 / (1 + np.exp(-q @ theta))
        theta = theta - np.linalg.solve((q * (w * p * (1 - p))[:, None]).T @ q + penalty, q.T @ (w * (p - b)) + penalty @ theta)
    return {r[0]: (a, c) for r, a, c in zip(test, (t - xm) @ beta + ym, 1 / (1 + np.exp(-np.column_stack((np.ones(len(t)), t)) @ theta)), strict=True)}


@pytest.mark.parametrize("seed,windows", [(0, 4), (1, 2)])
def test_every_fold_equals_a_refit(spark, seed, windows):
    rows = panel_rows(seed, windows=windows)
    p = folds.prepare(table(spark, rows).repartition(5), FEATURES, keys=("id",))
    fitted = folds.fit_linear(p, SETS)
    got = {(r["model"], r["id"]): r for r in folds.scored(p, folds.linear_models(fitted)).collect()}
    rows = usable(rows)
    assert len(got) == 3 * len(rows)
    for name, columns in SETS.items():
        for held in p.windows:
            for key, (cost, probability) in refit(rows, held, columns).items():
                r = got[name, key]
                assert r["window_id"] == held and math.isclose(r["predicted"], cost, abs_tol=1e-9) and math.isclose(r["probability"], probability, abs_tol=1e-8)
    p.close()


def test_medians_of_folds_are_exact(spark, monkeypatch):
    monkeypatch.setattr(folds, "RADIX", 7)
    rows = panel_rows(3, n=151, windows=5)
    p = folds.prepare(table(spark, rows), FEATURES)
    found = folds.fold_medians(p)
    x, w = matrix(usable(rows)), np.array([p.windows.index(r[1]) for r in usable(rows)])
    for fold, fill in found.items():
        assert np.array_equal(fill, imputed(x[w != fold], x[:1])[2])
    p.close()


def test_metrics_of_folds(spark):
    rows = panel_rows(2, n=120, windows=3)
    got = {(r["model"], r["window_id"]): r for r in folds.held_out_linear(table(spark, rows), SETS).collect()}
    rows = usable(rows)
    assert len(got) == 9
    for (name, held), r in got.items():
        own = [x for x in rows if x[1] == held]
        said = refit(rows, held, SETS[name])
        w = np.array([x[8] for x in own])
        e = np.array([said[x[0]][0] - x[6] for x in own])
        brier = np.array([(said[x[0]][1] - x[7]) ** 2 for x in own])
        assert r["rows"] == len(own) and math.isclose(r["weight"], w.sum())
        assert math.isclose(r["weighted_mae"], np.average(abs(e), weights=w), rel_tol=1e-8) and math.isclose(r["weighted_bias"], np.average(e, weights=w), abs_tol=1e-8) and math.isclose(r["weighted_brier"], np.average(brier, weights=w), rel_tol=1e-7)


def test_one_class_one_window_and_no_rows(spark):
    rows = [(f"k{i}", f"w{i % 2}", float(i), 1.0, None, None, 1.0 + i, i % 2 == 0, 1.0) for i in range(20)]
    for some in (rows, [r for r in rows if r[1] == "w0"], []):
        p = folds.prepare(table(spark, some), FEATURES, keys=("id",))
        got = folds.scored(p, folds.linear_models(folds.fit_linear(p, SETS))).collect()
        assert len(got) == 3 * len(some) and all(math.isfinite(r["predicted"]) and 0 <= r["probability"] <= 1 for r in got)
    constant = {r["id"]: r["probability"] for r in got}
    assert constant == {}


def test_a_model_has_no_wins_over_its_own_scores(spark):
    """Scores may differ in their last bits each time that they are computed, as sums of doubles arrive in another order."""
    noise = F.udf(lambda: random.SystemRandom().random() * 1e-16, "double").asNondeterministic()
    rows = spark.createDataFrame([(m, f"w{i}", e) for i in range(40) for m, e in (("base", 0.125), ("better", 0.0625))] + [("base", None, 0.125)], "model string, window_id string, mae double")
    got = {r["model"]: r for r in metrics.fold_summary(rows.withColumn("mae", F.col("mae") + noise()), ["mae"], "base").collect()}
    assert (got["base"]["folds"], got["base"]["delta_mae"], got["base"]["wins_mae"]) == (41, 0.0, 0)
    assert (got["better"]["folds"], got["better"]["wins_mae"]) == (40, 40) and abs(got["better"]["delta_mae"] + 0.0625) < 1e-12
