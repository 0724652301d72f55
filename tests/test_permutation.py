"""Permutation of model inputs against a plain refit and a plain exchange."""

import hashlib
import math

import numpy as np

from lotline.operators import forests, permutation
from tests.test_folds import FEATURES, table, usable
from tests.test_forests import refit, rounded_rows

SPEC = forests.Spec(("a", "b", "c"), rounds=3, rate=0.5, least=8)
GROUPS = {"a": ("a",), "both": ("b", "c")}


def exchanged(rows, windows):
    """window -> group -> {row: row whose values it gets}."""
    out = {}
    for n, held in enumerate(windows):
        own = sorted(r[0] for r in rows if r[1] == held)
        for i, group in enumerate(GROUPS):
            other = sorted(own, key=lambda k: (hashlib.md5(f"{1000 + 100 * n + i}:{k}".encode()).hexdigest(), k))
            out[held, group] = dict(zip(own, other, strict=True))
    return out


def errors(rows, held, said):
    own = [r for r in rows if r[1] == held]
    w = np.array([r[8] for r in own])
    return np.average([abs(said[r[0]][0] - r[6]) for r in own], weights=w), np.average([(min(1 - 1e-12, max(1e-12, said[r[0]][1])) - r[7]) ** 2 for r in own], weights=w)


def test_deltas_equal_a_refit_on_exchanged_rows(spark):
    rows = [r for r in rounded_rows(4) if r[1] is None or r in usable([r])]
    got = {(r["window_id"], r["permutation"]): r for r in permutation.held_out_permutations(table(spark, rows).repartition(4), SPEC, GROUPS, ["id"]).collect()}
    rows = usable(rows)
    windows = ["w0", "w1", "w2"]
    assert set(got) == {(w, g) for w in windows for g in GROUPS}
    by_id, moved = {r[0]: r for r in rows}, exchanged(rows, windows)
    for held in windows:
        plain = errors(rows, held, refit(rows, held, SPEC))
        for group, columns in GROUPS.items():
            at = [2 + FEATURES.index(c) for c in columns]
            swapped = [tuple(by_id[moved[held, group][r[0]]][j] if j in at else v for j, v in enumerate(r)) if r[1] == held else r for r in rows]
            mae, brier = errors(rows, held, refit(swapped, held, SPEC))
            assert math.isclose(got[held, group]["weighted_mae_delta"], mae - plain[0], abs_tol=1e-9)
            assert math.isclose(got[held, group]["weighted_brier_delta"], brier - plain[1], abs_tol=1e-9)
    assert max(abs(r["weighted_mae_delta"]) for r in got.values()) > 1e-3


def test_ranks_of_a_window_over_many_ranges(spark):
    rows = spark.range(3000).selectExpr("id % 1000 AS k", "IF(id % 3 = 0, 'x', IF(id % 3 = 1, 'y', NULL)) AS g", "id").repartition(7)
    got = permutation.ranked(rows, "g", [rows["k"].desc(), rows["id"]], "place").collect()
    for g in ("x", "y", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["k"], r["id"]))
        assert [r["place"] for r in own] == list(range(1, 1001))


def test_no_rows(spark):
    assert permutation.held_out_permutations(table(spark, []), SPEC, GROUPS, ["id"]).count() == 0


def test_ranks_by_hash_equal_those_over_sorted_ranges_and_a_panel_is_read_once(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 'x', 'y') AS g", "id", "md5(CAST(id % 700 AS STRING)) AS h").repartition(7)
    got = permutation.ranked_by_hash(rows, "g", "h", [rows["id"]], "place").collect()
    for g in ("x", "y"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["h"], r["id"]))
        assert [r["place"] for r in own] == list(range(1, 1001 if g == "x" else 2001))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    panel = table(spark, usable(rounded_rows(4)))
    n = panel.count()
    permutation.held_out_permutations(panel.mapInArrow(counted, panel.schema), SPEC, GROUPS, ["id"]).collect()
    assert reads.value == n  # not once more for the fit and for every group
