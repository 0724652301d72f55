"""The panel of the models: a row a second meets in a market's windows, pairs are cumulated in spans, and errors take one pass over the scores."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotline.operators import features, folds, ledger, matching

START = 1_577_836_800


def buys(spark, n=240, seconds=97):
    rng = random.Random(n)
    rows = sorted((START + rng.randrange(seconds) * 3, f"t{i:04d}", rng.choice(["Up", "Down"]), Decimal(rng.randrange(1, 900)) / 100, Decimal(rng.randrange(30, 70)) / 100) for i in range(n))
    table = spark.createDataFrame([(m, *r) for m in ("m", "k") for r in rows], "market_id string, s bigint, source_trade_id string, outcome string, shares decimal(18,8), price decimal(12,8)")
    table = table.select("market_id", "source_trade_id", F.timestamp_seconds("s").alias("timestamp"), "outcome", F.lit("BUY").alias("side"), "shares", "price", F.lit(f"btc-updown-5m-{START}").alias("slug"), F.lit("x").alias("transaction_hash"))
    return ledger.buys_of_clean_markets(ledger.canonical_ledger(table)), rows


def lines(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_states_of_seconds(spark):
    table, rows = buys(spark)
    states = features.second_states(spark.createDataFrame(table.collect(), table.schema))
    grouped = [i for i, line in enumerate(lines(states)) if "Aggregate [market_id" in line]
    below = lines(states)[grouped[0] :] if grouped else lines(states)
    assert grouped and not [line for line in below if re.search(r"Window .*windowspecdefinition\(market_id#\d+, (seq|epoch)#\d+L? ASC", line)]
    got = {(r["market_id"], r["epoch"]): r for r in states.collect()}
    assert len(got) == 2 * len({r[0] for r in rows})
    for (_, t), r in got.items():
        held = {s: sum(x[3] for x in rows if x[0] <= t and x[2] == s) for s in ("Up", "Down")}
        assert (r["up_inventory"], r["down_inventory"], r["same_second_fill_count"]) == (held["Up"], held["Down"], sum(x[0] == t for x in rows))
        for s in (15, 30, 60):
            inside = [x for x in rows if t - s <= x[0] <= t]
            assert (r[f"fill_count_{s}s"], r[f"fill_qty_{s}s"]) == (len(inside), sum(x[3] for x in inside))
        assert r["side_switches_60s"] == sum(a[2] != b[2] for a, b in zip(inside, inside[1:]))
        for name, s in (("up", "Up"), ("down", "Down")):
            own = [x for x in rows if x[0] <= t and x[2] == s]
            assert r[f"seconds_since_last_{name}_fill"] == (t - own[-1][0] if own else None)
            assert r[f"cumulative_{name}_vwap"] == (pytest.approx(float(sum(x[3] * x[4] for x in own) / held[s])) if own else None)


def test_pairs_are_cumulated_in_spans(spark):
    table, _ = buys(spark)
    pairs = matching.fifo_pairs(table)
    panel = features.regime_panel(table, pairs=pairs)
    assert not [line for line in lines(panel) if re.search(r"windowspecdefinition\(market_id#\d+, formed_at_epoch", line)]
    got = {(r["market_id"], r["completing_seq"], r["event_index"]): r["cumulative_paired_quantity"] for r in panel.collect()}
    total = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["completing_seq"], r["event_index"])):
        total[r["market_id"]] = total.get(r["market_id"], 0) + r["paired_shares"]
        assert got.pop((r["market_id"], r["completing_seq"], r["event_index"])) == total[r["market_id"]]
    assert not got and panel.schema["cumulative_paired_quantity"].dataType.simpleString() == "decimal(28,8)"


def test_candles_by_the_fills_moments(spark):
    table, _ = buys(spark, 60)
    pairs = matching.fifo_pairs(table)
    candles = spark.createDataFrame([(START + 60 * i, Decimal(i + 1), Decimal(i + 3), Decimal(i + 1), Decimal(i + 2), 60) for i in range(-3, 6)], "open_epoch bigint, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), interval_seconds int")
    own, given = features.with_candles(pairs, candles), features.with_candles(pairs, candles, moments=table.select("epoch", "slug"))
    assert sorted(map(str, own.collect())) == sorted(map(str, given.collect())) and given.where("btc_reference_price IS NOT NULL").count() == pairs.count() > 0


def test_errors_take_one_pass_over_the_scores(spark):
    rows = spark.createDataFrame([(f"w{i % 2}", 1.0 * i, 1.0 + i % 3, i % 3 == 0, 1.0 + i) for i in range(30)], "window_id string, a double, pair_cost double, favorable boolean, paired_shares double")
    panel = folds.prepare(rows, ("a",))
    scores = folds.scored(panel, {"half": lambda x, _: (x[:, 0], 0.5 + 0 * x[:, 0])})
    assert sum("MapInArrow" in line for line in lines(folds.fold_metrics(scores))) == 1
    assert {r["window_id"]: (r["rows"], r["weighted_brier"]) for r in folds.fold_metrics(scores).collect()} == {"w0": (15, 0.25), "w1": (15, 0.25)}
    panel.close()


def test_counts_of_keys_agree():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 50, 1000)
    for bound in (50, 10**9):
        for some in (keys, keys[:0]):
            assert all(np.array_equal(a, b) for a, b in zip(folds._counted(some, bound), np.unique(some, return_counts=True), strict=True))
