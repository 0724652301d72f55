"""Hand-computed scenarios of the ledger, inventory, matching and features."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators import features, inventory, ledger, matching, metrics

T0 = 1_600_000_200


def make_fills(spark, rows, market="m", slug=f"btc-updown-5m-{T0 // 300 * 300}", gap=1):
    """rows: (outcome, side, price, shares[, seconds])."""
    data = [(market, slug, f"t{i:03d}", o, s, Decimal(p), Decimal(q), T0 + (at[0] if at else i * gap), f"tx{i}") for i, (o, s, p, q, *at) in enumerate(rows)]
    df = spark.createDataFrame(data, "market_id string, slug string, source_trade_id string, outcome string, side string, price decimal(10,8), shares decimal(18,8), e bigint, transaction_hash string")
    return df.withColumn("timestamp", F.timestamp_seconds("e")).drop("e")


def led(spark, rows, **k):
    return ledger.canonical_ledger(make_fills(spark, rows, **k))


PAIR = [("UP", "BUY", "0.44", "100"), ("UP", "BUY", "0.42", "50"), ("DOWN", "BUY", "0.53", "80"), ("DOWN", "BUY", "0.51", "70")]


def test_weighted_pair(spark):
    row = inventory.pair_accounting(led(spark, PAIR)).first()
    assert row["weighted_pair_cost"] == pytest.approx(65 / 150 + 78.1 / 150, abs=1e-12)
    assert row["gross_edge"] == pytest.approx(0.046, abs=1e-12) and row["ending_paired"] == 150


def test_oversell_is_flagged_and_averages_reset(spark):
    rows = led(spark, [("UP", "BUY", "0.40", "10"), ("DOWN", "BUY", "0.60", "1"), ("UP", "SELL", "0.50", "12")])
    last = inventory.running_inventory(rows).orderBy(F.desc("seq")).first()
    assert last["up_net"] == -2 and last["paired_shares"] == 0
    assert last["anomaly"].startswith("sell_exceeds_long_inventory_by=2")
    cost = inventory.moving_average_costs(rows).orderBy(F.desc("seq")).first()
    assert cost["up_cost"] == 0 and cost["up_net"] == -2
    assert inventory.fifo_residual_costs(rows).where("oside = 'UP'").first()["cost"] is None


def test_buy_after_oversell_adds_its_full_cost(spark):
    rows = led(spark, [("UP", "BUY", "0.40", "10"), ("UP", "SELL", "0.5", "12"), ("UP", "BUY", "0.50", "4")])
    cost = inventory.moving_average_costs(rows).orderBy(F.desc("seq")).first()
    assert cost["up_net"] == 2 and cost["up_cost"] == pytest.approx(2.0)


def test_unwind_and_reform(spark):
    rows = led(spark, [("UP", "BUY", ".5", "100"), ("DOWN", "BUY", ".5", "100"), ("UP", "BUY", ".5", "50"), ("DOWN", "BUY", ".5", "50"), ("DOWN", "SELL", ".5", "100"), ("DOWN", "BUY", ".5", "100")])
    row = inventory.pair_flow(inventory.running_inventory(rows)).first()
    assert (row["formation_flow"], row["ending_paired"]) == (250, 150)


def test_exposure_at_the_end(spark):
    row = inventory.exposure(inventory.running_inventory(led(spark, [("UP", "BUY", ".5", "10"), ("DOWN", "BUY", ".5", "5")]))).first()
    assert (row["paired_end_ratio"], row["directional_end_ratio"]) == (0.5, 0.5)


def test_fifo_lifo_and_weighted_average(spark):
    rows = led(spark, [("UP", "BUY", ".20", "1"), ("UP", "BUY", ".60", "1"), ("DOWN", "BUY", ".50", "1"), ("UP", "BUY", ".01", "10")])
    assert [r["pair_cost"] for r in matching.fifo_pairs(rows).collect()] == [Decimal("0.70")]
    assert [r["pair_cost"] for r in matching.lifo_pairs(rows).collect()] == [Decimal("1.10")]
    assert [r["pair_cost"] for r in matching.lifo_pairs_by_levels(rows).collect()] == [Decimal("1.10")]
    events = matching.weighted_average_pairs(rows).collect()
    assert [round(r["pair_cost"], 12) for r in events] == [0.9]


def test_lifo_by_levels_equals_the_fold(spark):
    """Fills of few sizes, so that levels repeat and zero is often met; rounds of 3, 12 and all fills."""
    rng = random.Random(5)
    rows = led(spark, [(rng.choice(["UP", "DOWN"]), "BUY", f".{rng.randint(10, 90)}", str(rng.choice([1, 1, 2, 3, 5]))) for _ in range(150)])
    fold = sorted(map(tuple, matching.lifo_pairs(rows).collect()), key=str)
    for chunks in ((3, 12), (64, 4096), (1,)):
        assert sorted(map(tuple, matching.lifo_pairs_by_levels(rows, chunks).collect()), key=str) == fold and fold
    assert matching.lifo_pairs_by_levels(rows.where("false")).count() == 0


def test_fifo_fragments(spark):
    rows = led(spark, [("UP", "BUY", ".40", "10"), ("DOWN", "BUY", ".55", "4"), ("DOWN", "BUY", ".50", "6")])
    got = matching.fifo_pairs(rows)
    one = metrics.chronological_summary(got, rows).first()
    assert one["events"] == 2 and one["paired_shares"] == 10 and one["weighted_cost"] == pytest.approx(0.92)


def test_markets_with_a_sell_are_excluded(spark):
    rows = led(spark, [("UP", "BUY", ".40", "10"), ("DOWN", "BUY", ".55", "4"), ("UP", "SELL", ".5", "1")])
    assert ledger.buys_of_clean_markets(rows).count() == 0


def test_incomplete_history(spark):
    none = spark.createDataFrame([], "market_id string")
    row = ledger.classify_markets(make_fills(spark, PAIR), none).first()
    assert (row["eligible"], row["reason"]) == (False, "unresolved_history_completeness")
    odd = ledger.classify_markets(make_fills(spark, [("UP", "BUY", ".5", "1"), ("YES", "BUY", ".5", "1")])).first()
    assert odd["reason"] == "ambiguous_non_complementary_outcomes"
    one = ledger.classify_markets(make_fills(spark, [("UP", "BUY", ".5", "1")])).first()
    assert one["reason"] == "expected_2_outcomes_found_1"


def test_global_sequence_is_contiguous(spark):
    out = ledger.canonical_ledger(make_fills(spark, PAIR * 20), numbered=True).orderBy("timestamp", "source_trade_id").collect()
    assert [r["fill_sequence_number"] for r in out] == list(range(1, 81))


def test_global_sequence_over_many_ranges(spark):
    rows = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 7919 % 1000).alias("timestamp"), F.col("id").cast("string").alias("source_trade_id"))
    got = ledger.global_sequence(rows, ["timestamp", "source_trade_id"], partitions=16).collect()
    want = sorted(got, key=lambda r: (r["timestamp"], r["source_trade_id"]))
    assert [r["fill_sequence_number"] for r in want] == list(range(1, 5001))
    assert ledger.global_sequence(rows.where("false"), ["timestamp", "source_trade_id"]).count() == 0


def test_pre_event_state_is_strictly_before(spark):
    buys = led(spark, [("UP", "BUY", ".40", "5", 0), ("DOWN", "BUY", ".50", "5", 1)])
    row = features.pre_event_panel(buys, None, F.lit("w")).first()
    assert (row["up_inventory"], row["down_inventory"], row["fill_count_15s"], float(row["pair_cost"])) == (5, 0, 1, 0.9)
    assert row["max_prior_fill_sequence"] == 1 and row["prediction_fill_sequence"] == 2


def test_later_rows_change_nothing(spark):
    rows = [("UP", "BUY", ".40", "5", 0), ("DOWN", "BUY", ".50", "3", 0), ("DOWN", "BUY", ".52", "4", 7), ("UP", "BUY", ".3", "2", 20)]
    more = [*rows, ("DOWN", "BUY", ".1", "50", 40)]
    a = features.pre_event_panel(led(spark, rows), None, F.lit("w")).collect()
    b = features.pre_event_panel(led(spark, more), None, F.lit("w")).where(F.col("prediction_fill_sequence") <= 4).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    a = features.regime_panel(led(spark, rows)).collect()
    b = features.regime_panel(led(spark, more)).where(F.col("completing_seq") <= 4).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def candles(spark, rows):
    return spark.createDataFrame([(t, *(Decimal(x) for x in v), 60) for t, *v in rows], "open_epoch bigint, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), interval_seconds int")


def test_candles_are_seen_from_their_close_on(spark):
    c = candles(spark, [(960, "1", "1", "1", "1"), (1020, "1", "3", "1", "2"), (1080, "9", "9", "9", "9")])
    m = spark.createDataFrame([(1079, 1020), (1080, 1020), (900, None), (5000, 1020)], "event_epoch bigint, market_start bigint")
    got = {r["event_epoch"]: r for r in features.candle_features(m, c).collect()}
    assert got[1079]["btc_reference_epoch"] == 1020 and got[1080]["btc_reference_epoch"] == 1080
    assert got[1080]["btc_return_60s"] == 1.0 and got[1080]["btc_return_since_market_start"] == 1.0
    assert got[1080]["btc_range_since_market_start"] == 2.0 and got[1080]["btc_return_30s"] is None
    assert got[900]["btc_reference_price"] is None
    assert got[5000]["btc_reference_epoch"] == 1140 and got[5000]["btc_return_120s"] == 0.0


@pytest.mark.parametrize("lag,label", [(None, "0s"), (0, "0s"), (1, "1s"), (2, "2-5s"), (5, "2-5s"), (6, "6-15s"), (30, "16-30s"), (60, "31-60s"), (120, "61-120s"), (121, ">120s")])
def test_latency_labels(spark, lag, label):
    assert spark.range(1).select(S.latency_bucket(F.lit(lag).cast("bigint"))).first()[0] == label


def test_time_labels(spark):
    rows = spark.createDataFrame([(x,) for x in (-1, 0, 29, 30, 99, 100, 199, 200, 299, 300)], "e bigint")
    got = [tuple(r) for r in rows.select(S.market_time_bucket(F.col("e")), S.market_time_band(F.col("e"))).collect()]
    assert got == [(None, None), ("0-29", "early_0_99"), ("0-29", "early_0_99"), ("30-59", "early_0_99"), ("90-119", "early_0_99"), ("90-119", "middle_100_199"), ("180-209", "middle_100_199"), ("180-209", "late_200_299"), ("270-299", "late_200_299"), (None, None)]


def test_empty_buckets_are_emitted(spark):
    rows = metrics.latency_metrics(matching.fifo_pairs(led(spark, PAIR)).where("false")).collect()
    assert len(rows) == 8 and all(r["events"] == 0 and r["weighted_cost"] is None for r in rows)


def test_percentiles(spark):
    row = metrics.distribution(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double"), F.col("x")).first()
    assert (row["median"], row["p25"], row["p75"], row["p10"], row["p90"]) == (2.5, 2.0, 3.0, 1.0, 4.0)


def test_pooled_and_equal_mean(spark):
    rows = spark.createDataFrame([("a", 0, True, 500.0, 0.9), ("b", 1, True, 1500.0, 1.1)], "window_id string, start_epoch int, complete boolean, paired_shares double, weighted_pair_cost double")
    row = metrics.hypothesis_summary(rows).first()
    assert row["pooled"] == pytest.approx(1.05) and row["equal_mean"] == pytest.approx(1.0) and row["classification"] == "insufficient_data"
