"""One large market is shared among tasks: ledger, matching and binding in ranges of seconds and levels, with what is carried over their borders."""

import random
from collections import deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotline.operators import binding, ledger, matching, ranges


@pytest.fixture
def wide(spark):
    """Many partitions, none merged, no broadcast."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(kept, ("8", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def fills(spark, n=300):
    """n BUYs of one market in 300 seconds."""
    rng = random.Random(n)
    rows = [(f"t{i:04d}", 1_577_836_800 + rng.randrange(300), rng.choice(["Up", "Down"]), Decimal(rng.randrange(1, 900)) / 100, Decimal(rng.randrange(30, 70)) / 100) for i in range(n)]
    table = spark.createDataFrame(rows, "source_trade_id string, s bigint, outcome string, shares decimal(18,8), price decimal(12,8)")
    return table.select(F.lit("m").alias("market_id"), "source_trade_id", F.timestamp_seconds("s").alias("timestamp"), "outcome", F.lit("BUY").alias("side"), "shares", "price", F.lit("btc-updown-5m-1577836800").alias("slug"), F.lit("x").alias("transaction_hash")), rows


def tasks(df, column):
    return df.where(F.col(column).isNotNull()).select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("levels", [1, 50])
def test_ledger_and_fifo_over_borders(wide, monkeypatch, levels):
    monkeypatch.setattr(matching, "LEVELS", levels, raising=False)
    table, rows = fills(wide)
    led = ledger.canonical_ledger(table)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r["source_trade_id"]: r["seq"] for r in led.collect()} == {r[0]: i + 1 for i, r in enumerate(order)}
    pairs = matching.fifo_pairs(ledger.buys_of_clean_markets(led))
    want, queues = [], {"Up": deque(), "Down": deque()}
    for seq, (_, _, side, shares, _) in enumerate(order, 1):
        other = queues["Down" if side == "Up" else "Up"]
        while shares and other:
            q = min(shares, other[0][1])
            want.append((seq, other[0][0], q))
            shares, other[0][1] = shares - q, other[0][1] - q
            if not other[0][1]:
                other.popleft()
        if shares:
            queues[side].append([seq, shares])
    assert sorted((r["completing_seq"], r["lot_seq"], r["paired_shares"]) for r in pairs.collect()) == sorted(want)
    assert tasks(led, "seq") > 1 and tasks(pairs, "event_index") > 1


def test_a_sell_anywhere_in_a_market_counts(wide):
    table, _ = fills(wide, 40)
    sold = table.limit(1).withColumn("side", F.lit("SELL")).withColumn("timestamp", F.timestamp_seconds(F.lit(1_577_837_099))).withColumn("source_trade_id", F.lit("z"))
    assert ledger.buys_of_clean_markets(ledger.canonical_ledger(table.unionByName(sold))).count() == 0
    third = table.limit(1).withColumn("outcome", F.lit("Maybe")).withColumn("source_trade_id", F.lit("z"))
    assert {r[0] for r in ledger.canonical_ledger(table.unionByName(third)).select("market_exclusion_reason").distinct().collect()} == {"expected_2_outcomes_found_3"}


@pytest.mark.parametrize("seconds", [1, 7])
def test_binding_over_borders(wide, monkeypatch, seconds):
    monkeypatch.setattr(ranges, "SPAN", seconds, raising=False)
    rng = random.Random(seconds)
    made = [(f"p{i}", "M", rng.randrange(300_000), rng.randrange(300_000), True, i % 7 == 0) for i in range(60)]
    asked = [(f"q{i}", "m" if i % 50 else None, rng.randrange(300), rng.randrange(300_000)) for i in range(200)]
    got = binding.bind_strictly_prior(wide.createDataFrame(asked, "pair_id string, market_id string, formed_at_epoch bigint, sequence bigint"), wide.createDataFrame(made, "prediction_id string, market_id string, created_ms bigint, sequence bigint, candidate boolean, reconstructed boolean"))
    assert got.columns == ["pair_id", "market_id", "formed_at_epoch", "sequence", "prediction_id", "prediction_ms", "status"]
    want = {}
    for name, market, second, sequence in asked:
        fits = [(ms, s, p) for p, _, ms, s, _, gone in made if not gone and market and ms < second * 1000 and s < sequence]
        want[name] = max(fits)[2] if fits else None
    assert {r["pair_id"]: r["prediction_id"] for r in got.collect()} == want and got.count() == len(asked)
    assert tasks(got.where("sequence >= 0"), "status") > 1


def test_rounds_of_levels_are_dealt_apart(wide):
    """Last in first out by levels equals the fold, and neither the last round's rows nor its result lie in one task."""
    table, _ = fills(wide, 400)
    buys = ledger.buys_of_clean_markets(ledger.canonical_ledger(table))
    got, want = matching.lifo_pairs_by_levels(buys, (8, 64, 256)), matching.lifo_pairs(buys)
    names = ["completing_seq", "lot_seq", "event_index", "paired_shares", "pair_cost", "lag_seconds"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert got._jdf.queryExecution().toString().count("REPARTITION_BY_COL") >= 4 and tasks(got, "paired_shares") > 1
