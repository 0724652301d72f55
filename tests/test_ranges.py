"""Looking back over the borders of ranges, and the log checks that do."""

import random

import pytest
from pyspark.sql import functions as F

from lotline.operators import live, ranges
from lotline.plans import live as live_plans
from lotline.plans import queries
from lotline.sources import eventlog


@pytest.mark.parametrize("size", [1, 7, 1 << 17])
def test_previous_rows_over_borders(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), i * 3, rng.choice([None, i]), rng.random() < 0.1) for i in range(200)]
    table = spark.createDataFrame(rows, "g string, line bigint, x bigint, odd boolean").repartition(4)
    got = ranges.with_previous(table, "g", "line", {"before": (F.col("x"), F.lit(True)), "marked": (F.col("x") * 2, F.col("odd")), "never": (F.col("x"), F.lit(None).cast("boolean"))}, size)
    assert got.columns == ["g", "line", "x", "odd", "before", "marked", "never"]
    for r in got.collect():
        own = [x for x in rows if x[0] == r["g"] and x[1] < r["line"]]
        last = own[-1][2] if own else None
        odd = [x[2] for x in own if x[3]]
        assert (r["before"], r["marked"], r["never"]) == (last, odd[-1] * 2 if odd and odd[-1] is not None else None, None)
    assert got.count() == len(rows)


@pytest.mark.parametrize("size", [1, 7, 1 << 17])
def test_numbers_over_borders(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), i * 3) for i in range(200)] + [("a", None)]
    got = ranges.numbered(spark.createDataFrame(rows, "g string, line bigint").repartition(4), "g", "line", "n", size)
    assert got.columns == ["g", "line", "n"] and got.count() == len(rows)
    for r in got.collect():
        assert r["n"] == 1 + sum(x[0] == r["g"] and (-1 if x[1] is None else x[1]) < (-1 if r["line"] is None else r["line"]) for x in rows)


@pytest.mark.parametrize("make", [queries._log, live_plans._monitored])
def test_a_long_run_is_numbered_by_many_tasks(spark, monkeypatch, make):
    """No task sorts a whole run: with small ranges the rows of the three runs lie in more than three partitions."""
    monkeypatch.setattr(ranges, "RANGE", 1000)
    log = make(spark, "/root/testdata/sf0.01")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        assert log.select("sequence", F.spark_partition_id().alias("p")).where("sequence >= 0").select("p").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def lines(spark, n):
    """A run with gaps, wrong ids and lines that are no records."""
    row = F.col("id")
    dead = row % 101 == 50
    sequence = F.when(~dead, row + F.floor(row / 97))
    table = spark.range(n).select(F.lit("run").alias("run_id"), row.alias("line"), sequence.alias("sequence"), F.concat_ws(":", F.lit("run"), F.when(row % 89 == 3, F.lit("x")).otherwise(sequence.cast("string"))).alias("event_id"), F.when(~dead, row * 500 + F.when(row > n - 50, 20_000).otherwise(0)).alias("created_ms"))
    more = {"event_type": F.when(row == 0, "evaluation_run_start").otherwise("source_health"), "frozen": F.lit(True), "source": F.lit("target"), "status": F.lit("poll_ok"), "partial": F.lit(False)}
    return table.withColumns({k: v for k, v in more.items() if k != "event_type"}).withColumn("event_type", F.when(F.col("line") == 0, "evaluation_run_start").otherwise("source_health"))


def test_checks_of_one_long_run_are_the_same_in_ranges(spark, monkeypatch):
    log, n = lines(spark, 3000), 3000
    results = []
    for size in (1 << 17, 64, 1):
        monkeypatch.setattr(ranges, "RANGE", size)
        bad = sorted(map(str, eventlog.integrity(log).collect()))
        results.append((bad, eventlog.monitor(log, n * 500 + 20_000).collect(), live.operational_monitor(log, n * 500 + 20_000).collect()))
    assert results[0] == results[1] == results[2]
    dead = {i for i in range(n) if i % 101 == 50}
    assert results[0][2][0]["malformed"] == len(dead) and results[0][2][0]["largest_gap_ms"] >= 20_000 and len(results[0][0]) > len(dead)


def test_ranges_share_one_run_among_tasks(spark):
    rows = ranges.with_previous(spark.range(40_000).selectExpr("'r' AS g", "id AS line"), "g", "line", {"p": (F.col("line"), F.lit(True))}, 1000)
    sizes = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 40_000
