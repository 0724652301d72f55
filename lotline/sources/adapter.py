"""Fills, candles and windows out of the driver's `events` table.

The clock is compressed by 288, so that each UTC day becomes one market of 300 seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.schemas import PRICE, SHARES


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("__s", micros / 1e6)
    return rows.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor(F.col("__s") / 288).alias("epoch"), F.floor(F.col("__s") / 86400).alias("day"))


def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unvalidated fills with all values as text, as a page of the public API has them."""
    e = events(spark, sf_dir)
    day, k = F.col("day").cast("string"), F.col("k")
    return e.select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
        F.concat(F.lit("acct-"), F.col("user_id").cast("string")).alias("proxyWallet"),
        F.concat(F.lit("m"), day).alias("conditionId"),
        F.concat(F.lit("m"), day, F.when(k % 2 == 0, "-up").otherwise("-down")).alias("asset"),
        F.when((F.col("event_type") == "error") & (F.col("day") % 3 == 0), "SELL").otherwise("BUY").alias("side"),
        F.when(k % 2 == 0, "Up").otherwise("Down").alias("outcome"),
        F.col("value").cast(SHARES).cast("string").alias("size"),
        (F.lit("0.30").cast(PRICE) + k * F.lit("0.004").cast(PRICE)).cast(PRICE).cast("string").alias("price"),
        F.col("epoch").cast("string").alias("timestamp"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("epoch").cast("string")).alias("transactionHash"),
        F.concat(F.lit("btc-updown-5m-"), (F.col("day") * 300).cast("string")).alias("slug"),
        F.col("event_id"),
    )


def candles(spark: SparkSession, sf_dir: str, interval: int = 60) -> DataFrame:
    e = events(spark, sf_dir)
    price = (F.col("value") + 1).cast("decimal(18,8)")
    order = F.struct("epoch", "event_id")
    bars = e.groupBy((F.floor(F.col("epoch") / interval) * interval).alias("open_epoch")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"))
    return bars.withColumn("interval_seconds", F.lit(interval))
