"""Market eligibility and the canonical ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.ranges import span


def exclusion(known: Column, outcomes: Column, pair: Column) -> Column:
    """Why a market is not eligible, null if it is. The codes are fixed values."""
    return F.when(~known, "unresolved_history_completeness").when(outcomes != 2, F.concat(F.lit("expected_2_outcomes_found_"), outcomes.cast("string"))).when(~pair, "ambiguous_non_complementary_outcomes")


def classify_markets(fills: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """(market_id, eligible, reason): two outcomes that complement each other, in a market whose history is complete.

    complete: market ids with complete history; None takes all as complete, an empty table none.
    """
    found = fills.groupBy("market_id").agg(F.count_distinct("outcome").alias("n"), F.bool_or(S.outcome_side(F.col("outcome")) == "UP").alias("up"), F.bool_or(S.outcome_side(F.col("outcome")) == "DOWN").alias("down"))
    if complete is None:
        found = found.withColumn("known", F.lit(True))
    else:
        found = found.join(complete.select("market_id").distinct().withColumn("known", F.lit(True)), "market_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    reason = exclusion(F.col("known"), F.col("n"), F.coalesce("up", F.lit(False)) & F.coalesce("down", F.lit(False)))
    return found.select("market_id", reason.isNull().alias("eligible"), reason.alias("reason"))


def global_sequence(rows: DataFrame, order: list[str], name: str = "fill_sequence_number", partitions: int | None = None) -> DataFrame:
    """A contiguous number from 1 over the whole table without one task that holds it: ranges of the first order
    column (a timestamp) are numbered in parallel and shifted by the sizes before them.

    The borders are fixed once as literals, so both passes cut the table alike.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.unix_micros(order[0])
    borders = sorted(set(rows.agg(F.percentile_approx(key, F.array(*[F.lit(i / n) for i in range(1, n)]), 1000)).first()[0] or [])) if n > 1 else []
    ranged = rows.withColumn("__range", F.size(F.filter(F.lit(borders).cast("array<bigint>"), lambda b: b <= key)) if borders else F.lit(0))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shifts = ranged.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__n", number).join(F.broadcast(shifts), "__range").withColumn(name, (F.col("__n") + F.col("__before")).cast("bigint")).drop("__n", "__range", "__before")


def canonical_ledger(fills: DataFrame, complete: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """Fills with epoch, normalised side, eligibility and the order within their market by (timestamp, source_trade_id).

    numbered adds the global fill sequence, which only reports need; everything else orders within markets. market_sold: the market has a SELL with a side.
    """
    rows = fills.where("market_id IS NOT NULL").withColumn("epoch", F.unix_seconds("timestamp")).withColumn("oside", S.outcome_side(F.col("outcome"))).withColumn("notional", F.col("price") * F.col("shares"))
    # a market is ordered in spans of seconds; a row a span tells the fills before it and, as a market has a handful of outcomes, its eligibility
    rows = rows.withColumn("__span", span("epoch"))
    made = rows.columns
    side = lambda s: F.coalesce(F.max(F.col("oside") == s), F.lit(False))
    sold = F.coalesce(F.max((F.col("side") == "SELL") & F.col("oside").isNotNull()), F.lit(False))
    spans = rows.groupBy("market_id", "__span").agg(F.count("*").alias("__fills"), F.collect_set("outcome").alias("__outcomes"), side("UP").alias("__up"), side("DOWN").alias("__down"), sold.alias("__sells"))
    market = Window.partitionBy("market_id")
    before = market.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("market_id", "__span", F.coalesce(F.sum("__fills").over(before), F.lit(0)).alias("__before"), F.size(F.array_distinct(F.flatten(F.collect_list("__outcomes").over(market)))).alias("__n"), (F.max("__up").over(market) & F.max("__down").over(market)).alias("__pair"), F.max("__sells").over(market).alias("market_sold"))
    if complete is None:
        spans = spans.withColumn("__known", F.lit(True))
    else:
        spans = spans.join(complete.select("market_id").distinct().withColumn("__known", F.lit(True)), "market_id", "left")
    spans = spans.withColumn("market_exclusion_reason", exclusion(F.coalesce("__known", F.lit(False)), F.col("__n"), F.col("__pair")))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("market_id", "__span").orderBy("timestamp", "source_trade_id")))
    rows = rows.join(spans, ["market_id", "__span"]).withColumn("seq", (F.col("seq") + F.col("__before")).cast("int"))
    rows = rows.select(*made, "seq", "market_exclusion_reason", F.col("market_exclusion_reason").isNull().alias("eligible_binary_market"), "market_sold").drop("__span")
    return global_sequence(rows, ["timestamp", "source_trade_id"]) if numbered else rows


def buys_of_clean_markets(ledger: DataFrame) -> DataFrame:
    """BUY fills with a side of eligible markets that have no SELL at all."""
    return ledger.where("eligible_binary_market AND oside IS NOT NULL AND side = 'BUY' AND NOT market_sold").drop("market_sold")


def contained_markets(fills: DataFrame, start: int, end: int) -> DataFrame:
    """Ids of five-minute markets that lie wholly in [start, end], by their slug."""
    begin = S.market_start(F.col("slug"))
    return fills.where((begin >= start) & (begin + S.MARKET_SECONDS <= end)).select("market_id").distinct()
