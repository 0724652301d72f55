"""Public claims against measured values. Texts and targets are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.functions import scalars as S

#: (claim, measured column or None where it cannot be measured, target, tolerance)
CLAIMS = (
    ("trades_per_active_hour", "fills_per_active_hour", 51.25, 0.25),
    ("average_trade", "average_notional", 110.67, 1.0),
    ("win_rate", None, 0.5, 0.0),
    ("average_pair_cost", "average_pair_cost", 0.9843, 0.005),
    ("gross_paired_edge", "gross_paired_edge", 0.0157, 0.005),
    ("paired_inventory", "paired_event_ratio", 0.787, 0.05),
    ("directional_residual", "directional_event_ratio", 0.213, 0.05),
    ("total_profit", None, 126836.0, 0.0),
)


def average_pair_cost(markets: DataFrame) -> DataFrame:
    """One row over complete markets with pairs: cost weighted by ending paired shares, and the edge."""
    ok = markets.where(F.col("history_complete") & F.col("weighted_pair_cost").isNotNull() & (F.col("ending_paired") > 0))
    w = F.col("ending_paired").cast("double")
    return ok.agg(S.ratio(F.sum(F.col("weighted_pair_cost") * w), F.sum(w)).alias("average_pair_cost"), F.avg("weighted_pair_cost").alias("unweighted_pair_cost"), F.count("*").alias("pair_cost_markets")).withColumn("gross_paired_edge", 1 - F.col("average_pair_cost"))


def claim_results(activity: DataFrame, exposure: DataFrame, pair_cost: DataFrame, claims=CLAIMS) -> DataFrame:
    """(position, claim, measured, status): a row for each claim; what cannot be measured is inconclusive."""
    one = activity.crossJoin(exposure).crossJoin(pair_cost)  # single rows
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("claim"), (F.col(m).cast("double") if m else F.lit(None).cast("double")).alias("measured"), (S.claim_status(F.col(m).cast("double"), t, tol) if m else F.lit("inconclusive")).alias("status")) for i, (c, m, t, tol) in enumerate(claims)]
    return one.select(F.inline(F.array(*rows)))
