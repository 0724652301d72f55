"""Binding of pair events to strictly earlier predictions, and the prospective report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.metrics import calibration, weighted_mean
from lotline.operators.ranges import span


def eligible_predictions(predictions: DataFrame) -> DataFrame:
    """Candidates that were not reconstructed after the fact."""
    return predictions.where(F.col("candidate") & ~F.col("reconstructed"))


def bind_strictly_prior(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """pairs + prediction columns and status: the last prediction created before the pair's second, with a lower sequence.

    pairs: (pair_id, market_id, formed_at_epoch, sequence, ...); predictions: (prediction_id, market_id, created_ms, sequence).
    Markets agree without regard to case; of equal times the higher sequence binds. Both sides meet in one sort by time (union and
    running maximum) in each span of seconds of a market, with the maximum before it carried over, so no pair of rows is formed. Sequences grow with time in an append-only log;
    where a candidate's sequence is not lower than the pair's, the nearest earlier candidate with a lower one is taken.
    """
    p = eligible_predictions(predictions).select(F.lower("market_id").alias("m"), F.col("created_ms").alias("t"), F.lit(1).alias("kind"), F.struct(F.col("created_ms").alias("ms"), F.col("sequence").alias("seq"), F.col("prediction_id").alias("id")).alias("p"))
    q = pairs.select(F.lower("market_id").alias("m"), (F.col("formed_at_epoch") * 1000).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.col("sequence").alias("s"), F.struct(*[pairs[c] for c in pairs.columns]).alias("row"))
    rows = p.unionByName(q, allowMissingColumns=True).withColumn("second", F.floor(F.col("t") / 1000)).withColumn("span", span("second")).drop("second")
    # at the same moment pairs come first, so only strictly earlier predictions are in the frame
    inside = Window.partitionBy("m", "span").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__m").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("m IS NOT NULL").groupBy(F.col("m").alias("__m"), F.col("span").alias("__span")).agg(F.max("p").alias("p")).select("__m", "__span", F.max("p").over(earlier).alias("carried"))
    seen = rows.withColumn("b", F.max("p").over(inside)).where("kind = 0").join(ends, (F.col("m") == F.col("__m")) & (F.col("span") == F.col("__span")), "left")
    seen = seen.withColumn("b", F.when(F.col("m").isNotNull(), F.greatest("b", "carried"))).select("row", "m", "t", "s", "b")
    late = F.coalesce(F.col("b.seq") >= F.col("s"), F.lit(False))
    again = seen.where(late).select(F.col("row.pair_id").alias("pair_id"), "m", "t", "s").join(p.select("m", F.col("p").alias("p2")), "m").where("p2.ms < t AND p2.seq < s").groupBy("pair_id").agg(F.max("p2").alias("b2"))
    found = seen.where(~late).select("row", F.when(F.col("b.seq") < F.col("s"), F.col("b")).alias("b"))
    found = found.unionByName(seen.where(late).withColumn("pair_id", F.col("row.pair_id")).join(again, "pair_id", "left").select("row", F.col("b2").alias("b")))
    return found.select("row.*", F.col("b.id").alias("prediction_id"), F.col("b.ms").alias("prediction_ms"), F.when(F.col("b").isNotNull(), "bound_strictly_prior_score").otherwise("unbound_no_strictly_prior_score").alias("status"))


def outcome_labels(pairs: DataFrame) -> DataFrame:
    """A label for each pair: favourable if the two cost less than one together."""
    return pairs.select("pair_id", "market_id", "pair_cost", "paired_shares", (F.col("pair_cost") < 1).alias("favorable"))


def coverage_gaps(pairs: DataFrame, others: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row: ids on one side only, each way; both are 0 in a complete log."""
    a = pairs.select(key).distinct().join(others.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    b = others.select(key).distinct().join(pairs.select(key), key, "left_anti").agg(F.count("*").alias("unknown"))
    return a.crossJoin(b)  # two single rows


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a and only in b, as multisets."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def applied_fills(fills: DataFrame, applications: DataFrame) -> DataFrame:
    """Fills that a state application names; `missing` marks applications without a fill."""
    return applications.join(fills, "fill_event_id", "left").withColumn("missing", F.col("source_trade_id").isNull())


def prospective_rows(bound: DataFrame, from_hour: int = 12, to_hour: int = 18) -> DataFrame:
    """Pairs formed in the hours [from, to) of the UTC day."""
    hour = F.pmod(F.floor(F.col("formed_at_epoch") / 3600), F.lit(24))
    return bound.where((hour >= from_hour) & (hour < to_hour))


def prospective_summary(rows: DataFrame, elapsed: int, least_rows_a_day: int = 500, least_days: int = 14, least_reportable: int = 10, least_bound: int = 20_000, last_day: int = 28) -> DataFrame:
    """One row: evaluated, bound and unbound pairs, coverage, bound quantity, reportable days, and whether the minimums are met."""
    ok = F.col("status") == "bound_strictly_prior_score"
    days = rows.where(ok).groupBy(F.floor(F.col("formed_at_epoch") / 86400).alias("d")).count().where(F.col("count") >= least_rows_a_day).agg(F.count("*").alias("reportable_days"))
    out = rows.agg(F.count("*").alias("evaluated"), F.count_if(ok).alias("bound"), F.count_if(~ok).alias("unbound"), F.sum(F.when(ok, F.col("paired_shares").cast("double"))).alias("bound_shares")).crossJoin(days)
    met = (F.lit(elapsed) >= least_days) & (F.col("reportable_days") >= least_reportable) & (F.col("bound") >= least_bound)
    return out.withColumn("coverage", S.ratio(F.col("bound"), F.col("evaluated"))).withColumn("minimums_reached", met).withColumn("horizon_exhausted", (F.lit(elapsed) >= last_day) & ~met)


def prospective_metrics(scored: DataFrame) -> DataFrame:
    """Per model: weighted absolute error and Brier score (not clipped) of bound rows, with their weight."""
    y, w = F.col("favorable").cast("int"), F.col("paired_shares")
    e, p = F.abs(F.col("predicted_pair_cost") - F.col("pair_cost").cast("double")), F.col("probability")
    return scored.groupBy("model").agg(F.count("*").alias("rows"), F.sum(w.cast("double")).alias("weight"), weighted_mean(e, w).alias("weighted_mae"), weighted_mean((p - y) * (p - y), w).alias("weighted_brier"))


def prospective_calibration(scored: DataFrame) -> DataFrame:
    return calibration(scored, ["model"])
