"""Summaries of pair events and windows, and error measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.matching import fifo_pairs

#: Paired shares from which a window is adequate.
ADEQUATE_SHARES = 500
EPSILON = 1e-12


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w * x over sum of w, over rows where both are known; null if there is no weight."""
    ok = x.isNotNull() & w.isNotNull()
    return S.ratio(F.sum(F.when(ok, x.cast("double") * w.cast("double"))), F.sum(F.when(ok, w.cast("double"))))


def event_summary(events: DataFrame, by: list[str]) -> DataFrame:
    """Markets, events, paired shares, weighted cost and the share of quantity below one."""
    q, c = F.col("paired_shares"), F.col("pair_cost")
    below = F.sum(F.when(c < 1, q).otherwise(F.lit(0)))
    return events.groupBy(*by).agg(F.count_distinct("market_id").alias("markets"), F.count("*").alias("events"), F.sum(q).alias("paired_shares"), weighted_mean(c, q).alias("weighted_cost"), S.ratio(below, F.sum(q)).alias("below_one_share"))


def chronological_summary(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: weighted cost, edge, below-one and zero-lag shares of quantity, and how many markets SELLs exclude."""
    q, c = F.col("paired_shares"), F.col("pair_cost")
    part = lambda cond: S.ratio(F.sum(F.when(cond, q).otherwise(F.lit(0))), F.sum(q))
    sold = ledger.where("eligible_binary_market AND side = 'SELL'").agg(F.count_distinct("market_id").alias("excluded_sell_markets"))
    made = events.agg(F.count_distinct("market_id").alias("markets"), F.count("*").alias("events"), F.sum(q).alias("paired_shares"), weighted_mean(c, q).alias("weighted_cost"), part(c < 1).alias("below_one_share"), part(F.col("lag_seconds") == 0).alias("zero_lag_share"))
    return made.withColumn("gross_edge", 1 - F.col("weighted_cost")).crossJoin(sold)  # two single rows


def bucket_metrics(events: DataFrame, label: Column, labels: list[str]) -> DataFrame:
    """A row for every label, also for those without events. share_of_total is of all events, labelled or not."""
    q, c = F.col("paired_shares"), F.col("pair_cost")
    found = events.withColumn("label", label).groupBy("label").agg(F.count("*").alias("events"), F.sum(q).alias("paired_shares"), weighted_mean(c, q).alias("weighted_cost"), S.ratio(F.sum(F.when(c < 1, q).otherwise(F.lit(0))), F.sum(q)).alias("below_one_share"))
    found = found.withColumn("total", F.sum("paired_shares").over(Window.partitionBy()))  # a row a label
    spark = events.sparkSession
    every = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "position int, label string")
    out = every.join(found, "label", "left")
    return out.select("position", "label", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce(F.col("paired_shares").cast("double"), F.lit(0.0)).alias("paired_shares"), "weighted_cost", "below_one_share", F.coalesce(S.ratio(F.col("paired_shares"), F.col("total")), F.lit(0.0)).alias("share_of_total"))


def latency_metrics(events: DataFrame) -> DataFrame:
    return bucket_metrics(events, S.latency_bucket(F.col("lag_seconds")), list(S.LATENCY_LABELS))


def market_time_metrics(events: DataFrame) -> DataFrame:
    return bucket_metrics(events, S.market_time_bucket(F.col("elapsed_seconds")), S.market_time_bucket_labels())


def market_band_metrics(events: DataFrame) -> DataFrame:
    return bucket_metrics(events, S.market_time_band(F.col("elapsed_seconds")), list(S.BAND_LABELS))


def per_market_methods(events: DataFrame, methods: tuple[str, ...] = ("fifo", "lifo", "weighted_average")) -> DataFrame:
    """One row a market: for each method its events, quantity and weighted cost."""
    rows = events.groupBy("market_id", "slug").pivot("method", list(methods)).agg(F.count("paired_shares").alias("events"), F.sum("paired_shares").alias("paired_shares"), weighted_mean(F.col("pair_cost"), F.col("paired_shares")).alias("weighted_cost"))
    return rows.fillna(0, [f"{m}_events" for m in methods])


def distribution(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """Count, mean, interpolated median, nearest-rank percentiles (index half up), least and most of a bounded number of values a group.

    The values of a group are gathered in one sorted array: it is meant for reports over markets or windows.
    """
    found = rows.where(value.isNotNull()).groupBy(*(by or [])).agg(F.array_sort(F.collect_list(value)).alias("x"), F.avg(value.cast("double")).alias("mean"))
    p = {name: S.nearest_rank(F.col("x"), v) for name, v in (("p10", 0.10), ("p25", 0.25), ("p75", 0.75), ("p90", 0.90))}
    return found.select(*(by or []), F.size("x").cast("bigint").alias("n"), "mean", S.median_of(F.col("x")).alias("median"), *[v.alias(k) for k, v in p.items()], F.get("x", F.lit(0)).alias("least"), F.get("x", F.size("x") - 1).alias("most"))


def latency_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, median, p95) of whole numbers: the mean of the two middle values, and the value at rank ceil(0.95 n).

    Values are counted before they are ordered, so a task sees each distinct value of its group once.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy(value))
    counts = counts.withColumn("__to", upto).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = lambda rank: F.min(F.when(F.col("__to") >= rank, F.col(value)))
    n = F.col("__all")
    out = counts.groupBy(*by).agg(F.max(n).alias("n"), at(F.floor((n + 1) / 2)).alias("__a"), at(F.floor(n / 2) + 1).alias("__b"), at(F.ceil(n * 0.95)).alias("p95"))
    return out.select(*by, "n", ((F.col("__a") + F.col("__b")) / 2.0).alias("median"), "p95")


def primary_buckets(events: DataFrame, windows: DataFrame, latency: str = "61-120s", band: str = "middle_100_199") -> DataFrame:
    """A row for each window and primary bucket, with its quantity and cost; a window without a report of it is incomplete."""
    rows = events.select("window_id", "paired_shares", "pair_cost", F.explode(F.array(S.latency_bucket(F.col("lag_seconds")), S.market_time_band(F.col("elapsed_seconds")))).alias("bucket"))
    found = rows.where(F.col("bucket").isin(latency, band)).groupBy("window_id", "bucket").agg(F.sum("paired_shares").alias("paired_shares"), weighted_mean(F.col("pair_cost"), F.col("paired_shares")).alias("weighted_cost"))
    every = windows.select("window_id").distinct().withColumn("bucket", F.explode(F.array(F.lit(latency), F.lit(band))))
    return every.join(found, ["window_id", "bucket"], "left").withColumn("complete", F.col("weighted_cost").isNotNull()).fillna(0, ["paired_shares"])


def transaction_pairs(buys: DataFrame) -> DataFrame:
    """FIFO pairs whose two fills share a transaction."""
    return fifo_pairs(buys.where("transaction_hash IS NOT NULL"), by=("transaction_hash", "market_id"))


def transaction_diagnostic(buys: DataFrame) -> DataFrame:
    """One row: transactions, those with both sides, and their pairs; plus the distribution of fills a transaction by counts (not by gathered values)."""
    each = buys.where("transaction_hash IS NOT NULL").groupBy("transaction_hash").agg(F.count("*").alias("n"), F.count_distinct("oside").alias("sides"))
    pairs = transaction_pairs(buys).agg(F.count("*").alias("pairs"), F.sum("paired_shares").alias("paired_shares"), weighted_mean(F.col("pair_cost"), F.col("paired_shares")).alias("weighted_cost"))
    made = each.agg(F.count("*").alias("transactions"), F.count_if(F.col("sides") == 2).alias("two_sided"), F.max("n").alias("most_fills"), F.avg("n").alias("mean_fills"))
    return made.crossJoin(pairs)  # two single rows


# ---------------------------------------------------------------- windows


def window_metrics(events: DataFrame, window: Column, label: Column | None = None) -> DataFrame:
    """(window_id, paired_shares, weighted_pair_cost, below_one_ratio) of events, of those with a true label if one is given."""
    rows = events.where(label) if label is not None else events
    q, c = F.col("paired_shares"), F.col("pair_cost")
    return rows.groupBy(window.alias("window_id")).agg(F.sum(q).alias("paired_shares"), weighted_mean(c, q).alias("weighted_pair_cost"), S.ratio(F.sum(F.when(c < 1, q).otherwise(F.lit(0))), F.sum(q)).alias("below_one_ratio"))


def with_windows(windows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every window with its metric; one without is incomplete with no quantity."""
    return windows.join(metrics, "window_id", "left").withColumn("complete", F.col("paired_shares").isNotNull()).fillna(0, ["paired_shares"])


def adequate(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("complete") & (F.col("paired_shares") >= ADEQUATE_SHARES) & F.col("weighted_pair_cost").isNotNull())


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(window_id, pooled_without): pooled cost of the other windows; rows equal to the omitted one go too. One row a window, so one task is enough."""
    wx, w = F.col("weighted_pair_cost") * F.col("paired_shares").cast("double"), F.col("paired_shares").cast("double")
    every = Window.partitionBy()
    same = Window.partitionBy("window_id", "start_epoch", "weighted_pair_cost", "paired_shares")
    left = F.sum(w).over(every) - F.sum(w).over(same)
    return rows.select("window_id", F.when(left > 1e-9, (F.sum(wx).over(every) - F.sum(wx).over(same)) / left).alias("pooled_without"))


def cumulative(rows: DataFrame) -> DataFrame:
    """Pooled cost of all windows up to each, in order of (start, id). One row a window."""
    w = Window.partitionBy().orderBy("start_epoch", "window_id").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("paired_shares").cast("double")
    return rows.select("window_id", "start_epoch", F.sum(q).over(w).alias("cumulative_shares"), S.ratio(F.sum(F.col("weighted_pair_cost") * q).over(w), F.sum(q).over(w)).alias("cumulative_cost"))


def hypothesis_summary(rows: DataFrame) -> DataFrame:
    """One row: classification, counts, pooled and mean cost, nearest-rank percentiles, and windows below one."""
    ok = F.col("complete") & (F.col("paired_shares") >= ADEQUATE_SHARES) & F.col("weighted_pair_cost").isNotNull()
    c, q = F.col("weighted_pair_cost"), F.col("paired_shares")
    loo = leave_one_out(adequate(rows)).agg(F.max("pooled_without").alias("worst"), F.count_if(F.col("pooled_without").isNull()).alias("unknown"))
    found = rows.agg(F.count("*").alias("requested"), F.count_if("complete").alias("complete"), F.count_if(ok).alias("adequate"), weighted_mean(F.when(ok, c), F.when(ok, q)).alias("pooled"), F.avg(F.when(ok, c)).alias("equal_mean"), F.array_sort(F.collect_list(F.when(ok, c))).alias("x"), F.count_if(ok & (c < 1)).alias("below_one"))
    found = found.crossJoin(loo)  # two single rows
    fraction = S.ratio(F.col("below_one"), F.col("adequate"))
    kind = F.when((F.col("adequate") < 4) | (F.col("complete") < F.col("requested")), "insufficient_data").when(F.col("pooled") >= 1, "not_replicated").when((fraction >= 0.6) & (F.col("worst") < 1) & (F.col("unknown") == 0), "replicated").otherwise("mixed")
    return found.select(kind.alias("classification"), "requested", "complete", "adequate", "pooled", "equal_mean", *[S.nearest_rank(F.col("x"), p).alias(n) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))], F.get("x", F.lit(0)).alias("least"), F.get("x", F.size("x") - 1).alias("most"), "below_one", fraction.alias("below_one_fraction"))


# ---------------------------------------------------------------- predictions


def regression_measures(predicted: str = "predicted", actual: str = "pair_cost", weight: str = "paired_shares") -> list[Column]:
    e = F.col(predicted).cast("double") - F.col(actual).cast("double")
    return [F.count("*").alias("rows"), weighted_mean(F.abs(e), F.col(weight)).alias("weighted_mae"), F.avg(F.abs(e)).alias("mae"), weighted_mean(e, F.col(weight)).alias("weighted_bias")]


def regression_metrics(rows: DataFrame, by: list[str], predicted: str = "predicted", actual: str = "pair_cost", weight: str = "paired_shares") -> DataFrame:
    return rows.groupBy(*by).agg(*regression_measures(predicted, actual, weight))


def clipped(p: Column) -> Column:
    return F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), p))


def classification_measures(probability: str = "probability", actual: str = "favorable", weight: str = "paired_shares") -> list[Column]:
    p, y = clipped(F.col(probability)), F.col(actual).cast("int")
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    return [weighted_mean((p - y) * (p - y), F.col(weight)).alias("weighted_brier"), weighted_mean(loss, F.col(weight)).alias("weighted_log_loss")]


def classification_metrics(rows: DataFrame, by: list[str], probability: str = "probability", actual: str = "favorable", weight: str = "paired_shares") -> DataFrame:
    """Weighted Brier score and log loss, both on the clipped probability."""
    return rows.groupBy(*by).agg(*classification_measures(probability, actual, weight))


def plain_scores(rows: DataFrame, by: list[str], probability: str = "probability", actual: str = "favorable") -> DataFrame:
    """Unweighted Brier score (not clipped) and log loss."""
    y, raw = F.col(actual).cast("int"), F.col(probability)
    p = clipped(raw)
    return rows.groupBy(*by).agg(F.avg((raw - y) * (raw - y)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def calibration(rows: DataFrame, by: list[str], bins: int = 10, probability: str = "probability", actual: str = "favorable", weight: str = "paired_shares") -> DataFrame:
    """A row for every bin of each group, also for empty ones."""
    label = S.calibration_bin(F.col(probability), bins)
    found = rows.groupBy(*by, label.alias("bin")).agg(F.count("*").alias("rows"), F.sum(F.col(weight).cast("double")).alias("weight"), weighted_mean(F.col(probability), F.col(weight)).alias("mean_probability"), weighted_mean(F.col(actual).cast("int"), F.col(weight)).alias("favorable_rate"))
    every = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*by, "bin"], "left").fillna(0, ["rows"]).fillna(0.0, ["weight"])


def fold_summary(folds: DataFrame, metrics: list[str], baseline: str, by: str = "model", fold: str = "window_id") -> DataFrame:
    """Mean over folds of each metric, its delta to the baseline model, and in how many folds it is strictly better."""
    # no join of folds with itself: its sums of doubles would be computed twice, in another order, and a model could win over itself
    own = Window.partitionBy(fold)
    of_baseline = lambda m: F.max(F.when(F.col(by) == baseline, F.col(m))).over(own)
    rows = folds.withColumns({f"__{m}": F.when(F.col(fold).isNotNull(), of_baseline(m)) for m in metrics})
    out = rows.groupBy(by).agg(F.count("*").alias("folds"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.avg(F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in metrics], *[F.count_if(F.col(m) < F.col(f"__{m}")).alias(f"wins_{m}") for m in metrics])
    return out


def advancement(folds: DataFrame, candidate: str, baseline: str, metrics: list[str], least_wins: int = 4, days: int = 7) -> DataFrame:
    """One row of gates: the candidate beats the baseline on each pooled metric, wins enough days, and there are exactly `days` of them."""
    row = fold_summary(folds, metrics, baseline).where(F.col("model") == candidate)
    gates = [(F.col(f"delta_{m}") < 0).alias(f"better_{m}") for m in metrics] + [(F.col(f"wins_{m}") >= least_wins).alias(f"enough_wins_{m}") for m in metrics]
    out = row.select(*gates, (F.col("folds") == days).alias("all_days"))
    every = None
    for c in out.columns:
        every = F.col(c) if every is None else every & F.col(c)
    return out.withColumn("advance", every)
