"""Held-out evaluation by windows: mean and timing-bucket predictors in closed form, folds, splits, gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.metrics import classification_metrics, plain_scores, regression_metrics, weighted_mean


def leave_one_window_out(panel: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], windows: list[str] | None = None) -> DataFrame:
    """Union over windows of fit_predict(train, held_out): the train part never holds the window's rows. Windows are few by nature."""
    names = windows or [r[0] for r in panel.select("window_id").distinct().orderBy("window_id").collect()]
    out = None
    for name in names:
        part = fit_predict(panel.where(F.col("window_id") != name), panel.where(F.col("window_id") == name))
        out = part if out is None else out.unionByName(part)
    return out


def external(discovery: DataFrame, rows: DataFrame, fit: Callable[[DataFrame], object]) -> DataFrame:
    """rows scored by one model that was fitted to all of `discovery`."""
    return fit(discovery).score(rows)


def held_out_metrics(panel: DataFrame, fit: Callable[[DataFrame], object], discovery: list[str] | None = None) -> DataFrame:
    """A row of errors for each held-out window: every window by a model of the others or, where `discovery` names
    windows, every other window by one model of those. The panel is kept while the models are fitted; what is
    returned is a row a window.
    """
    spark, panel = panel.sparkSession, panel.persist()
    try:
        if discovery is None:
            scored = leave_one_window_out(panel, lambda train, held: fit(train).score(held))
        else:
            scored = external(panel.where(F.col("window_id").isin(discovery)), panel.where(~F.col("window_id").isin(discovery)), fit)
        found = regression_metrics(scored, ["window_id"]).join(classification_metrics(scored, ["window_id"]), "window_id").join(plain_scores(scored, ["window_id"]), "window_id")
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        panel.unpersist()


def _outside(panel: DataFrame, keys: list[str]) -> DataFrame:
    """(window_id, keys, predicted, probability): weighted means over the other windows' rows, by total minus own.

    Rows are summed once by window and key; the totals are taken over those few sums.
    """
    w, y = F.col("paired_shares").cast("double"), F.col("favorable").cast("int")
    own = panel.groupBy("window_id", *keys).agg(F.sum(F.col("pair_cost").cast("double") * w).alias("a"), F.sum(y * w).alias("b"), F.sum(w).alias("w"), F.count("*").alias("n"))
    every = Window.partitionBy(*keys)
    rest = lambda c: F.sum(c).over(every) - F.col(c)
    mean = lambda c: F.when(rest("n") > 0, S.ratio(rest(c), rest("w")))
    return own.select("window_id", *keys, mean("a").alias("predicted"), mean("b").alias("probability"))


def global_mean_predictions(panel: DataFrame) -> DataFrame:
    """Each row's predicted cost and probability: the weighted means over the other windows."""
    return panel.join(_outside(panel, []), "window_id")


def timing_bucket_predictions(panel: DataFrame, zero_falls_back: bool = False) -> DataFrame:
    """Means of the row's timing bucket over the other windows; unknown buckets fall back to the global mean (with zero_falls_back a mean of 0 too)."""
    rows = panel.withColumn("bucket", S.timing_bucket(F.col("lag_seconds"), F.col("elapsed_seconds")))
    own = _outside(rows, ["bucket"]).withColumnsRenamed({"predicted": "__a", "probability": "__b"})
    both = global_mean_predictions(rows).join(own, ["window_id", "bucket"], "left")
    use = (lambda c: F.nullif(c, F.lit(0.0))) if zero_falls_back else (lambda c: c)
    return both.withColumn("predicted", F.coalesce(use(F.col("__a")), "predicted")).withColumn("probability", F.coalesce(use(F.col("__b")), "probability")).drop("__a", "__b")


def pooled(folds: DataFrame, metrics: list[str], by: str = "model", weight: str = "weight") -> DataFrame:
    """Fold metrics pooled by the folds' share weight."""
    return folds.groupBy(by).agg(*[weighted_mean(F.col(m), F.col(weight)).alias(m) for m in metrics])


def permuted(rows: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """rows with the named columns exchanged jointly between rows of a window, by a seeded order; the rest stays."""
    key = ["market_id", "completing_seq", "event_index"]
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    own = F.row_number().over(Window.partitionBy("window_id").orderBy(*key))
    other = F.row_number().over(Window.partitionBy("window_id").orderBy(shuffled, *key))
    left = rows.withColumn("__n", own).drop(*columns)
    return left.join(rows.withColumn("__n", other).select("window_id", "__n", *columns), ["window_id", "__n"]).drop("__n").select(*rows.columns)


def timing_bucket_rules(panel: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A scorer that takes the means of the other windows of `panel`, whatever rows it is given."""
    bucketed = panel.withColumn("bucket", S.timing_bucket(F.col("lag_seconds"), F.col("elapsed_seconds")))
    every, own = _outside(panel, []), _outside(bucketed, ["bucket"]).withColumnsRenamed({"predicted": "__a", "probability": "__b"})
    # a bucket that the window itself lacks has the total of the others
    w, y = F.col("paired_shares").cast("double"), F.col("favorable").cast("int")
    total = bucketed.groupBy("bucket").agg(S.ratio(F.sum(F.col("pair_cost").cast("double") * w), F.sum(w)).alias("__c"), S.ratio(F.sum(y * w), F.sum(w)).alias("__d"))

    def score(rows: DataFrame) -> DataFrame:
        x = rows.withColumn("bucket", S.timing_bucket(F.col("lag_seconds"), F.col("elapsed_seconds"))).join(every, "window_id")
        x = x.join(own.withColumn("__own", F.lit(True)), ["window_id", "bucket"], "left").join(total, "bucket", "left")
        pick = lambda a, t, g: F.coalesce(F.when(F.col("__own"), F.col(a)).otherwise(F.col(t)), F.col(g))
        return x.withColumn("predicted", pick("__a", "__c", "predicted")).withColumn("probability", pick("__b", "__d", "probability")).drop("__a", "__b", "__c", "__d", "__own")

    return score


def permutation_deltas(rows: DataFrame, score: Callable[[DataFrame], DataFrame], groups: dict[str, list[str]], seed: int = 1000) -> DataFrame:
    """(window_id, permutation, weighted_mae_delta, weighted_brier_delta): by how much held-out errors change when a group of
    inputs is exchanged jointly within each window. Each group has its own seed; all windows are permuted and scored at once."""
    measure = lambda x: regression_metrics(x, ["window_id"]).join(classification_metrics(x, ["window_id"]), "window_id")
    base = measure(score(rows)).select("window_id", F.col("weighted_mae").alias("__m"), F.col("weighted_brier").alias("__b"))
    out = None
    for i, (name, columns) in enumerate(groups.items()):
        part = measure(score(permuted(rows, columns, seed + i))).join(base, "window_id")
        part = part.select("window_id", F.lit(name).alias("permutation"), (F.col("weighted_mae") - F.col("__m")).alias("weighted_mae_delta"), (F.col("weighted_brier") - F.col("__b")).alias("weighted_brier_delta"))
        out = part if out is None else out.unionByName(part)
    return out
