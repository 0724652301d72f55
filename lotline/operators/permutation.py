"""Importance of model inputs: held-out errors after a group of inputs is exchanged between the rows of each window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.operators.folds import fold_metrics, prepare, scored
from lotline.operators.forests import Spec, fit_forests, permutation_models
from lotline.operators.ranges import with_sums_before
from lotline.sources.scratch import removed, written

SEED = 1000
#: Digits of a hash that tell ranges of a group apart: 4096 ranges.
DIGITS = 3


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows + their place within the group, from 1, as a written table: ranges are numbered in parallel and shifted by the sizes before them."""
    sort = [F.col(group), *order]
    ranges = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranges = written(ranges.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    sizes = ranges.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    both = ranges.join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    out = written(both.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).select(*rows.columns, name), "ranked")
    removed(ranges)
    return out


def ranked_by_hash(rows: DataFrame, group: str, hashed: str, order: list[Column], name: str) -> DataFrame:
    """rows + their place within the group, from 1, by a hexadecimal hash and then `order`. The hash's first digits are ranges of even size, so
    no pass looks for their borders and nothing is written."""
    rows = rows.withColumn("__range", F.substring(hashed, 1, DIGITS))
    own = F.row_number().over(Window.partitionBy(group, "__range").orderBy(hashed, *order))
    rows = with_sums_before(rows.withColumn(name, own), group, "__range", {"__before": F.lit(1)})
    return rows.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def exchanged(rows: DataFrame, keys: list[str], groups: dict[str, tuple[str, ...]], windows: list[str], seed: int = SEED, window: str = "window_id") -> DataFrame:
    """rows + for each group its columns as `<group>:<column>`, exchanged jointly between the rows of a window.

    The order of a window's rows by a hash of seed + 100 x (number of the window) + (number of the group) and the keys says whose values a
    row in order of the keys gets. keys tell rows apart; rows of windows that aren't named are left out.
    """
    named = rows.where(F.col(window).isin(windows)) if windows else rows.limit(0)
    by_key = [F.col(k) for k in keys]
    base = ranked(named, window, by_key, "__r")
    number = F.array_position(F.lit(windows) if windows else F.array(F.lit("")), F.col(window)) - 1
    out = base
    for i, (group, columns) in enumerate(groups.items()):
        text = F.concat_ws(":", (F.lit(seed + i) + 100 * number).cast("string"), *[F.col(k).cast("string") for k in keys])
        source = named.select(window, *by_key, F.md5(text.cast("binary")).alias("__h"), *[F.col(c).alias(f"{group}:{c}") for c in columns])
        given = ranked_by_hash(source, window, "__h", by_key, "__s").select(F.col(window).alias("__w"), "__s", *[F.col(f"`{group}:{c}`") for c in columns])
        out = out.join(given, (F.col(window) == F.col("__w")) & (F.col("__r") == F.col("__s"))).drop("__w", "__s")
    result = written(out.drop("__r"), "exchanged")
    removed(base)
    return result


def held_out_permutations(panel: DataFrame, spec: Spec, groups: dict[str, tuple[str, ...]], keys: list[str], seed: int = SEED) -> DataFrame:
    """(window_id, permutation, weighted_mae_delta, weighted_brier_delta): by how much the errors of each window, scored by the forest of
    the others, grow when a group of its inputs is exchanged. One fit and one pass of scores serve all groups."""
    columns = dict.fromkeys([*keys, "window_id", "pair_cost", "favorable", "paired_shares", *spec.inputs, *(c for g in groups.values() for c in g)])
    panel = written(panel.select(*columns), "rows")  # each group's ranks and the fit read it
    fit_on = prepare(panel, spec.inputs)
    fitted = fit_forests(fit_on, {"model": spec}, folds=list(range(len(fit_on.windows))))
    rows = exchanged(panel, keys, groups, fit_on.windows, seed)
    extra = tuple(f"{g}:{c}" for g, columns in groups.items() for c in columns)
    at, swapped = len(spec.inputs), {}
    for g, columns in groups.items():
        swapped[g] = at
        at += len(columns)
    safe = {c: f"__{i}" for i, c in enumerate(extra)}
    score_on = prepare(rows.withColumnsRenamed(safe), (*spec.inputs, *safe.values()), windows=fit_on.windows)
    errors = written(fold_metrics(scored(score_on, permutation_models(fitted, "model", groups, swapped))), "errors")
    for p in (fit_on, score_on):
        p.close()
    removed(rows)
    removed(panel)
    plain = errors.where("model = ''").select("window_id", F.col("weighted_mae").alias("__m"), F.col("weighted_brier").alias("__b"))
    return errors.where("model <> ''").join(plain, "window_id").select("window_id", F.col("model").alias("permutation"), (F.col("weighted_mae") - F.col("__m")).alias("weighted_mae_delta"), (F.col("weighted_brier") - F.col("__b")).alias("weighted_brier_delta"))


def each_and_joint(columns: tuple[str, ...], joint: str) -> dict[str, tuple[str, ...]]:
    """Each column alone, then all together."""
    return reduce(lambda out, c: out | {c: (c,)}, columns, {}) | {joint: columns}
