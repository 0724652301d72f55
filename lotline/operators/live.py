"""The live engine's tables as declarative steps: as-of state, feature ticks, monitoring, audits, gates.

Ticks and the records they may see meet in one sort by market (a union with running frames) or by equality of
the second; no tick is paired with every record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.features import BTC, INVENTORY, TRAILS, candle_features
from lotline.operators.markets import latest
from lotline.operators.metrics import weighted_mean
from lotline.operators.ranges import with_previous

# ---------------------------------------------------------------- as-of values of the log


def candles_as_of(versions: DataFrame, as_of: int) -> DataFrame:
    """The latest version of each candle at or before a sequence."""
    return latest(versions, ["open_epoch"], "sequence", as_of)


def market_status_as_of(metadata: DataFrame, quarantines: DataFrame, as_of: int) -> DataFrame:
    """(market_id, known, quarantined): the last metadata record of a market decides (an ineligible one cancels); a quarantine stays."""
    known = latest(metadata.select(F.lower("market_id").alias("market_id"), "eligible", "sequence"), ["market_id"], "sequence", as_of)
    stopped = quarantines.where(F.col("sequence") <= as_of).select(F.lower("market_id").alias("market_id")).distinct().withColumn("quarantined", F.lit(True))
    return known.join(stopped, "market_id", "left").select("market_id", F.coalesce("eligible", F.lit(False)).alias("known"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"))


def event_time_order(fills: DataFrame) -> DataFrame:
    """fills + replay_order: their place within the market by source time, trade id and ingest id."""
    return fills.withColumn("replay_order", F.row_number().over(Window.partitionBy("market_id").orderBy("epoch", "source_trade_id", "arrival")))


# ---------------------------------------------------------------- feature ticks


def tick_states(ticks: DataFrame, fills: DataFrame, as_of: bool = True) -> DataFrame:
    """(market_id, tick, ...) state of the BUYs of each market at each of its ticks; trailing windows end at the tick.

    as_of: inventory and last fills count what was there by the tick; without it every applied fill of the market counts.
    """
    zero = F.lit(0).cast("decimal(28,8)")
    b = fills.where("side = 'BUY'").select("market_id", F.col("epoch").alias("t"), F.lit(0).alias("k"), "source_trade_id", "oside", "shares")
    null = lambda c: F.lit(None).cast(b.schema[c].dataType).alias(c)
    rows = b.unionByName(ticks.select("market_id", F.col("tick").alias("t"), F.lit(1).alias("k"), null("source_trade_id"), null("oside"), null("shares")))
    order = Window.partitionBy("market_id").orderBy("t", "k", "source_trade_id")
    before = F.last("oside", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__change", F.when(F.col("k") == 0, F.coalesce((before != F.col("oside")).cast("int"), F.lit(0))))
    rows = rows.withColumn("__switches", F.when(F.col("k") == 0, F.sum("__change").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    by_time = Window.partitionBy("market_id").orderBy("t")
    held = by_time.rangeBetween(Window.unboundedPreceding, 0) if as_of else by_time.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    trail = lambda s: by_time.rangeBetween(-s, 0)
    side = lambda s, c: F.when(F.col("oside") == s, c)
    up, down = (F.coalesce(F.sum(side(s, F.col("shares"))).over(held), zero) for s in ("UP", "DOWN"))
    made = {"__u": up, "__d": down} | {f"__t{s}": F.max(side(s, F.col("t"))).over(held) for s in ("UP", "DOWN")}
    made |= {f"fill_count_{s}s": F.count("shares").over(trail(s)) for s in TRAILS} | {f"fill_qty_{s}s": F.coalesce(F.sum("shares").over(trail(s)), zero) for s in TRAILS}
    made |= {"side_switches_60s": F.coalesce(F.max("__switches").over(trail(60)) - F.min("__switches").over(trail(60)), F.lit(0)), "same_second_fill_count": F.count("shares").over(trail(0))}
    rows = rows.select("market_id", F.col("t").alias("tick"), "k", *[c.alias(n) for n, c in made.items()]).where("k = 1")
    u, d = F.col("__u"), F.col("__d")
    return rows.select("market_id", "tick", u.alias("up_inventory"), d.alias("down_inventory"), F.least(u, d).alias("paired_inventory"), F.abs(u - d).alias("residual_inventory"), S.ratio(u - d, u + d).alias("inventory_imbalance"), S.seconds_since(F.col("tick"), F.col("__tUP")).alias("seconds_since_last_up_fill"), S.seconds_since(F.col("tick"), F.col("__tDOWN")).alias("seconds_since_last_down_fill"), *[f"fill_{k}_{s}s" for k in ("count", "qty") for s in TRAILS], "side_switches_60s", F.least(u, d).alias("cumulative_paired_quantity"), "same_second_fill_count")


# Reasons why a tick gives no snapshot, in the order in which they are checked.
TICK_REASONS = (
    "market_metadata_unknown_or_ineligible",
    "outside_market_window",
    "outside_evaluation_window",
    "market_inactive_or_closed",
    "market_state_quarantined",
    "target_source_never_healthy",
    "target_source_stale",
    "btc_no_causal_candle",
    "btc_reference_stale",
)
SOURCE_LIMIT, CANDLE_LIMIT = 5, 120


def tick_reason(checks: list[Column]) -> Column:
    """The first reason whose check holds, else null; a check that is null doesn't hold."""
    out = F.lit(None).cast("string")
    for reason, check in reversed(list(zip(TICK_REASONS, checks, strict=True))):
        out = F.when(F.coalesce(check, F.lit(False)), reason).otherwise(out)
    return out


def build_ticks(ticks: DataFrame, metadata: DataFrame, quarantines: DataFrame, healthy: DataFrame, candles: DataFrame, fills: DataFrame, hours: tuple[Column | int, Column | int] = (12, 18)) -> DataFrame:
    """A row for each (market_id, tick): the reason why it is not scorable, or the ordered features known by then.

    metadata: (market_id, sequence, eligible, market_start, active, closed); quarantines: (market_id, sequence);
    healthy: (epoch) of successful polls; sequences and ticks share one clock, so a tick sees what is at or before it.
    Metadata and quarantines come in by a running frame over the union with the ticks, polls by equality of the seconds
    that are not stale yet.
    """
    t = ticks.select(F.lower("market_id").alias("market_id"), "tick").distinct()
    record = F.struct("sequence", "eligible", "market_start", "active", "closed")
    m = metadata.select(F.lower("market_id").alias("market_id"), F.col("sequence").alias("t"), F.lit(0).alias("k"), record.alias("r"), F.lit(False).alias("q"))
    none = F.lit(None).cast(m.schema["r"].dataType).alias("r")
    q = quarantines.select(F.lower("market_id").alias("market_id"), F.col("sequence").alias("t"), F.lit(0).alias("k"), none, F.lit(True).alias("q"))
    asked = t.select("market_id", F.col("tick").alias("t"), F.lit(1).alias("k"), none, F.lit(False).alias("q"))
    seen = Window.partitionBy("market_id").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    rows = m.unionByName(q).unionByName(asked).withColumn("r", F.max("r").over(seen)).withColumn("q", F.max("q").over(seen)).where("k = 1")
    rows = rows.select("market_id", F.col("t").alias("tick"), F.col("r.eligible").alias("eligible"), F.col("r.market_start").alias("market_start"), (F.coalesce(F.col("r.active"), F.lit(True)) & ~F.coalesce(F.col("r.closed"), F.lit(False))).alias("open"), F.col("q").alias("quarantined"))
    polls = healthy.select(F.col("epoch").alias("second")).distinct()
    fresh = t.select("tick").distinct().select("tick", F.explode(F.sequence(F.col("tick") - SOURCE_LIMIT, F.col("tick"))).alias("second")).join(polls, "second").groupBy("tick").agg(F.max("second").alias("polled"))
    first = polls.agg(F.min("second").alias("first_poll"))
    rows = rows.join(fresh, "tick", "left").crossJoin(F.broadcast(first))  # one row
    known = candle_features(rows.where("market_start IS NOT NULL").select(F.col("tick").alias("event_epoch"), "market_start"), candles).select(F.col("event_epoch").alias("tick"), "market_start", "btc_reference_epoch", *BTC)
    rows = rows.join(known, ["tick", "market_start"], "left").join(tick_states(t, fills.withColumn("market_id", F.lower("market_id"))), ["market_id", "tick"], "left")
    tick, elapsed = F.col("tick"), F.col("tick") - F.col("market_start")
    hour = F.pmod(F.floor(tick / 3600), F.lit(24))
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in hours)
    checks = [
        ~F.coalesce("eligible", F.lit(False)), (elapsed < 0) | (elapsed >= S.MARKET_SECONDS), (hour < a) | (hour >= b), ~F.col("open"), F.col("quarantined"),
        F.col("first_poll").isNull() | (F.col("first_poll") > tick), F.col("polled").isNull(), F.col("btc_reference_epoch").isNull(), tick - F.col("btc_reference_epoch") > CANDLE_LIMIT,
    ]
    rows = rows.withColumn("reason", tick_reason(checks)).withColumn("elapsed_seconds", elapsed).withColumn("seconds_remaining", S.MARKET_SECONDS - elapsed)
    value = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return rows.select("market_id", "tick", "reason", F.col("reason").isNull().alias("scorable"), *[value(c) for c in ("elapsed_seconds", "seconds_remaining", *INVENTORY, *BTC)])


def cadence(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """(tick) of a fixed beat over [start, end), in as many tasks as the session has: what a live trigger would have fired."""
    return spark.range(start, end, step).withColumnRenamed("id", "tick")


# ---------------------------------------------------------------- monitor

HEALTH_LIMITS = {"target": (10, 60), "candles": (20, 60)}


def operational_monitor(log: DataFrame, now_ms: int, limits: dict[str, tuple[int, int]] = HEALTH_LIMITS, gap_ms: int = 900_000, recent_ms: int = 300_000) -> DataFrame:
    """One row a run: counts, integrity errors, age, largest recent gap, freshness of sources, alerts, and the status.

    log: (run_id, line, sequence, event_id, event_type, created_ms, frozen, source, status, partial). A line without a
    sequence is malformed unless it is the partial tail. `limits` names each source's seconds from which it degrades
    and from which it is critical. Sequences are compared with the record before, so a gap counts once.
    """
    ok = F.col("sequence").isNotNull()
    recent = F.col("created_ms") >= now_ms - gap_ms
    expected = F.coalesce("__expected", F.lit(0).cast("bigint"))
    gap = F.when(recent, F.col("created_ms") - F.col("__recent"))
    rows = with_previous(log, "run_id", "line", {"__expected": (F.col("sequence") + 1, ok), "__recent": (F.col("created_ms"), recent)})
    rows = rows.withColumn("__wrong", ok & (F.col("sequence") != expected)).withColumn("__gap", F.when(gap >= 0, gap)).withColumn("__id", ok & ~F.col("event_id").eqNullSafe(F.concat_ws(":", "run_id", F.col("sequence").cast("string"))))
    rows = rows.withColumn("__start", F.col("event_type") == "evaluation_run_start").withColumn("__health", F.col("event_type") == "source_health")
    poll = lambda s: F.col("__health") & (F.col("source") == s)
    late = lambda s: F.max(F.when(poll(s) & (F.col("status") == "poll_ok"), F.col("created_ms")))
    bad = lambda s: F.count_if(poll(s) & (F.col("status") != "poll_ok") & (F.col("created_ms") >= now_ms - recent_ms))
    out = rows.groupBy("run_id").agg(
        F.count_if(ok).alias("events"), F.max("sequence").alias("latest_sequence"), F.count_if(~ok & ~F.col("partial")).alias("malformed"), F.count_if("partial").alias("partial_tail"), F.count_if("__wrong").alias("sequence_errors"), F.count_if("__id").alias("id_errors"),
        F.count_if("__start").alias("starts"), F.coalesce(F.bool_or(F.col("__start") & (F.col("sequence") == 0) & F.col("frozen") & ~F.col("__id")), F.lit(False)).alias("valid_start"), (F.lit(now_ms) - F.max("created_ms")).alias("age_ms"), F.max("__gap").alias("largest_gap_ms"),
        F.count_if(F.col("event_type") == "state_quarantine").alias("quarantines"), F.count_if((F.col("event_type") == "score_binding") & (F.col("status") == "bound")).alias("bound"), F.count_if((F.col("event_type") == "score_binding") & (F.col("status") == "unbound")).alias("unbound"),
        *[late(s).alias(f"{s}_ok_ms") for s in limits], *[bad(s).alias(f"{s}_bad") for s in limits],
    )
    age = lambda s: F.lit(now_ms) - F.col(f"{s}_ok_ms")
    critical = [F.col("malformed") > 0, F.col("sequence_errors") > 0, F.col("id_errors") > 0, (F.col("starts") != 1) | ~F.col("valid_start"), F.col("age_ms").isNull() | (F.col("age_ms") > 60_000), F.coalesce(F.col("largest_gap_ms") > 60_000, F.lit(False)), *[age(s).isNull() | (age(s) > 1000 * b) for s, (_, b) in limits.items()]]
    degraded = [F.col("age_ms") > 10_000, F.coalesce(F.col("largest_gap_ms") > 15_000, F.lit(False)), F.col("quarantines") > 0, F.col("partial_tail") > 0, *[F.coalesce(age(s) > 1000 * a, F.lit(False)) for s, (a, _) in limits.items()], *[F.col(f"{s}_bad") > 0 for s in limits]]
    count = lambda checks: reduce(lambda x, y: x + y, [c.cast("int") for c in checks])
    out = out.withColumn("critical_alerts", count(critical)).withColumn("degraded_alerts", count(degraded))
    return out.withColumn("state", F.when(F.col("critical_alerts") > 0, "CRITICAL").when(F.col("degraded_alerts") > 0, "DEGRADED").otherwise("HEALTHY"))


def run_start_problems(log: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(run_id, problem) of runs that are not under frozen control: no single start record at sequence 0, or one whose values differ from `expected`.

    log: (run_id, sequence, event_type, settings map<string,string>).
    """
    start = F.col("event_type") == "evaluation_run_start"
    first = F.max(F.when(start & (F.col("sequence") == 0), F.col("settings")).cast("string")).isNotNull()
    each = log.groupBy("run_id").agg(F.count_if(start).alias("n"), first.alias("at_zero"))
    wrong = each.select("run_id", F.when(F.col("n") == 0, "no_start_record").when(F.col("n") > 1, "several_start_records").when(~F.col("at_zero"), "start_not_at_sequence_zero").alias("problem")).where("problem IS NOT NULL")
    drift = log.where(start & (F.col("sequence") == 0)).select("run_id", F.explode(F.array(*[F.when(~F.try_element_at("settings", F.lit(k)).eqNullSafe(F.lit(v)), F.lit(f"drift:{k}")) for k, v in sorted(expected.items())])).alias("problem"))
    return wrong.unionByName(drift.where("problem IS NOT NULL"))


# ---------------------------------------------------------------- audits


def predictions_with_snapshots(predictions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """predictions + the columns of the snapshot they name and `problem`: no snapshot, or one that is not older than the prediction."""
    s = snapshots.select(F.col("snapshot_id"), F.col("sequence").alias("snapshot_sequence"), *[c for c in snapshots.columns if c not in ("snapshot_id", "sequence", *predictions.columns)])
    out = predictions.join(s, "snapshot_id", "left")
    return out.withColumn("problem", F.when(F.col("snapshot_sequence").isNull(), "snapshot_missing").when(F.col("snapshot_sequence") >= F.col("sequence"), "snapshot_not_prior"))


def audit(recorded: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """One row: rows on one side only, and rows whose values differ by more than the tolerance (null equals null only)."""
    b = recomputed.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(1).alias("__there"))
    both = recorded.withColumn("__here", F.lit(1)).join(b, keys, "full")
    paired = F.col("__here").isNotNull() & F.col("__there").isNotNull()
    same = reduce(lambda x, y: x & y, [F.coalesce(F.abs(F.col(v) - F.col(f"__{v}")) <= tolerance, F.col(v).isNull() & F.col(f"__{v}").isNull()) for v in values])
    out = both.agg(F.count("*").alias("rows"), F.count_if(F.col("__there").isNull()).alias("not_recomputed"), F.count_if(F.col("__here").isNull()).alias("not_recorded"), F.count_if(paired & ~same).alias("different"))
    return out.withColumn("passed", F.col("not_recomputed") + F.col("not_recorded") + F.col("different") == 0)


# ---------------------------------------------------------------- folds and gates


def zip_folds(a: DataFrame, b: DataFrame, fold: str = "window_id") -> DataFrame:
    """Folds of two models side by side: b's columns with the suffix _b; fails if a fold is on one side only or twice."""
    other = b.select(F.col(fold).alias("__fold"), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != fold])
    both = a.join(other, F.col(fold) == F.col("__fold"), "full")
    n = F.count("*").over(Window.partitionBy(F.coalesce(F.col(fold), F.col("__fold"))))
    checked = F.when(F.col("__fold").isNotNull() & F.col(fold).isNotNull() & (n == 1), F.col(fold)).otherwise(F.raise_error(F.lit("the models' folds differ")))
    return both.withColumn(fold, checked).drop("__fold")


def _means(folds: DataFrame, name: str, by_weight: bool) -> DataFrame:
    mean = (lambda m: weighted_mean(F.col(m), F.col("weight"))) if by_weight else F.avg
    return folds.where(F.col("model") == name).agg(mean("weighted_mae").alias("mae"), mean("brier").alias("brier"))


def external_gate(folds: DataFrame, primary: str, base: str, plain: str, least_wins: int = 4, by_weight: bool = False, days: int | None = None, leakage_passed: bool = True) -> DataFrame:
    """One row of the gates of an external validation: the primary model's mean error and Brier score against a base and a
    plain model, days won, and, where `days` is given, that there are so many with rows and no leakage.

    folds: (model, window_id, rows, weight, weighted_mae, brier).
    """
    both = zip_folds(folds.where(F.col("model") == primary).drop("model"), folds.where(F.col("model") == base).drop("model"))
    won = both.agg(F.count_if(F.col("weighted_mae") < F.col("weighted_mae_b")).alias("mae_wins"), F.count_if(F.col("brier") < F.col("brier_b")).alias("brier_wins"), F.count("*").alias("n"), F.min("rows").alias("least_rows"))
    one = won
    for prefix, name in (("p", primary), ("b", base), ("l", plain)):
        one = one.crossJoin(_means(folds, name, by_weight).withColumnsRenamed({"mae": f"{prefix}_mae", "brier": f"{prefix}_brier"}))  # single rows
    checks = {"mae_better_than_base": F.col("p_mae") < F.col("b_mae"), "brier_better_than_base": F.col("p_brier") < F.col("b_brier"), "mae_wins_enough": F.col("mae_wins") >= least_wins, "brier_wins_enough": F.col("brier_wins") >= least_wins, "mae_better_than_plain": F.col("p_mae") < F.col("l_mae"), "brier_better_than_plain": F.col("p_brier") < F.col("l_brier")}
    if days is not None:
        checks |= {"leakage_audit_passed": F.lit(leakage_passed), "all_days_reportable": (F.col("n") == days) & (F.col("least_rows") > 0)}
    return one.select("mae_wins", "brier_wins", *[c.alias(k) for k, c in checks.items()]).withColumn("passed", reduce(lambda x, y: x & y, [F.col(k) for k in checks]))
