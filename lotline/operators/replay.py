"""Replay audit: what a live run recorded, rebuilt from its event log alone.

Two clocks rule what a snapshot may see. The log's sequence says what was known when it was made: metadata, applied fills,
quarantines, polls and the versions of candles with a sequence of at most `as_of_sequence`. The tick says which seconds its trailing
windows and candles cover. What depends on the sequence alone comes from one sort by market (running frames over the union of
events and ticks). Trailing fills meet their ticks by equality of market and second, each fill in the seconds that can see it, so their rows
grow with fills and ticks and not with the product of a market's. Candles meet lookups by equality of the minute.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.binding import bind_strictly_prior, outcome_labels
from lotline.operators.features import BTC, INVENTORY, TRAILS
from lotline.operators.live import CANDLE_LIMIT, SOURCE_LIMIT, tick_reason
from lotline.schemas import SHARES
from lotline.sources.scratch import removed, written

#: Names and order of a snapshot's features.
FEATURES = ("elapsed_seconds", "seconds_remaining", *INVENTORY, *BTC)
MINUTE = 60
#: Sequences whose polls one task orders.
BLOCK = 1 << 16
#: Minutes of the first search for a candle; each further one goes back this many times as far.
SEARCH = 16

# Payloads of the log's events as JSON.
METADATA = "market_id string, eligible boolean, market_start bigint, active boolean, closed boolean"
FILL = "market_id string, source_trade_id string, ingest_id string, oside string, side string, price string, shares string, epoch bigint, receive_epoch bigint"
APPLICATION = "market_id string, fill_event_id string, status string, quarantined boolean"
HEALTH = "source string, status string"
CANDLE = "open_epoch bigint, open string, high string, low string, close string"
PROVENANCE = ("btc_reference_epoch", "btc_reference_price", "max_source_epoch", "max_receive_epoch", "max_fill_key", "applied_buy_fill_count")
SNAPSHOT = "market_id string, tick bigint, as_of_sequence bigint, feature_order array<string>, features map<string,double>, btc_reference_epoch bigint, btc_reference_price double, max_source_epoch bigint, max_receive_epoch bigint, max_fill_key string, applied_buy_fill_count bigint, reason string"
PREDICTION = "market_id string, snapshot_event_id string, outputs map<string,struct<predicted:double,probability:double>>, candidate boolean, reconstructed boolean"
PAIR = "market_id string, pair_cost double, paired_shares double, formed_at_epoch bigint"
LABEL = "pair_event_id string, pair_cost double, favorable boolean"
BINDING = "pair_event_id string, prediction_event_id string, status string"


def payloads(log: DataFrame, kind: str, schema: str) -> DataFrame:
    """(event_id, sequence, created_ms, payload fields...) of the events of a kind; a payload that is no such object has nulls."""
    p = F.from_json("payload", schema).alias("p")
    return log.where(F.col("event_type") == kind).select("event_id", "sequence", F.unix_millis(F.to_timestamp("created_at")).alias("created_ms"), p).select("event_id", "sequence", "created_ms", "p.*")


def _market(df: DataFrame) -> DataFrame:
    return df.withColumn("market_id", F.lower("market_id"))


def applied(log: DataFrame) -> DataFrame:
    """Applications of fills with their fill: (event_id, sequence, market_id, fill columns, `found`); found is false where the log has no such fill before."""
    fills = payloads(log, "normalized_fill", FILL)
    fills = fills.select(F.col("event_id").alias("fill_event_id"), F.col("sequence").alias("fill_sequence"), "source_trade_id", "ingest_id", "oside", "side", F.col("shares").cast(SHARES).alias("shares"), "epoch", "receive_epoch")
    uses = _market(payloads(log, "state_application", APPLICATION)).where("status = 'applied'").select("event_id", "sequence", "market_id", "fill_event_id")
    return uses.join(fills, "fill_event_id", "left").withColumn("found", F.coalesce(F.col("fill_sequence") < F.col("sequence"), F.lit(False)))


def last_poll(log: DataFrame, ticks: DataFrame, source: str) -> DataFrame:
    """(as_of_sequence, polled): the second of the last successful poll of the source known by each sequence; polls are ordered in blocks."""
    polls = payloads(log, "source_health", HEALTH).where((F.col("source") == source) & (F.col("status") == "poll_ok")).select("sequence", F.floor(F.col("created_ms") / 1000).alias("second"))
    block = F.floor(F.col("sequence") / BLOCK).alias("block")
    asked = ticks.select(F.col("as_of_sequence").alias("sequence")).distinct()
    rows = polls.select(block, "sequence", F.lit(0).alias("kind"), "second").unionByName(asked.select(block, "sequence", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("second")))
    inside = rows.withColumn("own", F.last("second", ignorenulls=True).over(Window.partitionBy("block").orderBy("sequence", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    blocks = rows.groupBy("block").agg(F.max_by("second", F.when(F.col("kind") == 0, F.col("sequence"))).alias("end"))  # a row for each 65536 sequences
    blocks = blocks.select(F.col("block").alias("__b"), F.last("end", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return inside.join(blocks, F.col("block") == F.col("__b")).select(F.col("sequence").alias("as_of_sequence"), F.coalesce("own", "before").alias("polled"))


def known_state(log: DataFrame, fills: DataFrame, ticks: DataFrame) -> DataFrame:
    """ticks + what the sequence alone decides: metadata, quarantine, inventory, last fills and provenance."""
    record = F.struct("eligible", "market_start", "active", "closed")
    meta = _market(payloads(log, "market_metadata", METADATA)).select("market_id", "sequence", record.alias("record"))
    stops = _market(payloads(log, "state_quarantine", "market_id string")).select("market_id", "sequence", F.lit(True).alias("stopped"))
    marked = _market(payloads(log, "state_application", APPLICATION)).where("quarantined").select("market_id", "sequence", F.lit(True).alias("stopped"))
    buys = fills.where("found AND side = 'BUY'").select("market_id", "sequence", "oside", "shares", "epoch", "receive_epoch", F.struct("epoch", "source_trade_id", "ingest_id").alias("fill_key"))
    asked = ticks.select("market_id", F.col("as_of_sequence").alias("sequence"), F.struct("event_id", "tick").alias("asked"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [meta, stops, marked, buys, asked])
    seen = Window.partitionBy("market_id").orderBy("sequence", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("decimal(28,8)")
    side = lambda s, c: F.when(F.col("oside") == s, F.col(c))
    values = {"record": F.last("record", ignorenulls=True), "quarantined": F.coalesce(F.max("stopped"), F.lit(False)), "applied_buy_fill_count": F.count("shares"), "max_source_epoch": F.max("epoch"), "max_receive_epoch": F.max("receive_epoch"), "key": F.max("fill_key")}
    values |= {f"q{s}": F.sum(side(s, "shares")) for s in ("UP", "DOWN")} | {f"t{s}": F.max(side(s, "epoch")) for s in ("UP", "DOWN")}
    over = {k: F.coalesce(F.max("stopped").over(seen), F.lit(False)) if k == "quarantined" else v.over(seen) for k, v in values.items()}
    rows = rows.select("market_id", F.col("sequence").alias("as_of_sequence"), "asked", *[c.alias(f"x_{k}") for k, c in over.items()]).where("asked IS NOT NULL")
    up, down, tick = F.coalesce("x_qUP", zero), F.coalesce("x_qDOWN", zero), F.col("asked.tick")
    return rows.select(
        "asked.event_id", "market_id", "as_of_sequence", "asked.tick", F.when(F.col("x_record.eligible"), F.col("x_record.market_start")).alias("market_start"),
        (F.coalesce(F.col("x_record.active"), F.lit(True)) & ~F.coalesce(F.col("x_record.closed"), F.lit(False))).alias("open"), F.col("x_quarantined").alias("quarantined"),
        up.alias("up_inventory"), down.alias("down_inventory"), F.least(up, down).alias("paired_inventory"), F.abs(up - down).alias("residual_inventory"), S.ratio(up - down, up + down).alias("inventory_imbalance"), F.least(up, down).alias("cumulative_paired_quantity"),
        S.seconds_since(tick, F.col("x_tUP")).alias("seconds_since_last_up_fill"), S.seconds_since(tick, F.col("x_tDOWN")).alias("seconds_since_last_down_fill"),
        F.col("x_applied_buy_fill_count").alias("applied_buy_fill_count"), F.col("x_max_source_epoch").alias("max_source_epoch"), F.col("x_max_receive_epoch").alias("max_receive_epoch"),
        F.when(F.col("x_key").isNotNull(), F.concat_ws("|", F.col("x_key.epoch").cast("string"), "x_key.source_trade_id", "x_key.ingest_id")).alias("max_fill_key"),
    )


def trailing(fills: DataFrame, ticks: DataFrame) -> DataFrame:
    """(event_id, fill_count_15s ... same_second_fill_count) of ticks that see a fill in their trailing windows."""
    longest = max(TRAILS)
    buys = fills.where("found AND side = 'BUY'").select("market_id", "sequence", "oside", "shares", "epoch", "source_trade_id", "ingest_id")
    # the seconds of a tick are listed, not those of a fill: ticks are the fewer
    asked = ticks.select("event_id", "market_id", "tick", "as_of_sequence", F.explode(F.sequence(F.col("tick") - longest, F.col("tick"))).alias("epoch"))
    seen = buys.join(asked, ["market_id", "epoch"]).where(F.col("sequence") <= F.col("as_of_sequence"))
    order = Window.partitionBy("event_id").orderBy("epoch", "source_trade_id", "ingest_id")
    seen = seen.withColumn("change", (F.lag("oside").over(order) != F.col("oside")).cast("int"))
    within = lambda s, c: F.when(F.col("epoch") >= F.col("tick") - s, c)
    counts = [F.count(within(s, F.lit(1))).alias(f"fill_count_{s}s") for s in TRAILS] + [F.sum(within(s, F.col("shares"))).alias(f"fill_qty_{s}s") for s in TRAILS]
    return seen.groupBy("event_id").agg(*counts, F.coalesce(F.sum("change"), F.lit(0)).alias("side_switches_60s"), F.count(within(0, F.lit(1))).alias("same_second_fill_count"))


def candle_versions(log: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).cast("decimal(18,8)").alias(c)
    return payloads(log, "btc_candle", CANDLE).select("sequence", (F.col("open_epoch") + MINUTE).alias("close_epoch"), number("high"), number("low"), number("close"))


def last_candles(lookups: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, close_epoch, close): of each lookup (id, upto, as_of_sequence) the last candle closed by `upto`, in its latest version known.

    The minutes before `upto` are searched by equality, SEARCH of them at first and then, for those without a candle, as many times more, until
    the first candle of the log is passed.
    """
    bounds = versions.agg(F.min("close_epoch"), F.max("close_epoch")).first()
    empty = lookups.sparkSession.createDataFrame([], f"id {dict(lookups.dtypes)['id']}, close_epoch bigint, close decimal(18,8)")
    if bounds[0] is None:
        return empty
    # nothing closes after the last candle, and minutes start where the candles do
    left = written(lookups.withColumn("upto", F.least("upto", F.lit(bounds[1]))).withColumn("upto", F.col("upto") - F.pmod(F.col("upto") - bounds[0], F.lit(MINUTE))).where(F.col("upto") >= bounds[0]), "lookups")
    found, low, high, used = empty, 0, SEARCH, [left]
    while not left.isEmpty():
        first = F.greatest(F.col("upto") - (high - 1) * MINUTE, F.lit(bounds[0]))
        minutes = left.where(F.col("upto") - low * MINUTE >= bounds[0]).select("id", "as_of_sequence", F.explode(F.sequence(first, F.col("upto") - low * MINUTE, F.lit(MINUTE).cast("bigint"))).alias("close_epoch"))
        got = minutes.join(versions.select("close_epoch", "sequence", "close"), "close_epoch").where(F.col("sequence") <= F.col("as_of_sequence"))
        got = written(got.groupBy("id").agg(F.max(F.struct("close_epoch", "sequence", "close")).alias("x")).select("id", "x.close_epoch", "x.close"), "found")
        found = found.unionByName(got)
        left = written(left.join(got.select("id"), "id", "left_anti").where(F.col("upto") - (high - 1) * MINUTE > bounds[0]), "lookups")
        used.append(left)
        low, high = high, high * SEARCH
    for table in used:
        removed(table)
    return found


def candle_state(ticks: DataFrame, versions: DataFrame) -> DataFrame:
    """(event_id, btc columns) for ticks (event_id, tick, market_start, as_of_sequence) from the candle versions that each knows."""
    at = {"now": F.col("tick"), "c60": F.col("tick") - 60, "c120": F.col("tick") - 120, "start": F.col("market_start")}
    lookups = ticks.select("as_of_sequence", F.explode(F.array(*[F.struct(F.struct("event_id", F.lit(k).alias("what")).alias("id"), c.alias("upto")) for k, c in at.items()])).alias("x")).select("x.id", "x.upto", "as_of_sequence")
    found = last_candles(lookups, versions)
    pick = lambda k, c: F.max(F.when(F.col("id.what") == k, F.col(c)))
    prices = found.groupBy(F.col("id.event_id").alias("event_id")).agg(pick("now", "close_epoch").alias("btc_reference_epoch"), *[pick(k, "close").alias(k) for k in at])
    first, final = F.ceil(F.col("market_start") / MINUTE) * MINUTE, F.floor(F.col("tick") / MINUTE) * MINUTE
    minutes = ticks.where(first <= final).select("event_id", "as_of_sequence", F.explode(F.sequence(first, final, F.lit(MINUTE).cast("bigint"))).alias("close_epoch"))
    bars = minutes.join(versions, "close_epoch").where(F.col("sequence") <= F.col("as_of_sequence"))
    bars = bars.groupBy("event_id", "close_epoch").agg(F.max_by(F.struct("high", "low"), "sequence").alias("x")).groupBy("event_id").agg(F.max("x.high").alias("high"), F.min("x.low").alias("low"))
    now, start = F.col("now"), F.col("start")
    r60 = S.simple_return(now, F.col("c60"))
    values = {"btc_return_60s": r60, "btc_return_120s": S.simple_return(now, F.col("c120")), "btc_absolute_return_60s": F.abs(r60), "btc_return_since_market_start": S.simple_return(now, start), "btc_range_since_market_start": F.when(start != 0, S.ratio(F.col("high") - F.col("low"), start))}
    return prices.join(bars, "event_id", "left").select("event_id", "btc_reference_epoch", now.cast("double").alias("btc_reference_price"), *[c.alias(k) for k, c in values.items()])


def rebuilt_ticks(log: DataFrame, ticks: DataFrame, source: str = "target", hours: tuple[int, int] = (12, 18)) -> DataFrame:
    """(event_id, reason, FEATURES, PROVENANCE) of each tick (event_id, market_id, tick, as_of_sequence) from the log up to its sequence.

    reason: the first that keeps the tick from being scored, in the order of the live engine, else null.
    """
    ticks = _market(ticks.select("event_id", "market_id", "tick", "as_of_sequence"))
    fills = written(applied(log), "applied")
    state = written(known_state(log, fills, ticks).join(last_poll(log, ticks, source), "as_of_sequence", "left"), "state")
    elapsed = F.col("tick") - F.col("market_start")
    candles = candle_state(state.where("market_start IS NOT NULL").where((elapsed >= 0) & (elapsed < S.MARKET_SECONDS)), candle_versions(log))
    rows = state.join(trailing(fills, ticks), "event_id", "left").join(candles, "event_id", "left")
    rows = rows.fillna(0, [f"fill_count_{s}s" for s in TRAILS] + [f"fill_qty_{s}s" for s in TRAILS] + ["side_switches_60s", "same_second_fill_count"])
    hour = F.pmod(F.floor(F.col("tick") / 3600), F.lit(24))
    checks = [
        F.col("market_start").isNull(), (elapsed < 0) | (elapsed >= S.MARKET_SECONDS), (hour < hours[0]) | (hour >= hours[1]), ~F.col("open"), F.col("quarantined"),
        F.col("polled").isNull(), F.col("tick") - F.col("polled") > SOURCE_LIMIT, F.col("btc_reference_epoch").isNull(), F.col("tick") - F.col("btc_reference_epoch") > CANDLE_LIMIT,
    ]
    rows = rows.withColumn("reason", tick_reason(checks)).withColumn("elapsed_seconds", elapsed).withColumn("seconds_remaining", S.MARKET_SECONDS - elapsed)
    return rows.select("event_id", "reason", *[F.col(c).cast("double").alias(c) for c in FEATURES], *PROVENANCE)


# ---------------------------------------------------------------- audits


def _differs(a: Column, b: Column, tolerance: float | None = None) -> Column:
    same = a.eqNullSafe(b) if tolerance is None else F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) | (a.isNull() & b.isNull())
    return ~same


def _first(checks: list[tuple[Column, Column | str]]) -> Column:
    """The name of the first check that holds; a check that is null doesn't."""
    out = F.lit(None).cast("string")
    for check, name in reversed(checks):
        out = F.when(F.coalesce(check, F.lit(False)), F.lit(name) if isinstance(name, str) else name).otherwise(out)
    return out


def audit_ticks(log: DataFrame, tolerance: float = 1e-12, **options) -> DataFrame:
    """(event_id, kind, problem) of every feature snapshot and unscorable tick; problem is null where the replay agrees."""
    snapshots = payloads(log, "feature_snapshot", SNAPSHOT).withColumn("kind", F.lit("snapshot"))
    unscorable = payloads(log, "unscorable_tick", SNAPSHOT).withColumn("kind", F.lit("unscorable_tick"))
    recorded = snapshots.unionByName(unscorable)
    again = rebuilt_ticks(log, recorded, **options)
    again = again.select(F.col("event_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in again.columns if c != "event_id"])
    both = recorded.join(again, F.col("event_id") == F.col("__id"), "left")
    of = lambda c: F.try_element_at("features", F.lit(c))
    scored = F.col("kind") == "snapshot"
    checks = [
        (F.col("as_of_sequence").isNull() | (F.col("as_of_sequence") >= F.col("sequence")), "as_of_not_before_event"),
        (scored & F.col("__reason").isNotNull(), F.concat(F.lit("unscorable:"), F.col("__reason"))),
        (~scored & _differs(F.col("reason"), F.col("__reason")), "reason"),
        (scored & _differs(F.col("feature_order"), F.lit(list(FEATURES))), "feature_order"),
        *[(scored & (_differs(of(c), F.col(f"__{c}"), tolerance) | ~F.coalesce(F.map_contains_key("features", c), F.lit(False))), f"feature:{c}") for c in FEATURES],
        *[(scored & _differs(F.col(c), F.col(f"__{c}"), tolerance if c == "btc_reference_price" else None), f"provenance:{c}") for c in PROVENANCE],
    ]
    return both.select("event_id", "kind", _first(checks).alias("problem"))


def audit_predictions(log: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], tolerance: float = 1e-12) -> DataFrame:
    """(event_id, kind, problem) of every prediction, recomputed from the features of the snapshot that it names.

    models: by name, functions that add `predicted` and `probability` to rows of (event_id, FEATURES).
    """
    made = payloads(log, "prediction", PREDICTION)
    snapshots = payloads(log, "feature_snapshot", SNAPSHOT).select(F.col("event_id").alias("snapshot_event_id"), F.col("sequence").alias("__s"), F.lower("market_id").alias("__m"), "features")
    rows = made.join(snapshots, "snapshot_event_id", "left").withColumn("__there", F.col("__s").isNotNull())
    inputs = rows.where("__there").select("event_id", *[F.try_element_at("features", F.lit(c)).alias(c) for c in FEATURES])
    checks = [(~F.col("__there"), "snapshot_missing"), (F.col("__s") >= F.col("sequence"), "snapshot_not_prior"), (F.lower("market_id") != F.col("__m"), "snapshot_of_another_market")]
    for name, score in models.items():
        again = score(inputs).select(F.col("event_id").alias("__id"), F.col("predicted").alias(f"__p_{name}"), F.col("probability").alias(f"__b_{name}"))
        rows = rows.join(again, F.col("event_id") == F.col("__id"), "left").drop("__id")
        out = F.try_element_at("outputs", F.lit(name))
        checks += [(out.isNull(), f"output_missing:{name}"), (_differs(out["predicted"], F.col(f"__p_{name}"), tolerance), f"cost:{name}"), (_differs(out["probability"], F.col(f"__b_{name}"), tolerance), f"probability:{name}")]
    return rows.select("event_id", F.lit("prediction").alias("kind"), _first(checks).alias("problem"))


def audit_bindings(log: DataFrame) -> DataFrame:
    """(event_id, kind, problem) of every pair, by its label and binding, and of labels and bindings without a pair."""
    pairs = payloads(log, "pair_formation", PAIR)
    predictions = payloads(log, "prediction", PREDICTION).select(F.col("event_id").alias("prediction_id"), "market_id", "created_ms", "sequence", "candidate", "reconstructed")
    named = pairs.withColumnRenamed("event_id", "pair_id")
    expected = bind_strictly_prior(named, predictions).select("pair_id", F.col("prediction_id").alias("__prediction"), F.col("status").alias("__status"))
    expected = expected.join(outcome_labels(named).select("pair_id", F.col("pair_cost").alias("__cost"), F.col("favorable").alias("__favorable")), "pair_id").withColumn("__pair", F.lit(True))
    last = lambda df, *columns: df.groupBy(F.col("pair_event_id").alias("pair_id")).agg(F.max_by(F.struct(*columns), "sequence").alias(columns[0]), F.count("*").alias(f"n_{columns[0]}"))
    labels = last(payloads(log, "outcome_label", LABEL).where("pair_event_id IS NOT NULL"), "pair_cost", "favorable")
    bindings = last(payloads(log, "score_binding", BINDING).where("pair_event_id IS NOT NULL"), "prediction_event_id", "status")
    rows = expected.join(labels, "pair_id", "full").join(bindings, "pair_id", "full")
    checks = [
        (F.col("__pair").isNull(), "pair_missing"),
        (F.col("n_pair_cost").isNull(), "label_missing"), (F.col("n_pair_cost") > 1, "label_repeated"), (_differs(F.col("pair_cost.pair_cost"), F.col("__cost")), "label_cost"), (_differs(F.col("pair_cost.favorable"), F.col("__favorable")), "label_favorable"),
        (F.col("n_prediction_event_id").isNull(), "binding_missing"), (F.col("n_prediction_event_id") > 1, "binding_repeated"), (_differs(F.col("prediction_event_id.prediction_event_id"), F.col("__prediction")), "binding_prediction"), (_differs(F.col("prediction_event_id.status"), F.col("__status")), "binding_status"),
    ]
    return rows.select(F.col("pair_id").alias("event_id"), F.lit("pair").alias("kind"), _first(checks).alias("problem"))


def audit_applications(log: DataFrame) -> DataFrame:
    """(event_id, kind, problem) of every applied fill: it must be in the log before its application."""
    return applied(log).select("event_id", F.lit("application").alias("kind"), F.when(~F.col("found"), "fill_missing").alias("problem"))


def replay(log: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], tolerance: float = 1e-12, **options) -> DataFrame:
    """(event_id, kind, problem) of everything that can be rebuilt from the log; `problem` is null where record and replay agree."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    parts = [audit_applications(log), audit_ticks(log, tolerance, **options), audit_predictions(log, models, tolerance), audit_bindings(log)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def replay_summary(found: DataFrame) -> DataFrame:
    """(kind, events, problems, passed) of a replay."""
    return found.groupBy("kind").agg(F.count("*").alias("events"), F.count("problem").alias("problems"), (F.count("problem") == 0).alias("passed"))
