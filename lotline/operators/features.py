"""Causal features of pair events: trailing activity, inventory and reference candles.

Everything is a window over one shuffle by market, or an equality join; nothing looks past its moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.matching import fifo_pairs
from lotline.operators.ranges import span, with_sums_before

TRAILS = (15, 30, 60)
# Names and order of the model inputs.
TIMING = ("lag_seconds", "elapsed_seconds", "seconds_remaining")
INVENTORY = ("up_inventory", "down_inventory", "paired_inventory", "residual_inventory", "inventory_imbalance", "seconds_since_last_up_fill", "seconds_since_last_down_fill", "fill_count_15s", "fill_count_30s", "fill_count_60s", "fill_qty_15s", "fill_qty_30s", "fill_qty_60s", "side_switches_60s", "cumulative_paired_quantity", "same_second_fill_count")
BTC = ("btc_return_60s", "btc_return_120s", "btc_absolute_return_60s", "btc_return_since_market_start", "btc_range_since_market_start")
FEATURE_SETS = {"timing": TIMING, "inventory": INVENTORY, "btc": BTC, "timing_inventory": TIMING + INVENTORY, "timing_btc": TIMING + BTC, "inventory_btc": INVENTORY + BTC, "all": TIMING + INVENTORY + BTC}
#: Model inputs known before the event: no lag.
PRE_EVENT_FEATURES = TIMING[1:] + INVENTORY + BTC


def _held(up: Column, down: Column) -> dict[str, Column]:
    return {"up_inventory": up, "down_inventory": down, "paired_inventory": F.least(up, down), "residual_inventory": F.abs(up - down), "inventory_imbalance": S.ratio(up - down, up + down)}


def fill_states(buys: DataFrame) -> DataFrame:
    """State strictly before each fill (columns of the pre-event panel)."""
    rows = buys
    order = Window.partitionBy("market_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    second = Window.partitionBy("market_id", "epoch")
    in_second = second.orderBy("seq")
    zero = F.lit(0).cast("decimal(28,8)")
    side = lambda s, x: F.when(F.col("oside") == s, x)
    rows = rows.withColumn("__up", F.coalesce(F.sum(side("UP", F.col("shares"))).over(before), zero)).withColumn("__down", F.coalesce(F.sum(side("DOWN", F.col("shares"))).over(before), zero))
    rows = rows.withColumn("__n", F.row_number().over(in_second)).withColumn("__change", (F.lag("oside").over(order) != F.col("oside")).cast("int"))
    rows = rows.withColumn("__switches", F.coalesce(F.sum("__change").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    # what stands in the second from this fill on is taken off the frame that ends with the second
    tail_n = F.count("*").over(second) - F.col("__n") + 1
    tail_q = F.sum("shares").over(second) - F.coalesce(F.sum("shares").over(in_second.rowsBetween(Window.unboundedPreceding, -1)), zero)
    by_time = lambda s: Window.partitionBy("market_id").orderBy("epoch").rangeBetween(-s, 0)
    for s in TRAILS:
        rows = rows.withColumn(f"fill_count_{s}s", F.count("*").over(by_time(s)) - tail_n).withColumn(f"fill_qty_{s}s", F.sum("shares").over(by_time(s)) - tail_q)
    switches = F.greatest(F.lit(0), F.coalesce(F.lag("__switches").over(order), F.lit(0)) - F.min("__switches").over(by_time(60)))
    last = lambda s: S.seconds_since(F.col("epoch"), F.max(side(s, F.col("epoch"))).over(before))
    elapsed = F.col("epoch") - S.market_start(F.col("slug"))
    for name, c in (_held(F.col("__up"), F.col("__down")) | {"seconds_since_last_up_fill": last("UP"), "seconds_since_last_down_fill": last("DOWN"), "side_switches_60s": switches, "cumulative_paired_quantity": F.least("__up", "__down"), "same_second_fill_count": F.col("__n") - 1, "max_prior_fill_sequence": F.when(F.lag("epoch").over(order) >= F.col("epoch") - 120, F.lag("seq").over(order)), "elapsed_seconds": elapsed, "seconds_remaining": 300 - elapsed}).items():
        rows = rows.withColumn(name, c)
    return rows.drop("__up", "__down", "__n", "__change", "__switches")


# ---------------------------------------------------------------- candles


LOOKBACKS = (15, 30, 60, 120)


def candle_grid(candles: DataFrame, interval: int) -> DataFrame:
    """(grid_epoch, reference_epoch, close, close_15 ... close_120): for every multiple of the interval the close last seen by then and before.

    The grid goes on for the longest look-back after the last candle; from there on nothing changes.
    The reference series is one small table of one instrument (half a million rows a year at a minute), so one window over it is enough.
    """
    step = F.lit(interval).cast("bigint")
    order = Window.partitionBy().orderBy("close_epoch")
    rows = candles.withColumn("close_epoch", F.col("open_epoch") + interval)
    until = F.coalesce(F.lead("close_epoch").over(order) - step, F.col("close_epoch") + max(LOOKBACKS))
    grid = rows.withColumn("__until", until).select(F.explode(F.sequence(F.col("close_epoch"), F.col("__until"), step)).alias("grid_epoch"), F.col("close_epoch").alias("reference_epoch"), "close")
    ordered = Window.partitionBy().orderBy("grid_epoch")
    back = [(F.lag("close", s // interval).over(ordered) if s >= interval else F.lit(None).cast("decimal(18,8)")).alias(f"close_{s}") for s in LOOKBACKS]
    return grid.select("*", *back)


def candle_features(moments: DataFrame, candles: DataFrame, interval: int = 60) -> DataFrame:
    """moments (event_epoch, market_start) + btc columns, from candles closed at or before the event only."""
    grid = candle_grid(candles, interval)
    last = candles.agg((F.max("open_epoch") + interval + max(LOOKBACKS)).alias("__end"))
    keys = moments.select("event_epoch", "market_start").distinct()
    t, start = F.col("event_epoch"), F.col("market_start")
    at = lambda c: F.least(F.floor(c / interval) * interval, F.col("__end"))
    rows = keys.crossJoin(F.broadcast(last)).withColumn("__t", at(t)).withColumn("__s", at(start))  # one row
    now_cols = [F.col("reference_epoch").alias("reference_price_epoch"), F.col("close").alias("reference_price"), *[F.col(f"close_{s}").alias(f"__c{s}") for s in LOOKBACKS]]
    rows = rows.join(grid.select(F.col("grid_epoch").alias("__t"), *now_cols), "__t", "left").join(grid.select(F.col("grid_epoch").alias("__s"), F.col("close").alias("__start")), "__s", "left").drop("__t", "__s", "__end")
    # candles between the market's start and the event, and of the last two minutes: a handful for each moment
    low = F.least(start, t - 120)
    first = F.ceil(F.coalesce(low, t - 120) / interval) * interval
    final = F.floor(t / interval) * interval
    spans = keys.where(first <= final).select("event_epoch", "market_start", F.explode(F.sequence(first, final, F.lit(interval).cast("bigint"))).alias("close_epoch"))
    bars = candles.withColumn("close_epoch", F.col("open_epoch") + F.col("interval_seconds"))
    seen = spans.join(bars, "close_epoch")
    inside = F.col("close_epoch") >= start
    closes = lambda s: F.array_sort(F.collect_list(F.when(F.col("close_epoch") > t - s, F.struct("close_epoch", F.col("close").cast("double").alias("c")))))
    agg = seen.groupBy("event_epoch", "market_start").agg(F.max(F.when(inside, F.col("high"))).alias("__high"), F.min(F.when(inside, F.col("low"))).alias("__low"), *[closes(s).alias(f"__v{s}") for s in (30, 60, 120)])
    agg = agg.withColumnsRenamed({"event_epoch": "__e", "market_start": "__m"})
    rows = rows.join(agg, (F.col("event_epoch") == F.col("__e")) & F.col("market_start").eqNullSafe(F.col("__m")), "left")
    now = F.col("reference_price")

    def vol(s: int) -> Column:
        if s < interval:
            return F.lit(None).cast("double")
        x = F.col(f"__v{s}.c")
        r = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.try_divide(F.get(x, i), F.get(x, i - 1)) - 1)
        mean = F.aggregate(r, F.lit(0.0), lambda a, b: a + b) / F.size(r)
        square = F.aggregate(r, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean))
        return F.when(F.size(x) >= 3, F.sqrt(square / (F.size(r) - 1)))

    r60 = S.simple_return(now, F.col("__c60"))
    swing = F.when(F.col("__start") != 0, S.ratio(F.col("__high") - F.col("__low"), F.col("__start")))
    return rows.select(
        "event_epoch", "market_start", F.col("reference_price_epoch").alias("btc_reference_epoch"), now.alias("btc_reference_price"), *[S.simple_return(now, F.col(f"__c{s}")).alias(f"btc_return_{s}s") for s in (15, 30, 60, 120)],
        *[vol(s).alias(f"btc_realized_vol_{s}s") for s in (30, 60, 120)], F.abs(r60).alias("btc_absolute_return_60s"), S.simple_return(now, F.col("__start")).alias("btc_return_since_market_start"), swing.alias("btc_range_since_market_start"),
    )


def with_candles(rows: DataFrame, candles: DataFrame, epoch: str = "formed_at_epoch", interval: int = 60, moments: DataFrame | None = None) -> DataFrame:
    """rows (with slug and an epoch column) + btc columns. moments: (epoch, slug) that hold those of the rows and are cheaper to read."""
    rows = rows.withColumn("__start", S.market_start(F.col("slug")))
    asked = rows.select(epoch, "slug") if moments is None else moments
    found = candle_features(asked.select(F.col(asked.columns[0]).alias("event_epoch"), S.market_start(F.col("slug")).alias("market_start")), candles, interval)
    return rows.join(found, (F.col(epoch) == F.col("event_epoch")) & F.col("__start").eqNullSafe(F.col("market_start")), "left").drop("event_epoch", "market_start", "__start")


# ---------------------------------------------------------------- panels


def pre_event_panel(buys: DataFrame, candles: DataFrame | None, window: Column) -> DataFrame:
    """A row for each FIFO pair with the state strictly before its completing fill; pair, cost and lag are labels only."""
    pairs = fifo_pairs(buys)
    states = fill_states(buys).select("market_id", F.col("seq").alias("completing_seq"), "max_prior_fill_sequence", "elapsed_seconds", "seconds_remaining", *INVENTORY)
    rows = pairs.drop("elapsed_seconds").join(states, ["market_id", "completing_seq"])
    # the state is taken once, before the fill, for all fragments of it
    rows = rows.withColumn("window_id", window).withColumn("favorable", F.col("pair_cost") < 1).withColumnRenamed("lag_seconds", "lag_seconds_label_only").withColumnRenamed("formed_at_epoch", "prediction_time_epoch").withColumnRenamed("completing_seq", "prediction_fill_sequence").withColumnRenamed("event_index", "target_event_index")
    return with_candles(rows, candles, "prediction_time_epoch") if candles is not None else rows


def second_states(buys: DataFrame) -> DataFrame:
    """State at the end of each second of a market, the whole second included; seq goes with the seconds.

    Fills become a row a second, and only these rows meet in a market's windows, however many fills it has.
    """
    zero = F.lit(0).cast("decimal(28,8)")
    side = lambda s, x: F.when(F.col("oside") == s, x)
    change = (F.lag("oside").over(Window.partitionBy("market_id", "epoch").orderBy("seq")) != F.col("oside")).cast("int")
    both = [c for s in ("UP", "DOWN") for c in (F.sum(side(s, F.col("shares"))).alias(f"__q{s}"), F.sum(side(s, F.col("shares") * F.col("price"))).alias(f"__v{s}"), F.max(side(s, F.col("epoch"))).alias(f"__t{s}"))]
    rows = buys.withColumn("__change", change).groupBy("market_id", "epoch").agg(F.count("*").alias("same_second_fill_count"), F.sum("shares").alias("__shares"), F.coalesce(F.sum("__change"), F.lit(0)).alias("__changes"), F.min_by("oside", "seq").alias("__first"), F.max_by("oside", "seq").alias("__last"), *both)
    by_time = lambda s: Window.partitionBy("market_id").orderBy("epoch").rangeBetween(Window.unboundedPreceding if s is None else -s, 0)
    # switches up to and with a second, and those up to its first fill
    border = (F.lag("__last").over(Window.partitionBy("market_id").orderBy("epoch")) != F.col("__first")).cast("int")
    rows = rows.withColumn("__border", F.coalesce(border, F.lit(0)))
    rows = rows.withColumn("__to", F.sum(F.col("__border") + F.col("__changes")).over(by_time(None))).withColumn("__from", F.col("__to") - F.col("__changes"))
    for s in ("UP", "DOWN"):
        rows = rows.withColumns({f"__q{s}": F.coalesce(F.sum(f"__q{s}").over(by_time(None)).cast("decimal(28,8)"), zero), f"__v{s}": F.sum(f"__v{s}").over(by_time(None)), f"__t{s}": F.max(f"__t{s}").over(by_time(None))})
    for s in TRAILS:
        rows = rows.withColumns({f"fill_count_{s}s": F.sum("same_second_fill_count").over(by_time(s)), f"fill_qty_{s}s": F.sum("__shares").over(by_time(s)).cast("decimal(28,8)")})
    rows = rows.withColumn("side_switches_60s", F.max("__to").over(by_time(60)) - F.min("__from").over(by_time(60)))
    vwap = {s: S.ratio(F.col(f"__v{s}"), F.col(f"__q{s}")) for s in ("UP", "DOWN")}
    cols = _held(F.col("__qUP"), F.col("__qDOWN")) | {"cumulative_up_vwap": vwap["UP"], "cumulative_down_vwap": vwap["DOWN"], "implied_complete_set_cost": vwap["UP"] + vwap["DOWN"], "seconds_since_last_up_fill": S.seconds_since(F.col("epoch"), F.col("__tUP")), "seconds_since_last_down_fill": S.seconds_since(F.col("epoch"), F.col("__tDOWN"))}
    return rows.select("market_id", "epoch", *[c.alias(n) for n, c in cols.items()], *[f"fill_{k}_{s}s" for s in TRAILS for k in ("count", "qty")], "side_switches_60s", "same_second_fill_count")


def regime_panel(buys: DataFrame, candles: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """A row for each FIFO pair with the state at the end of its second; the paired quantity includes this fragment. pairs: those of the buys, if they are known."""
    pairs = (fifo_pairs(buys) if pairs is None else pairs).withColumn("__span", span("formed_at_epoch"))
    running = Window.partitionBy("market_id", "__span").orderBy("formed_at_epoch", "completing_seq", "event_index").rowsBetween(Window.unboundedPreceding, 0)
    pairs = with_sums_before(pairs.withColumn("__own", F.sum("paired_shares").over(running)), "market_id", "__span", {"__before": F.col("paired_shares")})
    pairs = pairs.withColumn("cumulative_paired_quantity", (F.col("__own") + F.col("__before")).cast("decimal(28,8)")).drop("__span", "__own", "__before")
    rows = pairs.join(second_states(buys).withColumnRenamed("epoch", "formed_at_epoch"), ["market_id", "formed_at_epoch"])
    rows = rows.withColumn("favorable", F.col("pair_cost") < 1).withColumn("strong_favorable", F.col("pair_cost") <= F.lit("0.98").cast("decimal(12,8)")).withColumn("seconds_remaining", 300 - F.col("elapsed_seconds"))
    return with_candles(rows, candles, moments=buys.select("epoch", "slug")) if candles is not None else rows


def leakage_audit(panel: DataFrame, most: int = 100) -> DataFrame:
    """One row: violations of causality and the first messages."""
    late = F.col("max_prior_fill_sequence") >= F.col("prediction_fill_sequence")
    future = F.col("btc_reference_epoch") > F.col("prediction_time_epoch")
    message = F.when(late, F.concat_ws(":", F.lit("prior_sequence"), "market_id", "prediction_fill_sequence")).when(future, F.concat_ws(":", F.lit("future_candle"), "market_id", "prediction_fill_sequence"))
    some = panel.where(late | future).orderBy("market_id", "prediction_fill_sequence").limit(most).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return panel.agg(F.count("*").alias("rows"), F.count_if(late).alias("sequence_violations"), F.count_if(future).alias("candle_violations")).withColumn("passed", F.col("sequence_violations") + F.col("candle_violations") == 0).crossJoin(some)  # two single rows


def panel_coverage(panel: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, share of favourable rows, and of each btc column how much is known."""
    known = [F.avg(F.col(c).isNotNull().cast("int")).alias(f"known_{c}") for c in BTC if c in panel.columns]
    return panel.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.count_distinct("market_id").alias("markets"), F.avg(F.col("favorable").cast("int")).alias("favorable_ratio"), *known)
