"""The registered queries: each applies one operator to the driver's tables. Rounding is for comparison only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators import binding, claims, evaluation, features, folds, forests, inventory, ledger, live, markets, matching, metrics, normalize, permutation, windows
from lotline.operators.ranges import numbered
from lotline.sources import adapter, eventlog
from lotline.sources.scratch import written
from lotline.streaming import state

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---------------------------------------------------------------- shared inputs


def bad_rows(spark: SparkSession) -> DataFrame:
    """Records that each fail in one way."""
    base = {"id": "", "proxyWallet": "acct-0", "conditionId": "m0", "asset": "m0-up", "side": "BUY", "outcome": "Up", "size": "1", "price": "0.5", "timestamp": "1600000000", "transactionHash": "t", "slug": "btc-updown-5m-0", "event_id": "-1"}
    cases = [{"outcome": ""}, {"side": "HOLD"}, {"price": "x"}, {"price": "1.5"}, {"price": "-0.1"}, {"size": "many"}, {"size": "0"}, {"size": "-2"}, {"timestamp": "1600000000.5"}, {"timestamp": "1500000000"}, {"timestamp": "3000000000"}, {"timestamp": "1600000000000", "id": "bad-ms"}, {"id": "bad-ms"}, {"proxyWallet": "", "size": ""}]
    names = list(base)
    return spark.createDataFrame([tuple((base | c)[n] for n in names) for c in cases], ", ".join(f"`{n}` string" for n in names)).withColumn("event_id", F.col("event_id").cast("bigint"))


def normalized(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    """Adapter fills as records; their compressed clock starts in 1970, so it is moved to 2020 for the plausibility check."""
    raw = adapter.raw_fills(spark, sf_dir).withColumn("timestamp", (F.col("timestamp").cast("bigint") + 1_577_836_800).cast("string"))
    raw = raw.unionByName(bad_rows(spark)) if bad else raw
    return normalize.normalize_records(raw)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted fills on the compressed clock."""
    good = normalize.accepted(normalized(spark, sf_dir))
    return good.withColumn("timestamp", F.timestamp_seconds(F.unix_seconds("timestamp") - 1_577_836_800))


def the_ledger(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    return ledger.canonical_ledger(fills(spark, sf_dir), numbered=numbered)


def buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.buys_of_clean_markets(the_ledger(spark, sf_dir))


def window_of(market: Column) -> Column:
    """Five days make a window."""
    return F.concat(F.lit("w"), F.floor(F.substring(market, 2, 20).cast("bigint") / 5).cast("string"))


def incomplete_markets(fills_: DataFrame) -> DataFrame:
    """Markets with complete history: all but every seventh day."""
    return fills_.select("market_id").distinct().where(F.substring("market_id", 2, 20).cast("bigint") % 7 != 3)


# ---------------------------------------------------------------- normalisation and ledger


@query
def normalize_accept_reject(spark, sf_dir):
    return normalized(spark, sf_dir, bad=True).groupBy("status").agg(F.count("*").alias("records"))


@query
def reject_reasons(spark, sf_dir):
    rows = normalized(spark, sf_dir, bad=True).where("status = 'rejected'")
    return rows.groupBy("reject_reason").agg(F.count("*").alias("records"))


@query
def validation_report(spark, sf_dir):
    out = normalize.validation_report(normalized(spark, sf_dir, bad=True))
    return out.select("total", "accepted", "invalid", "duplicates", F.unix_seconds("first_ts").alias("first_epoch"), F.unix_seconds("last_ts").alias("last_epoch"), "clean")


@query
def identity_hash(spark, sf_dir):
    r = adapter.raw_fills(spark, sf_dir)
    digest = S.identity_hash(account=F.col("proxyWallet"), asset=F.col("asset"), price=F.col("price"), side=F.col("side"), size=F.col("size"), timestamp=F.col("timestamp"), transaction_hash=F.col("transactionHash"))
    return r.select("event_id", digest.alias("identity_hash"))


@query
def market_eligibility(spark, sf_dir):
    f = fills(spark, sf_dir)
    return ledger.classify_markets(f, incomplete_markets(f))


@query
def canonical_ledger(spark, sf_dir):
    out = the_ledger(spark, sf_dir, numbered=True)
    return out.select("source_trade_id", "market_id", "epoch", F.col("seq").cast("bigint").alias("market_seq"), F.col("fill_sequence_number").alias("fill_seq"), "oside", r6("notional").alias("notional"))


@query
def inventory_running(spark, sf_dir):
    out = inventory.running_inventory(the_ledger(spark, sf_dir))
    return out.select("source_trade_id", r6("up_net").alias("up_net"), r6("down_net").alias("down_net"), r6("paired_shares").alias("paired_shares"), r6("directional_shares").alias("directional_shares"), "directional_side", r6("oversold_by").alias("oversold_by"))


@query
def pair_flow(spark, sf_dir):
    return rounded(inventory.pair_flow(inventory.running_inventory(the_ledger(spark, sf_dir))), "formation_flow", "ending_paired")


@query
def market_summary(spark, sf_dir):
    out = inventory.market_summaries(the_ledger(spark, sf_dir)).withColumn("warnings", F.size("warnings").cast("bigint"))
    return rounded(out, "buy_notional", "sell_notional", "ending_up", "ending_down", "ending_paired", "ending_directional", "max_paired")


@query
def exposure_by_market(spark, sf_dir):
    out = inventory.exposure(inventory.running_inventory(the_ledger(spark, sf_dir)), ["market_id"])
    return rounded(out, "paired_event_ratio", "directional_event_ratio", "paired_end_ratio", "directional_end_ratio")


@query
def trading_activity(spark, sf_dir):
    return rounded(inventory.trading_activity(fills(spark, sf_dir)), "fills_per_active_hour", "average_notional")


@query
def average_buy_cost(spark, sf_dir):
    out = inventory.buy_average_costs(buys(spark, sf_dir))
    return out.select("source_trade_id", r6("up_avg_cost").alias("up_avg_cost"), r6("down_avg_cost").alias("down_avg_cost"))


@query
def sell_aware_avg_cost(spark, sf_dir):
    out = inventory.moving_average_costs(the_ledger(spark, sf_dir))
    return rounded(out, "up_net", "down_net", "up_cost", "down_cost")


@query
def fifo_residual_cost(spark, sf_dir):
    return rounded(inventory.fifo_residual_costs(the_ledger(spark, sf_dir)), "held", "cost")


@query
def pair_accounting(spark, sf_dir):
    out = inventory.pair_accounting(the_ledger(spark, sf_dir))
    return rounded(out, "formation_flow", "ending_paired", "weighted_pair_cost", "fifo_pair_cost", "gross_edge")


@query
def claims_table(spark, sf_dir):
    led = the_ledger(spark, sf_dir)
    per_market = inventory.pair_accounting(led).join(led.groupBy("market_id").agg(F.bool_and("eligible_binary_market").alias("history_complete")), "market_id")
    out = claims.claim_results(inventory.trading_activity(fills(spark, sf_dir)), inventory.exposure(inventory.running_inventory(led)), claims.average_pair_cost(per_market))
    return out.select("claim", r6("measured").alias("measured"), "status")


@query
def contained_markets(spark, sf_dir):
    f = fills(spark, sf_dir)
    span = f.agg((F.min(F.unix_seconds("timestamp")) + 300).alias("a"), (F.max(F.unix_seconds("timestamp")) - 300).alias("b")).first()
    return ledger.contained_markets(f, span["a"], span["b"])


# ---------------------------------------------------------------- matching


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("market_id", F.col("completing_seq").cast("bigint").alias("completing_seq"), F.col("lot_seq").cast("bigint").alias("lot_seq"), r6("paired_shares").alias("paired_shares"), r6("pair_cost").alias("pair_cost"), "lag_seconds")


@query
def fifo_pairs(spark, sf_dir):
    p = matching.fifo_pairs(buys(spark, sf_dir))
    return _pairs(p).withColumn("lag_seconds", F.col("lag_seconds"))


@query
def fifo_pairs_price_asc(spark, sf_dir):
    return _pairs(matching.fifo_pairs(buys(spark, sf_dir), "price_asc"))


@query
def fifo_pairs_price_desc(spark, sf_dir):
    return _pairs(matching.fifo_pairs(buys(spark, sf_dir), "price_desc"))


def _lifo(pairs):
    p = pairs.groupBy("market_id", "completing_seq", "lot_seq").agg(F.sum("paired_shares").alias("paired_shares"))
    return p.select("market_id", F.col("completing_seq").cast("bigint").alias("completing_seq"), F.col("lot_seq").cast("bigint").alias("lot_seq"), r6("paired_shares").alias("paired_shares"))


@query
def lifo_pairs(spark, sf_dir):
    return _lifo(matching.lifo_pairs(buys(spark, sf_dir)))


@query
def lifo_pairs_by_levels(spark, sf_dir):
    return _lifo(matching.lifo_pairs_by_levels(buys(spark, sf_dir)))


@query
def wavg_pairs(spark, sf_dir):
    p = matching.weighted_average_pairs(buys(spark, sf_dir))
    return p.select("market_id", F.col("completing_seq").cast("bigint").alias("completing_seq"), r6("paired_shares").alias("paired_shares"), r6("pair_cost").alias("pair_cost"), "lag_seconds")


@query
def method_summary(spark, sf_dir):
    return rounded(metrics.event_summary(matching.pair_events_by_method(buys(spark, sf_dir)), ["method"]), "paired_shares", "weighted_cost", "below_one_share")


@query
def chronological_summary(spark, sf_dir):
    out = metrics.chronological_summary(matching.fifo_pairs(buys(spark, sf_dir)), the_ledger(spark, sf_dir))
    return rounded(out, "paired_shares", "weighted_cost", "below_one_share", "zero_lag_share", "gross_edge")


def _buckets(df: DataFrame) -> DataFrame:
    return df.select("label", "events", r6("paired_shares").alias("paired_shares"), r6("weighted_cost").alias("weighted_cost"), r6("below_one_share").alias("below_one_share"), r6("share_of_total").alias("share_of_total"))


@query
def fifo_latency_buckets(spark, sf_dir):
    return _buckets(metrics.latency_metrics(matching.fifo_pairs(buys(spark, sf_dir))))


@query
def fifo_market_time_buckets(spark, sf_dir):
    return _buckets(metrics.market_time_metrics(matching.fifo_pairs(buys(spark, sf_dir))))


@query
def fifo_market_time_bands(spark, sf_dir):
    return _buckets(metrics.market_band_metrics(matching.fifo_pairs(buys(spark, sf_dir))))


@query
def per_market_methods(spark, sf_dir):
    out = metrics.per_market_methods(matching.pair_events_by_method(buys(spark, sf_dir)))
    names = [f"{m}_{c}" for m in ("fifo", "lifo", "weighted_average") for c in ("paired_shares", "weighted_cost")]
    return rounded(out.drop("slug"), *names)


@query
def cost_distribution(spark, sf_dir):
    per = metrics.event_summary(matching.fifo_pairs(buys(spark, sf_dir)), ["market_id"])
    return rounded(metrics.distribution(per, F.col("weighted_cost")), "mean", "median", "p10", "p25", "p75", "p90", "least", "most")


@query
def tx_hash_diagnostic(spark, sf_dir):
    return rounded(metrics.transaction_diagnostic(buys(spark, sf_dir)), "mean_fills", "paired_shares", "weighted_cost")


# ---------------------------------------------------------------- windows


def _window_rows(spark, sf_dir) -> DataFrame:
    f = fills(spark, sf_dir)
    pairs = matching.fifo_pairs(buys(spark, sf_dir))
    every = f.select(window_of(F.col("market_id")).alias("window_id"), F.unix_seconds("timestamp").alias("e")).groupBy("window_id").agg(F.min("e").alias("start_epoch"))
    return metrics.with_windows(every, metrics.window_metrics(pairs, window_of(F.col("market_id"))))


@query
def hypothesis_summary(spark, sf_dir):
    out = metrics.hypothesis_summary(_window_rows(spark, sf_dir))
    return rounded(out, "pooled", "equal_mean", "median", "p25", "p75", "least", "most", "below_one_fraction")


@query
def leave_one_out(spark, sf_dir):
    return rounded(metrics.leave_one_out(metrics.adequate(_window_rows(spark, sf_dir))), "pooled_without")


@query
def cumulative_pooled(spark, sf_dir):
    return rounded(metrics.cumulative(metrics.adequate(_window_rows(spark, sf_dir))), "cumulative_shares", "cumulative_cost")


@query
def collection_windows(spark, sf_dir):
    e = adapter.events(spark, sf_dir).agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).first()
    return windows.generate_windows(spark, e["a"], e["b"], 1000)


@query
def window_subdivision(spark, sf_dir):
    e = adapter.events(spark, sf_dir)
    span = e.agg(F.min("epoch").alias("a"), (F.max("epoch") + 1).alias("b"), F.count("*").alias("n")).first()
    return windows.subdivide(e.select("epoch"), span["a"], span["b"], span["n"] // 5, 300)


@query
def window_completeness(spark, sf_dir):
    e = adapter.events(spark, sf_dir).groupBy(F.floor(F.col("day") / 5).alias("window_start")).agg(F.count("*").alias("records"))
    limit = F.lit(0) + F.avg("records").over(Window.partitionBy())
    rows = e.select("window_start", (F.col("window_start") + 1).alias("window_end"), (F.col("records") > limit).alias("ceiling_hit"), (F.col("window_start") % 2 == 0).alias("exhausted"))
    return windows.completeness(rows).withColumn("unresolved_windows", F.size("unresolved_windows").cast("bigint"))


@query
def dedup_first_wins(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = normalize.first_wins(rows, ["l_orderkey", "l_linenumber"], order)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query
def upsert_new_rows(spark, sf_dir):
    from lotline.sources.raw import upsert_fills

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey")
    return upsert_fills(rows.where("l_orderkey % 3 = 0"), rows, "l_orderkey", ["l_partkey", "l_suppkey"])


# ---------------------------------------------------------------- candles and features


@query
def candles_ohlc(spark, sf_dir):
    return rounded(adapter.candles(spark, sf_dir), "open", "high", "low", "close")


BTC_COLUMNS = ["btc_reference_price", "btc_return_60s", "btc_return_120s", "btc_absolute_return_60s", "btc_return_since_market_start", "btc_range_since_market_start"]


@query
def btc_asof_features(spark, sf_dir):
    e = adapter.events(spark, sf_dir)
    moments = e.select(F.col("epoch").alias("event_epoch"), (F.col("day") * 300).alias("market_start")).distinct()
    out = features.candle_features(moments, adapter.candles(spark, sf_dir))
    return rounded(out.select("event_epoch", "market_start", "btc_reference_epoch", *BTC_COLUMNS), *BTC_COLUMNS)


QUANTITIES = ["up_inventory", "down_inventory", "paired_inventory", "residual_inventory", "inventory_imbalance", "fill_qty_15s", "fill_qty_30s", "fill_qty_60s"]
COUNTS = ["fill_count_15s", "fill_count_30s", "fill_count_60s", "side_switches_60s", "same_second_fill_count", "seconds_since_last_up_fill", "seconds_since_last_down_fill"]


@query
def pre_event_panel(spark, sf_dir):
    out = features.pre_event_panel(buys(spark, sf_dir), adapter.candles(spark, sf_dir), window_of(F.col("market_id")))
    rows = out.select("window_id", "market_id", F.col("prediction_fill_sequence").cast("bigint").alias("prediction_fill_sequence"), F.col("target_event_index").cast("bigint").alias("target_event_index"), "paired_shares", "pair_cost", "favorable", "lag_seconds_label_only", *QUANTITIES, *[F.col(c).cast("bigint").alias(c) for c in COUNTS], F.col("max_prior_fill_sequence").cast("bigint").alias("max_prior_fill_sequence"), "btc_return_60s")
    return rounded(rows, "paired_shares", "pair_cost", *QUANTITIES, "btc_return_60s")


@query
def regime_panel(spark, sf_dir):
    out = features.regime_panel(buys(spark, sf_dir))
    more = ["cumulative_up_vwap", "cumulative_down_vwap", "implied_complete_set_cost", "cumulative_paired_quantity"]
    rows = out.select("market_id", F.col("completing_seq").cast("bigint").alias("completing_seq"), F.col("event_index").cast("bigint").alias("event_index"), "favorable", "strong_favorable", *QUANTITIES, *more, *[F.col(c).cast("bigint").alias(c) for c in COUNTS])
    return rounded(rows, *QUANTITIES, *more)


@query
def leakage_audit(spark, sf_dir):
    out = features.leakage_audit(features.pre_event_panel(buys(spark, sf_dir), adapter.candles(spark, sf_dir), window_of(F.col("market_id"))))
    return out.withColumn("messages", F.size("messages").cast("bigint"))


@query
def panel_coverage(spark, sf_dir):
    out = features.panel_coverage(features.pre_event_panel(buys(spark, sf_dir), adapter.candles(spark, sf_dir), window_of(F.col("market_id"))), ["window_id"])
    return rounded(out, "favorable_ratio", *[f"known_{c}" for c in features.BTC])


# ---------------------------------------------------------------- evaluation


def _panel(spark, sf_dir) -> DataFrame:
    """Pairs with window and label, written once: evaluations read them many times."""
    p = matching.fifo_pairs(buys(spark, sf_dir))
    return written(p.withColumn("window_id", window_of(F.col("market_id"))).withColumn("favorable", F.col("pair_cost") < 1), "pairs")


@query
def lowo_global_mean(spark, sf_dir):
    rows = evaluation.global_mean_predictions(_panel(spark, sf_dir))
    return rounded(metrics.regression_metrics(rows, ["window_id"]), "weighted_mae", "mae", "weighted_bias")


@query
def lowo_timing_bucket(spark, sf_dir):
    rows = evaluation.timing_bucket_predictions(_panel(spark, sf_dir))
    return rounded(metrics.regression_metrics(rows, ["window_id"]), "weighted_mae", "mae", "weighted_bias")


@query
def brier_logloss(spark, sf_dir):
    rows = evaluation.timing_bucket_predictions(_panel(spark, sf_dir))
    out = metrics.classification_metrics(rows, ["window_id"]).join(metrics.plain_scores(rows, ["window_id"]), "window_id")
    return rounded(out, "weighted_brier", "weighted_log_loss", "brier", "log_loss")


def _fold_scores(spark, sf_dir) -> DataFrame:
    p = _panel(spark, sf_dir)
    a = metrics.regression_metrics(evaluation.global_mean_predictions(p), ["window_id"]).withColumn("model", F.lit("global_mean"))
    b = metrics.regression_metrics(evaluation.timing_bucket_predictions(p), ["window_id"]).withColumn("model", F.lit("timing_bucket"))
    weight = p.groupBy("window_id").agg(F.sum(F.col("paired_shares").cast("double")).alias("weight"))
    return a.unionByName(b).join(weight, "window_id")


@query
def fold_summary(spark, sf_dir):
    out = metrics.fold_summary(_fold_scores(spark, sf_dir), ["weighted_mae", "mae"], "global_mean")
    return rounded(out, "mean_weighted_mae", "mean_mae", "delta_weighted_mae", "delta_mae")


@query
def pooled_models(spark, sf_dir):
    return rounded(evaluation.pooled(_fold_scores(spark, sf_dir), ["weighted_mae", "mae"]), "weighted_mae", "mae")


@query
def advancement_gate(spark, sf_dir):
    return metrics.advancement(_fold_scores(spark, sf_dir), "timing_bucket", "global_mean", ["weighted_mae", "mae"], 4, 7)


# ---------------------------------------------------------------- event log, binding, report


def _predictions(spark, sf_dir) -> DataFrame:
    """A synthetic prediction for each market and ten seconds with a fill; every eleventh is a reconstruction. Written once, as are the pairs: binding reads both many times."""
    b = buys(spark, sf_dir)
    t = (F.floor(F.col("epoch") / 10) * 10).alias("tick")
    rows = b.groupBy("market_id", t).agg(F.count("*").alias("n"), F.avg(F.col("price").cast("double")).alias("mean_price"))
    number = F.row_number().over(Window.partitionBy("market_id").orderBy("tick"))
    rows = rows.withColumn("number", number)
    rows = rows.select(F.concat_ws(":", F.lit("p"), "market_id", F.col("tick").cast("string")).alias("prediction_id"), F.upper("market_id").alias("market_id"), (F.col("tick") * 1000 + F.col("n") % 7 * 100).alias("created_ms"), (F.col("tick") * 1000).alias("sequence"), F.lit(True).alias("candidate"), (F.col("number") % 11 == 0).alias("reconstructed"), (F.col("mean_price") * 2).alias("predicted_pair_cost"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.5 - F.col("mean_price"))).alias("probability"))
    return written(rows, "predictions")


def _log_pairs(spark, sf_dir) -> DataFrame:
    p = matching.fifo_pairs(buys(spark, sf_dir))
    pair_id = F.concat_ws(":", "market_id", F.col("completing_seq").cast("string"), F.col("event_index").cast("string"))
    return written(p.select(pair_id.alias("pair_id"), "market_id", "formed_at_epoch", (F.col("formed_at_epoch") * 1000 + 500).alias("sequence"), "pair_cost", "paired_shares"), "log-pairs")


@query
def strict_prior_binding(spark, sf_dir):
    return binding.bind_strictly_prior(_log_pairs(spark, sf_dir), _predictions(spark, sf_dir)).select("pair_id", "prediction_id", "prediction_ms", "status")


@query
def binding_coverage(spark, sf_dir):
    pairs = _log_pairs(spark, sf_dir)
    bound = binding.bind_strictly_prior(pairs, _predictions(spark, sf_dir))
    return binding.coverage_gaps(pairs, bound.where("status LIKE 'bound%'"))


def _scored(spark, sf_dir) -> DataFrame:
    made = _predictions(spark, sf_dir)
    bound = binding.bind_strictly_prior(_log_pairs(spark, sf_dir), made).where("status LIKE 'bound%'")
    rows = bound.join(made.select("prediction_id", "predicted_pair_cost", "probability"), "prediction_id").withColumn("favorable", F.col("pair_cost") < 1)
    return rows.withColumn("model", F.lit("linear")).unionByName(rows.withColumn("model", F.lit("flat")).withColumn("probability", F.lit(0.5)))


@query
def calibration_bins(spark, sf_dir):
    return rounded(binding.prospective_calibration(_scored(spark, sf_dir)), "weight", "mean_probability", "favorable_rate")


@query
def prospective_metrics(spark, sf_dir):
    return rounded(binding.prospective_metrics(_scored(spark, sf_dir)), "weight", "weighted_mae", "weighted_brier")


@query
def prospective_report(spark, sf_dir):
    bound = binding.bind_strictly_prior(_log_pairs(spark, sf_dir), _predictions(spark, sf_dir))
    return rounded(binding.prospective_summary(bound, 15, least_bound=1000, least_reportable=1, least_rows_a_day=50), "bound_shares", "coverage")


def _log(spark, sf_dir) -> DataFrame:
    """A synthetic log with a gap at every 97th event and a wrong id at every 101st."""
    e = adapter.events(spark, sf_dir)
    run = F.concat(F.lit("run"), (F.col("day") % 3).cast("string"))
    rows = numbered(e.withColumn("r", F.col("day") % 3), "r", "event_id", "n").withColumn("n", F.col("n") - 1)
    rows = rows.select(run.alias("run_id"), F.col("event_id").alias("line"), "n", "event_type", (F.col("epoch") * 1000).alias("created_ms"), F.concat(F.lit("source"), (F.col("k") % 4).cast("string")).alias("source"), F.when(F.col("k") % 10 == 0, "error").otherwise("ok").alias("status"))
    rows = rows.withColumn("sequence", F.col("n") + F.floor(F.col("n") / 97))
    return rows.withColumn("event_id", F.concat_ws(":", "run_id", F.when(F.col("n") % 101 == 100, F.lit("x")).otherwise(F.col("sequence").cast("string")))).drop("n")


@query
def log_integrity(spark, sf_dir):
    return eventlog.integrity(_log(spark, sf_dir))


@query
def log_event_counts(spark, sf_dir):
    return eventlog.event_counts(_log(spark, sf_dir))


@query
def source_health(spark, sf_dir):
    rows = _log(spark, sf_dir).withColumn("sequence", F.col("line"))
    return eventlog.source_health(rows)


@query
def log_monitor(spark, sf_dir):
    rows = _log(spark, sf_dir)
    now = rows.agg(F.max("created_ms")).first()[0] + 12_000
    return eventlog.monitor(rows, now)


@query
def candle_revisions(spark, sf_dir):
    e = adapter.events(spark, sf_dir)
    rows = e.select((F.floor(F.col("epoch") / 60) * 60).alias("open_epoch"), F.col("event_id").alias("sequence"), S.candle_fingerprint(F.floor(F.col("epoch") / 60) * 60, F.floor(F.col("k") / 25)).alias("fingerprint"))
    return eventlog.candle_revisions(rows)


def _lookups(spark, sf_dir) -> DataFrame:
    """A lookup record for each market, with defects by day."""
    d = adapter.events(spark, sf_dir).select("day").distinct()
    kind, day = F.col("day") % 6, F.col("day").cast("string")
    text = lambda a, b: F.concat(F.lit('["'), a, F.lit('","'), b, F.lit('"]'))
    return d.select(
        F.concat(F.lit("m"), day).alias("market_id"), F.when(kind == 1, "other-market").otherwise(F.concat(F.lit("btc-updown-5m-"), (F.col("day") * 300).cast("string"))).alias("slug"),
        F.when(kind == 2, "no array").when(kind == 3, '["Up"]').when(kind == 4, '["Yes","No"]').otherwise('["Up","Down"]').alias("outcomes"),
        F.when(kind == 5, text(F.lit("t"), F.lit("t"))).otherwise(text(F.concat(F.lit("u"), day), F.concat(F.lit("d"), day))).alias("clobTokenIds"), F.col("day").alias("sequence"),
    )


@query
def market_metadata_classify(spark, sf_dir):
    out = markets.classify_lookup(_lookups(spark, sf_dir))
    up = F.when(markets.side_of_token(F.col("token_sides"), F.concat(F.lit("u"), F.substring("market_id", 2, 20))) == "UP", 1).otherwise(0)
    return out.select("market_id", "eligible", "reason_code", "market_start", up.cast("bigint").alias("up_token_found"))


@query
def active_markets(spark, sf_dir):
    meta = markets.classify_lookup(_lookups(spark, sf_dir))
    ticks = adapter.events(spark, sf_dir).select((F.col("day") * 300 + 17).alias("tick")).distinct()
    return markets.active_markets_at(meta, ticks)


@query
def tick_features(spark, sf_dir):
    b = the_ledger(spark, sf_dir)
    ticks = b.groupBy("market_id").agg((F.min("epoch") + 120).alias("tick"))
    out = live.tick_states(ticks, b, as_of=False).select("market_id", "tick", *QUANTITIES, *[F.col(c).cast("bigint").alias(c) for c in COUNTS])
    return rounded(out, *QUANTITIES)


@query
def online_state(spark, sf_dir):
    rows = the_ledger(spark, sf_dir).withColumn("arrival", F.col("seq").cast("bigint"))
    out = state.apply_batch(rows).groupBy("market_id", "kind").agg(F.count("*").alias("rows"), F.sum("paired_shares").alias("paired_shares"), F.max("reason").alias("reason"))
    return rounded(out, "paired_shares")


@query
def online_pairs(spark, sf_dir):
    rows = buys(spark, sf_dir).withColumn("arrival", F.col("seq").cast("bigint"))
    out = state.apply_batch(rows).where("kind = 'pair'")
    return rounded(out.select("market_id", "source_trade_id", F.col("pair_index").cast("bigint").alias("pair_index"), "paired_shares", "pair_cost", "lag_seconds"), "paired_shares", "pair_cost")


# ---------------------------------------------------------------- models


def _model_rows(spark, sf_dir) -> DataFrame:
    """Pairs with the state at the end of their second and reference candles: all inputs of the models."""
    # fills, buys, pairs and candles are each read by several branches, so they are written once; the models read no transactions
    kept = written(fills(spark, sf_dir).select("market_id", "slug", "timestamp", "source_trade_id", F.lit(None).cast("string").alias("transaction_hash"), "outcome", "side", "price", "shares"), "fills")
    bought = written(ledger.buys_of_clean_markets(ledger.canonical_ledger(kept)).select("market_id", "slug", "epoch", "seq", "oside", "price", "shares", F.lit(None).cast("string").alias("source_trade_id"), "transaction_hash"), "buys")
    rows = features.regime_panel(bought, written(adapter.candles(spark, sf_dir), "candles"), written(matching.fifo_pairs(bought), "pairs"))
    return rows.withColumn("window_id", window_of(F.col("market_id")))


_SCORES = ("weighted_mae", "mae", "weighted_bias", "weighted_brier", "weighted_log_loss")


def _scores(panel: folds.Panel, models_: dict) -> DataFrame:
    out = written(folds.fold_metrics(folds.scored(panel, models_)), "scores")
    panel.close()
    return rounded(out, "weight", *_SCORES)


@query
def ridge_eval(spark, sf_dir):
    """Ridge and logistic regression on the seven feature sets: each window by models of the others."""
    panel = folds.prepare(_model_rows(spark, sf_dir), features.FEATURE_SETS["all"])
    return _scores(panel, folds.linear_models(folds.fit_linear(panel, features.FEATURE_SETS)))


@query
def tree_eval(spark, sf_dir):
    """One tree on timing and inventory: each window by a tree of the others."""
    panel = folds.prepare(_model_rows(spark, sf_dir), features.FEATURE_SETS["timing_inventory"])
    return _scores(panel, forests.forest_models(forests.fit_forests(panel, {"tree_timing_inventory": forests.single_tree(panel.features)}, folds=list(range(len(panel.windows))))))


@query
def gbt_eval(spark, sf_dir):
    """Boosted trees on three feature sets: each window by a model of the others."""
    panel = folds.prepare(_model_rows(spark, sf_dir), features.FEATURE_SETS["all"])
    specs = {f"hgb_{name}": forests.Spec(features.FEATURE_SETS[name]) for name in ("timing_inventory", "inventory", "all")}
    return _scores(panel, forests.forest_models(forests.fit_forests(panel, specs, folds=list(range(len(panel.windows))))))


@query
def btc_permutation(spark, sf_dir):
    """By how much the errors of boosted trees on all inputs grow when candle inputs are exchanged within the held-out window."""
    groups = permutation.each_and_joint(features.BTC, "btc_joint")
    out = permutation.held_out_permutations(_model_rows(spark, sf_dir), forests.Spec(features.FEATURE_SETS["all"]), groups, ["market_id", "completing_seq", "event_index"])
    return rounded(out, "weighted_mae_delta", "weighted_brier_delta")
