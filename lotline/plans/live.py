"""Registered queries of the live engine, evaluation and sinks, each with its SQL for DuckDB beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators import binding, evaluation, features, folds, inventory, ledger, live, markets, matching, metrics, models, replay, windows
from lotline.operators.ranges import numbered
from lotline.plans import oracle as O
from lotline.plans import queries as Q
from lotline.sources import adapter, raw, sinks
from lotline.sources.scratch import written
from lotline.streaming import state

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        REGISTRY[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


r6 = Q.r6
rounded = Q.rounded

# ---------------------------------------------------------------- files


def _manifest(spark, sf_dir):
    e = adapter.events(spark, sf_dir)
    start, end = F.when(F.col("k") % 3 != 0, F.col("day") * 300), F.when((F.col("k") % 3 != 0) & (F.col("k") % 7 != 0), F.col("day") * 300 + 300)
    return e.select(F.concat(F.lit("acct-"), (F.col("user_id") % 5).cast("string")).alias("account"), (F.col("event_id") % 40 * 500).alias("offset"), F.when(F.col("k") % 21 == 0, F.lit(None)).otherwise(start).alias("window_start"), F.when(F.col("k") % 21 == 0, F.lit(None)).otherwise(end).alias("window_end"))


_MANIFEST = O.EV + ", mf AS (SELECT 'acct-' || user_id % 5 AS account, event_id % 40 * 500 AS o, CASE WHEN k % 3 <> 0 THEN d * 300 END AS a, CASE WHEN k % 3 <> 0 AND k % 7 <> 0 THEN d * 300 + 300 END AS b FROM ev)"


@query("WITH" + _MANIFEST + " SELECT account, array_to_string(list_sort(list(DISTINCT o)), ',') AS offsets FROM mf WHERE a IS NULL AND b IS NULL GROUP BY account")
def manifest_offsets(spark, sf_dir):
    return raw.completed_offsets(_manifest(spark, sf_dir)).withColumn("offsets", F.array_join(F.col("offsets").cast("array<string>"), ","))


@query("WITH" + _MANIFEST + " SELECT account, a AS window_start, b AS window_end, array_to_string(list_sort(list(DISTINCT o)), ',') AS offsets FROM mf WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL")
def manifest_window_offsets(spark, sf_dir):
    return raw.completed_window_offsets(_manifest(spark, sf_dir)).withColumn("offsets", F.array_join(F.col("offsets").cast("array<string>"), ","))


@query("SELECT count(DISTINCT l_orderkey) FILTER (l_orderkey % 3 <> 0) AS inserted, count(*) - count(DISTINCT l_orderkey) FILTER (l_orderkey % 3 <> 0) AS skipped FROM lineitem")
def upsert_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    return raw.upsert_counts(rows.where("l_orderkey % 3 = 0"), rows, "l_orderkey")


@query("WITH" + O.CANDLES + " SELECT open_epoch, round(CAST(open AS DOUBLE), 6) AS open, round(CAST(high AS DOUBLE), 6) AS high, round(CAST(low AS DOUBLE), 6) AS low, round(CAST(close AS DOUBLE) + CASE WHEN open_epoch % 180 = 0 THEN 1 ELSE 0 END, 6) AS close, 60 AS interval_seconds FROM cd")
def candle_pages(spark, sf_dir):
    """Candles out of response pages; every third candle comes again in a later page with another close."""
    c = adapter.candles(spark, sf_dir)
    late = c.where("open_epoch % 180 = 0").withColumn("close", (F.col("close") + 1).cast("decimal(18,8)"))
    page = F.floor(F.col("open_epoch") / 14400)
    rows = c.withColumn("page_no", page).unionByName(late.withColumn("page_no", page + 1_000_000))
    cells = F.array(*[F.col(x).cast("string") for x in ("open_epoch", "low", "high", "open", "close")], F.lit("1"))
    pages = rows.groupBy("page_no").agg(F.to_json(F.collect_list(cells)).alias("value"))
    return rounded(raw.parse_candle_pages(pages), "open", "high", "low", "close")


@query("WITH" + O.CANDLES + """, x AS (SELECT *, open_epoch // 60 % 11 AS n FROM cd),
r AS (SELECT CASE n WHEN 1 THEN 'not_aligned' WHEN 2 THEN 'negative_value' WHEN 3 THEN 'high_below_low' WHEN 4 THEN 'short_row' WHEN 5 THEN 'not_a_number' END AS reason, CASE WHEN n NOT IN (1, 2, 3, 4, 5) THEN close END AS close FROM x UNION ALL SELECT 'short_row', NULL)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS rows, round(CAST(sum(close) AS DOUBLE), 6) AS close_sum FROM r GROUP BY reason""")
def candle_checks(spark, sf_dir):
    """Candle rows of response pages by what sets them aside: some are planted as misaligned, negative, crossed, short or no number, and one page is no list."""
    c = adapter.candles(spark, sf_dir).withColumn("n", F.floor(F.col("open_epoch") / 60) % 11)
    text = lambda x: F.col(x).cast("string")
    cells = F.array(
        (F.col("open_epoch") + F.when(F.col("n") == 1, 7).otherwise(0)).cast("string"), F.when(F.col("n") == 2, F.lit("-0.5")).otherwise(text("low")), F.when(F.col("n") == 3, (F.col("low") - F.lit("0.00000001").cast("decimal(18,8)")).cast("string")).otherwise(text("high")),
        text("open"), F.when(F.col("n") == 5, F.lit("abc")).otherwise(text("close")), F.lit("12345678901234.5"),
    )
    row = F.when(F.col("n") == 4, F.slice(cells, 1, 5)).otherwise(cells)
    pages = c.groupBy(F.floor(F.col("open_epoch") / 14400).alias("page_no")).agg(F.to_json(F.collect_list(row)).alias("value"))
    pages = pages.unionByName(spark.createDataFrame([(-1, "{}")], "page_no bigint, value string"))
    out = raw.check_candle_rows(pages).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"), F.sum(F.when(F.col("reason").isNull(), F.col("close"))).alias("close_sum"))
    return rounded(out, "close_sum")


_FORMS = ["12", "-3", "true", "1.5", '"7"', "null", "", "99999999999999999999"]


@query("WITH" + O.EV + ", p AS (SELECT event_id, event_type, list_extract(['12', '-3', 'true', '1.5', '\"7\"', 'null', '', '99999999999999999999'], CAST(event_id % 8 + 1 AS BIGINT)) AS t FROM ev) SELECT event_id, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS whole, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind FROM p")
def payload_coercion(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (F.col("event_id") % 8 + 1).cast("int"))
    return adapter.events(spark, sf_dir).select("event_id", S.strict_int(text).alias("whole"), S.one_of(F.col("event_type"), "click", "view").alias("kind"))


@query("WITH" + O.FIFO + " SELECT market_id, completing_seq, event_index, round(qd, 6) AS paired_shares, round(c, 6) AS pair_cost FROM pairs ORDER BY market_id, completing_seq, event_index LIMIT 500")
def panel_sample(spark, sf_dir):
    """The bounded sample that goes to CSV: the first 500 rows of the panel's order."""
    p = matching.fifo_pairs(Q.buys(spark, sf_dir))
    out = sinks.panel_sample(p, ["market_id", "completing_seq", "event_index"])
    return out.select("market_id", F.col("completing_seq").cast("bigint").alias("completing_seq"), F.col("event_index").cast("bigint").alias("event_index"), r6("paired_shares").alias("paired_shares"), r6("pair_cost").alias("pair_cost"))


@query("WITH" + O.EV + ", s AS (SELECT min(ec) AS a, max(ec) AS b FROM ev), w AS (SELECT x AS window_start, least(x + 21600, b) AS window_end, a FROM s, unnest(range(a, b, 21600)) AS u(x)) SELECT window_start, strftime(make_timestamp(window_start * 1000000), '%Y-%m-%dT%H') || '-' || strftime(make_timestamp(window_end * 1000000), '%H') || 'Z' AS window_id, window_start // 86400 - a // 86400 + 1 AS elapsed_days FROM w")
def daily_windows(spark, sf_dir):
    e = adapter.events(spark, sf_dir).agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).first()
    rows = windows.daily_windows(windows.generate_windows(spark, e["a"], e["b"], 21600))
    day = lambda c: F.to_date(F.timestamp_seconds(c))
    return rows.select("window_start", "window_id", S.elapsed_days(day(F.lit(e["a"])), day(F.col("window_start"))).cast("bigint").alias("elapsed_days"))


# ---------------------------------------------------------------- cost and online state by recursion

_STEP = O.LED.replace("WITH", "") + """,
x AS (SELECT market_id, id, seq, oside, side, CAST(shares AS DOUBLE) AS q, CAST(price AS DOUBLE) AS p FROM led),
mac AS (SELECT market_id, seq, CASE WHEN oside = 'UP' THEN CASE side WHEN 'BUY' THEN q ELSE -q END ELSE 0.0 END AS un, CASE WHEN oside = 'DOWN' THEN CASE side WHEN 'BUY' THEN q ELSE -q END ELSE 0.0 END AS dn,
          CASE WHEN oside = 'UP' AND side = 'BUY' THEN q * p ELSE 0.0 END AS uc, CASE WHEN oside = 'DOWN' AND side = 'BUY' THEN q * p ELSE 0.0 END AS dc FROM x WHERE seq = 1
        UNION ALL
        SELECT m.market_id, x.seq, m.un + CASE WHEN oside = 'UP' THEN CASE side WHEN 'BUY' THEN q ELSE -q END ELSE 0 END, m.dn + CASE WHEN oside = 'DOWN' THEN CASE side WHEN 'BUY' THEN q ELSE -q END ELSE 0 END,
          CASE WHEN oside <> 'UP' THEN m.uc WHEN side = 'BUY' THEN m.uc + q * p WHEN m.un - q > 1e-9 THEN m.uc / m.un * (m.un - q) ELSE 0 END, CASE WHEN oside <> 'DOWN' THEN m.dc WHEN side = 'BUY' THEN m.dc + q * p WHEN m.dn - q > 1e-9 THEN m.dc / m.dn * (m.dn - q) ELSE 0 END
        FROM mac m JOIN x ON x.market_id = m.market_id AND x.seq = m.seq + 1)"""
_COST = "WITH RECURSIVE" + _STEP
ORACLES["sell_aware_avg_cost"] = _COST + " SELECT market_id, CAST(seq AS INTEGER) AS seq, round(un, 6) AS up_net, round(dn, 6) AS down_net, round(uc, 6) AS up_cost, round(dc, 6) AS down_cost FROM mac"

_INV = O.INV[len(O.LED):]
_ACCOUNT = _COST + _INV + """,
fl AS (SELECT market_id, sum(rise) AS flow, arg_max(paired, seq) AS paired FROM (SELECT market_id, seq, paired, greatest(0, paired - coalesce(lag(paired) OVER (PARTITION BY market_id ORDER BY seq), 0)) AS rise FROM inv) GROUP BY market_id),
av AS (SELECT market_id, arg_max(uc, seq) / nullif(greatest(arg_max(un, seq), 0), 0) + arg_max(dc, seq) / nullif(greatest(arg_max(dn, seq), 0), 0) AS c FROM (SELECT * REPLACE (CASE WHEN abs(un) < 1e-9 THEN 0 ELSE un END AS un, CASE WHEN abs(dn) < 1e-9 THEN 0 ELSE dn END AS dn) FROM mac) GROUP BY market_id),
rr AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN shares ELSE 0 END) OVER w AS b, sum(CASE WHEN side = 'SELL' THEN shares ELSE 0 END) OVER w AS s FROM led WINDOW w AS (PARTITION BY market_id, oside ORDER BY seq ROWS UNBOUNDED PRECEDING)),
re AS (SELECT market_id, oside, max(b) AS bb, max(s) - greatest(0, max(s - b)) AS used FROM rr GROUP BY ALL),
rc AS (SELECT market_id, oside, CASE WHEN any_value(bb - used) > 0 THEN CAST(sum(CASE WHEN side = 'BUY' THEN CAST(price AS DECIMAL(38,8)) * greatest(0, b - greatest(b - shares, used)) ELSE 0 END) AS DOUBLE) / CAST(any_value(bb - used) AS DOUBLE) END AS c FROM rr JOIN re USING (market_id, oside) GROUP BY ALL),
ff AS (SELECT market_id, CASE WHEN count(c) = 2 THEN sum(c) END AS fc FROM rc GROUP BY market_id),
pa AS (SELECT market_id, flow, paired, av.c AS wc, fc FROM fl LEFT JOIN av USING (market_id) LEFT JOIN ff USING (market_id))"""
ORACLES["pair_accounting"] = _ACCOUNT + " SELECT market_id, round(CAST(flow AS DOUBLE), 6) AS formation_flow, round(CAST(paired AS DOUBLE), 6) AS ending_paired, round(wc, 6) AS weighted_pair_cost, round(fc, 6) AS fifo_pair_cost, round(1 - wc, 6) AS gross_edge FROM pa"
ORACLES["claims_table"] = _ACCOUNT + O.ELIG + """,
ac AS (SELECT count(*) / nullif(CAST(count(DISTINCT ec // 3600) AS DOUBLE), 0) AS per_hour, avg(CAST(notional AS DOUBLE)) AS mean FROM led),
ex AS (SELECT sum(CASE WHEN paired + dir > 0 THEN CAST(shares AS DOUBLE) * CAST(paired AS DOUBLE) / CAST(paired + dir AS DOUBLE) END) / CAST(sum(CASE WHEN paired + dir > 0 THEN shares END) AS DOUBLE) AS pr, sum(CASE WHEN paired + dir > 0 THEN CAST(shares AS DOUBLE) * CAST(dir AS DOUBLE) / CAST(paired + dir AS DOUBLE) END) / CAST(sum(CASE WHEN paired + dir > 0 THEN shares END) AS DOUBLE) AS dr FROM inv),
pc AS (SELECT sum(wc * CAST(paired AS DOUBLE)) / sum(CAST(paired AS DOUBLE)) AS c FROM pa JOIN elig USING (market_id) WHERE eligible AND wc IS NOT NULL AND paired > 0),
cl AS (SELECT 'trades_per_active_hour' AS claim, per_hour AS m, CAST(51.25 AS DOUBLE) AS t, CAST(0.25 AS DOUBLE) AS tol FROM ac UNION ALL SELECT 'average_trade', mean, 110.67, 1.0 FROM ac UNION ALL SELECT 'win_rate', NULL, 0.5, 0.0 UNION ALL SELECT 'average_pair_cost', c, 0.9843, 0.005 FROM pc UNION ALL SELECT 'gross_paired_edge', 1 - c, 0.0157, 0.005 FROM pc
  UNION ALL SELECT 'paired_inventory', pr, 0.787, 0.05 FROM ex UNION ALL SELECT 'directional_residual', dr, 0.213, 0.05 FROM ex UNION ALL SELECT 'total_profit', NULL, 126836.0, 0.0)
SELECT claim, round(m, 6) AS measured, CASE WHEN m IS NULL THEN 'inconclusive' WHEN abs(m - t) <= tol THEN 'supported' ELSE 'not_supported' END AS status FROM cl"""


@query("WITH RECURSIVE" + O.LED + """,
x AS (SELECT market_id, id, seq, oside, side, shares FROM led),
st AS (SELECT market_id, CAST(0 AS BIGINT) AS seq, '' AS id, '' AS kind, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS DECIMAL(28,8)) AS u, CAST(0 AS DECIMAL(28,8)) AS d, CAST(0 AS DECIMAL(28,8)) AS p, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT market_id FROM x)
       UNION ALL
       SELECT market_id, seq, id, kind, reason, CAST(u - least(u, d) AS DECIMAL(28,8)), CAST(d - least(u, d) AS DECIMAL(28,8)), CAST(p + least(u, d) AS DECIMAL(28,8)), n FROM (
         SELECT market_id, seq, id, CASE WHEN s.reason IS NOT NULL THEN 'blocked_quarantined' WHEN stop IS NOT NULL THEN 'quarantined' ELSE 'applied' END AS kind, coalesce(s.reason, stop) AS reason, s.p, s.n + CASE WHEN coalesce(s.reason, stop) IS NULL THEN 1 ELSE 0 END AS n,
           CASE WHEN coalesce(s.reason, stop) IS NULL AND oside = 'UP' THEN s.u + signed ELSE s.u END AS u, CASE WHEN coalesce(s.reason, stop) IS NULL AND oside = 'DOWN' THEN s.d + signed ELSE s.d END AS d
         FROM (SELECT st.market_id, x.seq, x.id, x.oside, st.reason, st.u, st.d, st.p, st.n, CASE WHEN side = 'BUY' THEN shares ELSE -shares END AS signed,
                 CASE WHEN side = 'SELL' AND shares > p + CASE WHEN oside = 'UP' THEN st.u ELSE st.d END THEN 'sell_exceeds_observed_inventory' WHEN side = 'SELL' AND shares > CASE WHEN oside = 'UP' THEN st.u ELSE st.d END THEN 'sell_would_unwind_paired_inventory' END AS stop
               FROM st JOIN x ON x.market_id = st.market_id AND x.seq = st.seq + 1) s))
SELECT market_id, id AS source_trade_id, kind, reason, round(CAST(u + p AS DOUBLE), 6) AS up_inventory, round(CAST(d + p AS DOUBLE), 6) AS down_inventory, round(CAST(p AS DOUBLE), 6) AS paired_inventory, round(coalesce(CAST(u - d AS DOUBLE) / nullif(CAST(u + d + 2 * p AS DOUBLE), 0), 0), 6) AS imbalance, n AS applied_fills FROM st WHERE seq > 0""")
def online_applications(spark, sf_dir):
    """One row a fill: applied, the SELL that puts its market into quarantine, or blocked; with the inventory after it."""
    rows = Q.the_ledger(spark, sf_dir).withColumn("arrival", F.col("seq").cast("bigint"))
    out = state.apply_batch(rows).where("kind <> 'pair'")
    out = out.select("market_id", "source_trade_id", "kind", "reason", "up_inventory", "down_inventory", "paired_inventory", "imbalance", F.col("applied_fills").cast("bigint").alias("applied_fills"))
    return rounded(out, "up_inventory", "down_inventory", "paired_inventory", "imbalance")


@query("WITH" + O.LED + " SELECT id AS source_trade_id, row_number() OVER (PARTITION BY market_id ORDER BY ec, id) AS replay_order FROM led")
def replay_order(spark, sf_dir):
    rows = Q.the_ledger(spark, sf_dir).withColumn("arrival", -F.col("seq"))
    return live.event_time_order(rows).select("source_trade_id", F.col("replay_order").cast("bigint").alias("replay_order"))


# ---------------------------------------------------------------- metadata, health, as-of values


def _status_records(spark, sf_dir):
    d = adapter.events(spark, sf_dir).select("day").distinct()
    name = F.concat(F.lit("M"), F.col("day").cast("string")).alias("market_id")
    meta = d.select(name, (F.col("day") % 6 != 2).alias("eligible"), F.col("day").alias("sequence"))
    again = d.where("day % 4 = 0").select(name, F.lit(False).alias("eligible"), (F.col("day") + 5).alias("sequence"))
    return meta.unionByName(again), d.where("day % 5 = 0").select(name, (F.col("day") + 2).alias("sequence")), d


@query("WITH" + O.EV + ", dd AS (SELECT DISTINCT d FROM ev), s AS (SELECT (min(d) + max(d)) // 2 + 3 AS z FROM dd), m AS (SELECT d, d % 6 <> 2 AS e, d AS q FROM dd UNION ALL SELECT d, false, d + 5 FROM dd WHERE d % 4 = 0) SELECT 'm' || d AS market_id, arg_max(e, q) AS known, d % 5 = 0 AND d + 2 <= any_value(z) AS quarantined FROM m, s WHERE q <= z GROUP BY d")
def market_status_as_of(spark, sf_dir):
    meta, stops, days = _status_records(spark, sf_dir)
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return live.market_status_as_of(meta, stops, (span["a"] + span["b"]) // 2 + 3)


@query("WITH" + O.EV + ", z AS (SELECT max(event_id) // 2 AS z FROM ev) SELECT ec // 60 * 60 AS open_epoch, arg_max(k, event_id) AS k, max(event_id) AS sequence FROM ev, z WHERE event_id <= z GROUP BY 1")
def candles_as_of(spark, sf_dir):
    e = adapter.events(spark, sf_dir)
    top = e.agg(F.max("event_id")).first()[0]
    return live.candles_as_of(e.select((F.floor(F.col("epoch") / 60) * 60).alias("open_epoch"), "k", F.col("event_id").alias("sequence")), top // 2)


@query("WITH" + O.LED + """,
lc AS (SELECT DISTINCT d, d % 6 = 0 AND d % 8 <> 3 AS ok FROM led),
y AS (SELECT led.*, ok, CASE WHEN k2 THEN CASE oside WHEN 'UP' THEN 'DOWN' ELSE 'UP' END ELSE oside END AS token_side FROM (SELECT *, event_id % 20 = 1 AS k2 FROM led) led JOIN lc USING (d))
SELECT market_id, count(*) AS fills, count(*) FILTER (ok) AS admitted, count(*) FILTER (ok AND token_side <> oside) AS disagree, round(CAST(coalesce(sum(shares) FILTER (ok AND token_side = 'UP'), 0) AS DOUBLE), 6) AS up_shares FROM y GROUP BY market_id""")
def admitted_fills(spark, sf_dir):
    """Fills by the side of their token; markets looked up twice or not eligible admit none, and every twentieth token is the other side's."""
    meta = markets.classify_lookup(Q._lookups(spark, sf_dir))
    meta = meta.unionByName(meta.where(F.substring("market_id", 2, 20).cast("bigint") % 8 == 3))
    number = F.substring("source_trade_id", 4, 20).cast("bigint")
    up = (F.col("oside") == "UP") != (number % 20 == 1)
    rows = Q.the_ledger(spark, sf_dir).withColumn("asset_id", F.concat(F.when(up, "u").otherwise("d"), F.substring("market_id", 2, 20)))
    out = markets.admit(rows.unionByName(rows.limit(0)), meta)
    side = F.coalesce(F.sum(F.when(F.col("admitted") & (F.col("oside") == "UP"), F.col("shares"))), F.lit(0))
    return out.groupBy("market_id").agg(F.count("*").alias("fills"), F.count_if("admitted").alias("admitted"), F.count_if("side_disagrees").alias("disagree"), r6(side).alias("up_shares"))


@query("WITH" + O.LED + " SELECT market_id, count(*) AS applications, count(*) FILTER (event_id % 29 = 0) AS missing, round(CAST(coalesce(sum(shares) FILTER (event_id % 29 <> 0), 0) AS DOUBLE), 6) AS shares FROM led GROUP BY market_id")
def applied_fills(spark, sf_dir):
    led = Q.the_ledger(spark, sf_dir).withColumn("n", F.substring("source_trade_id", 4, 20).cast("bigint"))
    known = led.where("n % 29 <> 0").select(F.concat(F.lit("f:"), "source_trade_id").alias("fill_event_id"), "source_trade_id", "shares")
    out = binding.applied_fills(known, led.select("market_id", F.concat(F.lit("f:"), "source_trade_id").alias("fill_event_id")))
    return out.groupBy("market_id").agg(F.count("*").alias("applications"), F.count_if("missing").alias("missing"), r6(F.coalesce(F.sum("shares"), F.lit(0))).alias("shares"))


_OFFSETS = (-40, -10, 17, 120, 290, 305)
_TICKS = O.LED.replace(O.EV.strip(), O.CANDLES.strip(), 1) + """,
dd AS (SELECT DISTINCT d FROM ev),
h AS (SELECT (min(d) * 300 // 3600) % 24 AS a FROM dd),
tk AS (SELECT 'm' || d AS market_id, d, d * 300 + o AS tick FROM dd, (SELECT unnest([-40, -10, 17, 120, 290, 305]) AS o)),
mo AS (SELECT DISTINCT tick AS t, d * 300 AS ms FROM tk WHERE tick >= d * 300 - 30)""" + O.BTC + """,
x AS (SELECT tk.market_id AS m, tk.tick, led.* FROM tk LEFT JOIN led ON led.market_id = tk.market_id AND side = 'BUY' AND ec <= tick),
sw AS (SELECT m, tick, count(*) FILTER (b <> oside) AS n FROM (SELECT m, tick, oside, lag(oside) OVER (PARTITION BY m, tick ORDER BY ec, id) AS b FROM x WHERE ec >= tick - 60) GROUP BY ALL),
ag AS (SELECT m, tick, coalesce(sum(shares) FILTER (oside = 'UP'), 0) AS u, coalesce(sum(shares) FILTER (oside = 'DOWN'), 0) AS d, count(*) FILTER (ec >= tick - 15) AS n15, count(*) FILTER (ec >= tick - 30) AS n30, count(*) FILTER (ec >= tick - 60) AS n60,
  coalesce(sum(shares) FILTER (ec >= tick - 15), 0) AS q15, coalesce(sum(shares) FILTER (ec >= tick - 30), 0) AS q30, coalesce(sum(shares) FILTER (ec >= tick - 60), 0) AS q60, count(*) FILTER (ec = tick) AS same, any_value(tick) - max(ec) FILTER (oside = 'UP') AS su, any_value(tick) - max(ec) FILTER (oside = 'DOWN') AS sd FROM x GROUP BY ALL),
ok AS (SELECT DISTINCT ec FROM ev WHERE k % 3 = 0),
qs AS (SELECT market_id, min(ec) AS q FROM led WHERE side = 'SELL' AND d % 12 = 3 GROUP BY market_id),
z AS (SELECT tk.market_id, tk.tick, tk.d * 300 AS ms, (tk.tick // 3600) % 24 AS hr, h.a, tk.d AS day, qs.q, (SELECT min(ec) FROM ok) AS fp, (SELECT max(ec) FROM ok WHERE ok.ec BETWEEN tk.tick - 5 AND tk.tick) AS lp FROM tk, h LEFT JOIN qs ON qs.market_id = tk.market_id),
rs AS (SELECT z.*, btc.* EXCLUDE (t, ms), CASE WHEN z.tick < z.ms - 30 OR day % 6 IN (1, 2) THEN 'market_metadata_unknown_or_ineligible' WHEN z.tick < z.ms OR z.tick >= z.ms + 300 THEN 'outside_market_window' WHEN hr < a OR hr >= a + 2 THEN 'outside_evaluation_window' WHEN day % 11 = 5 THEN 'market_inactive_or_closed'
          WHEN q <= z.tick THEN 'market_state_quarantined' WHEN fp IS NULL OR fp > z.tick THEN 'target_source_never_healthy' WHEN lp IS NULL THEN 'target_source_stale' WHEN ref IS NULL THEN 'btc_no_causal_candle' WHEN z.tick - ref > 120 THEN 'btc_reference_stale' END AS reason FROM z LEFT JOIN btc ON btc.t = z.tick AND btc.ms = z.ms)"""


@query("WITH" + _TICKS + " SELECT r.market_id, r.tick, reason, reason IS NULL AS scorable, " + ", ".join(
    f"CASE WHEN reason IS NULL THEN {c} END AS {n}"
    for n, c in [("up_inventory", "round(CAST(u AS DOUBLE), 6)"), ("down_inventory", "round(CAST(g.d AS DOUBLE), 6)"), ("paired_inventory", "round(CAST(least(u, g.d) AS DOUBLE), 6)"), ("inventory_imbalance", "round(CAST(u - g.d AS DOUBLE) / nullif(CAST(u + g.d AS DOUBLE), 0), 6)"), ("seconds_since_last_up_fill", "su"), ("fill_count_60s", "n60"), ("fill_qty_30s", "round(CAST(q30 AS DOUBLE), 6)"), ("side_switches_60s", "coalesce(sw.n, 0)"), ("btc_return_60s", "btc_return_60s"), ("btc_range_since_market_start", "btc_range_since_market_start")]
) + " FROM rs r JOIN ag g ON g.m = r.market_id AND g.tick = r.tick LEFT JOIN sw ON sw.m = r.market_id AND sw.tick = r.tick")
def feature_tick_results(spark, sf_dir):
    """Six ticks of every market: the first of nine reasons that applies, or the features."""
    e = adapter.events(spark, sf_dir)
    days = e.select("day").distinct()
    ticks = days.select(F.concat(F.lit("m"), F.col("day").cast("string")).alias("market_id"), F.explode(F.array(*[F.col("day") * 300 + o for o in _OFFSETS])).alias("tick"))
    number = F.substring("market_id", 2, 20).cast("bigint")
    meta = days.select(F.concat(F.lit("m"), F.col("day").cast("string")).alias("market_id"), (F.col("day") * 300 - 30).alias("sequence"), (~(F.col("day") % 6).isin(1, 2)).alias("eligible"), (F.col("day") * 300).alias("market_start"), F.lit(True).alias("active"), (F.col("day") % 11 == 5).alias("closed"))
    led = Q.the_ledger(spark, sf_dir)
    stops = led.where((F.col("side") == "SELL") & (number % 12 == 3)).groupBy("market_id").agg(F.min("epoch").alias("sequence"))
    hour = days.agg(F.min("day")).first()[0] * 300 // 3600 % 24
    out = live.build_ticks(ticks, meta, stops, e.where("k % 3 = 0").select("epoch"), adapter.candles(spark, sf_dir), led, (hour, hour + 2))
    out = out.select("market_id", "tick", "reason", "scorable", "up_inventory", "down_inventory", "paired_inventory", "inventory_imbalance", "seconds_since_last_up_fill", F.col("fill_count_60s").cast("bigint").alias("fill_count_60s"), "fill_qty_30s", F.col("side_switches_60s").cast("bigint").alias("side_switches_60s"), "btc_return_60s", "btc_range_since_market_start")
    return rounded(out, "up_inventory", "down_inventory", "paired_inventory", "inventory_imbalance", "fill_qty_30s", "btc_return_60s", "btc_range_since_market_start")


@query("WITH" + O.EV + " SELECT unnest(range(min(d) * 300, min(d) * 300 + 300, 5)) AS tick FROM ev")
def cadence_ticks(spark, sf_dir):
    a = adapter.events(spark, sf_dir).agg(F.min("day")).first()[0] * 300
    return live.cadence(spark, a, a + S.MARKET_SECONDS, 5)


@query("WITH" + O.CANDLES.replace("ec // 60 * 60", "ec // 15 * 15").replace("open_epoch + 60", "open_epoch + 15") + """,
mo AS (SELECT DISTINCT ec AS t FROM ev),
wd AS (SELECT t, s, ce, close FROM mo, (SELECT unnest([30, 60, 120]) AS s) JOIN cl ON ce > t - s AND ce <= t),
rt AS (SELECT t, s, close / nullif(lag(close) OVER (PARTITION BY t, s ORDER BY ce), 0) - 1 AS r FROM wd),
vo AS (SELECT t, s, CASE WHEN count(r) >= 2 THEN round(stddev_samp(r), 6) END AS v FROM rt GROUP BY ALL)
SELECT t AS event_epoch, max(v) FILTER (s = 30) AS btc_realized_vol_30s, max(v) FILTER (s = 60) AS btc_realized_vol_60s, max(v) FILTER (s = 120) AS btc_realized_vol_120s FROM mo LEFT JOIN vo USING (t) GROUP BY t""")
def btc_volatility(spark, sf_dir):
    """Realised volatility over candles of 15 seconds."""
    moments = adapter.events(spark, sf_dir).select(F.col("epoch").alias("event_epoch"), (F.col("day") * 300).alias("market_start")).distinct()
    names = [f"btc_realized_vol_{s}s" for s in (30, 60, 120)]
    return rounded(features.candle_features(moments, adapter.candles(spark, sf_dir, 15), 15).select("event_epoch", *names), *names)


# ---------------------------------------------------------------- monitor


def _monitored(spark, sf_dir):
    """A synthetic run log with starts, health, bindings, quarantines, malformed lines, gaps, and a partial tail."""
    e = adapter.events(spark, sf_dir)
    rows = numbered(e.withColumn("r", F.col("day") % 3), "r", "event_id", "n").withColumn("n", F.col("n") - 1)
    last = e.where(F.col("day") % 3 == 1).agg(F.max("event_id").alias("__last"))  # one row
    rows = rows.crossJoin(F.broadcast(last)).withColumn("partial", (F.col("r") == 1) & F.coalesce(F.col("event_id") == F.col("__last"), F.lit(False)))
    dead = F.col("partial") | ((F.col("n") % 211 == 5) & (F.col("r") != 0))
    rows = rows.withColumn("run_id", F.concat(F.lit("run"), F.col("r").cast("string")))
    sequence = F.when(~dead, F.col("n") + F.when(F.col("r") == 2, F.floor(F.col("n") / 97)).otherwise(F.lit(0)))
    kind = F.when((F.col("n") == 0) & (F.col("r") != 2), "evaluation_run_start").when(F.col("k") % 50 == 7, "state_quarantine").when(F.col("k") % 4 == 0, "source_health").when(F.col("k") % 4 == 1, "score_binding").otherwise("normalized_fill")
    status = F.when(F.col("k") % 4 == 0, F.when(F.col("k") % 5 != 0, "poll_ok").otherwise("poll_error")).otherwise(F.when(F.col("k") % 8 == 1, "bound").otherwise("unbound"))
    rows = rows.select("run_id", F.col("n").alias("line"), sequence.alias("sequence"), kind.alias("event_type"), F.when(~dead, F.col("epoch") * 1000).alias("created_ms"), (F.col("r") == 0).alias("frozen"), F.when(F.col("k") % 8 == 0, "target").otherwise("candles").alias("source"), status.alias("status"), "partial", (F.when(F.col("n") % 101 == 100, F.lit("x"))).alias("__x"))
    return rows.withColumn("event_id", F.concat_ws(":", "run_id", F.coalesce(F.when(F.col("run_id") != "run0", F.col("__x")), F.col("sequence").cast("string")))).drop("__x")


_MONITOR = O.EV + """,
n0 AS (SELECT *, d % 3 AS r, row_number() OVER (PARTITION BY d % 3 ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY d % 3) AS total FROM ev),
n1 AS (SELECT *, total - 1 = n AND r = 1 AS partial, (total - 1 = n AND r = 1) OR (n % 211 = 5 AND r <> 0) AS dead FROM n0),
lg AS (SELECT 'run' || r AS run_id, n AS line, CASE WHEN NOT dead THEN n + CASE WHEN r = 2 THEN n // 97 ELSE 0 END END AS sequence, CASE WHEN n = 0 AND r <> 2 THEN 'evaluation_run_start' WHEN k % 50 = 7 THEN 'state_quarantine' WHEN k % 4 = 0 THEN 'source_health' WHEN k % 4 = 1 THEN 'score_binding' ELSE 'normalized_fill' END AS event_type,
         CASE WHEN NOT dead THEN ec * 1000 END AS created_ms, r = 0 AS frozen, CASE WHEN k % 8 = 0 THEN 'target' ELSE 'candles' END AS source, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 5 <> 0 THEN 'poll_ok' ELSE 'poll_error' END WHEN k % 8 = 1 THEN 'bound' ELSE 'unbound' END AS status, partial, r <> 0 AND n % 101 = 100 AS bad_id FROM n1)"""


@query("WITH" + _MONITOR + """, nw AS (SELECT max(created_ms) + 12000 AS now FROM lg),
sq AS (SELECT line, run_id, coalesce(lag(sequence) OVER (PARTITION BY run_id ORDER BY line) + 1, 0) <> sequence AS wrong FROM lg WHERE sequence IS NOT NULL),
gp AS (SELECT run_id, created_ms - lag(created_ms) OVER (PARTITION BY run_id ORDER BY line) AS gap FROM lg, nw WHERE created_ms >= now - 900000),
gm AS (SELECT run_id, max(gap) FILTER (gap >= 0) AS largest_gap_ms FROM gp GROUP BY run_id),
s AS (SELECT lg.run_id, count(lg.sequence) AS events, max(lg.sequence) AS latest_sequence, count(*) FILTER (lg.sequence IS NULL AND NOT partial) AS malformed, count(*) FILTER (partial) AS partial_tail, count(*) FILTER (wrong) AS sequence_errors, count(*) FILTER (lg.sequence IS NOT NULL AND bad_id) AS id_errors,
        count(*) FILTER (event_type = 'evaluation_run_start') AS starts, coalesce(bool_or(event_type = 'evaluation_run_start' AND lg.sequence = 0 AND frozen), false) AS valid_start, any_value(now) - max(created_ms) AS age_ms,
        count(*) FILTER (event_type = 'state_quarantine') AS quarantines, count(*) FILTER (event_type = 'score_binding' AND status = 'bound') AS bound, count(*) FILTER (event_type = 'score_binding' AND status = 'unbound') AS unbound, any_value(now) AS now,
        max(created_ms) FILTER (event_type = 'source_health' AND source = 'target' AND status = 'poll_ok') AS target_ok_ms, max(created_ms) FILTER (event_type = 'source_health' AND source = 'candles' AND status = 'poll_ok') AS candles_ok_ms,
        count(*) FILTER (event_type = 'source_health' AND source = 'target' AND status <> 'poll_ok' AND created_ms >= now - 300000) AS target_bad, count(*) FILTER (event_type = 'source_health' AND source = 'candles' AND status <> 'poll_ok' AND created_ms >= now - 300000) AS candles_bad
      FROM lg JOIN nw ON true LEFT JOIN sq USING (run_id, line) GROUP BY lg.run_id),
t AS (SELECT s.*, largest_gap_ms, CAST(malformed > 0 AS INTEGER) + CAST(sequence_errors > 0 AS INTEGER) + CAST(id_errors > 0 AS INTEGER) + CAST(starts <> 1 OR NOT valid_start AS INTEGER) + CAST(age_ms > 60000 AS INTEGER) + CAST(coalesce(largest_gap_ms > 60000, false) AS INTEGER) + CAST(target_ok_ms IS NULL OR now - target_ok_ms > 60000 AS INTEGER) + CAST(candles_ok_ms IS NULL OR now - candles_ok_ms > 60000 AS INTEGER) AS critical_alerts,
        CAST(age_ms > 10000 AS INTEGER) + CAST(coalesce(largest_gap_ms > 15000, false) AS INTEGER) + CAST(quarantines > 0 AS INTEGER) + CAST(partial_tail > 0 AS INTEGER) + CAST(coalesce(now - target_ok_ms > 10000, false) AS INTEGER) + CAST(coalesce(now - candles_ok_ms > 20000, false) AS INTEGER) + CAST(target_bad > 0 AS INTEGER) + CAST(candles_bad > 0 AS INTEGER) AS degraded_alerts FROM s LEFT JOIN gm USING (run_id))
SELECT * EXCLUDE (now), CASE WHEN critical_alerts > 0 THEN 'CRITICAL' WHEN degraded_alerts > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM t""")
def operational_monitor(spark, sf_dir):
    log = _monitored(spark, sf_dir)
    return live.operational_monitor(log, log.agg(F.max("created_ms")).first()[0] + 12_000)


@query("WITH" + O.EV + """, l AS (SELECT d % 3 AS r, row_number() OVER (PARTITION BY d % 3 ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY d % 3) AS total FROM ev),
s AS (SELECT 'run' || r AS run_id, CASE WHEN NOT (total - 1 = n AND r = 1) AND NOT (n % 211 = 5 AND r <> 0) THEN n END AS sequence, n = 0 AND r <> 2 AS is_start, CASE WHEN r = 1 THEN 'xyz' ELSE 'abc' END AS commit FROM l),
e AS (SELECT run_id, count(*) FILTER (is_start) AS n, count(*) FILTER (is_start AND sequence = 0) AS z FROM s GROUP BY run_id)
SELECT run_id, CASE WHEN n = 0 THEN 'no_start_record' WHEN n > 1 THEN 'several_start_records' ELSE 'start_not_at_sequence_zero' END AS problem FROM e WHERE n <> 1 OR z = 0
UNION ALL SELECT run_id, 'drift:commit' FROM s WHERE is_start AND sequence = 0 AND commit <> 'abc'""")
def run_start_check(spark, sf_dir):
    log = _monitored(spark, sf_dir).withColumn("settings", F.create_map(F.lit("commit"), F.when(F.col("run_id") == "run1", "xyz").otherwise("abc"), F.lit("hours"), F.lit("12-18")))
    return live.run_start_problems(log, {"commit": "abc", "hours": "12-18"})


@query("WITH" + O.LOG + ", g AS (SELECT run_id, created_ms - lag(created_ms) OVER (PARTITION BY run_id ORDER BY line) AS gap FROM lg), x AS (SELECT run_id, list_sort(list(gap)) AS x FROM g WHERE gap IS NOT NULL GROUP BY run_id) SELECT run_id, CAST(len(x) AS BIGINT) AS n, (x[(len(x) + 1) // 2] + x[len(x) // 2 + 1]) / 2.0 AS median, x[CAST(ceil(len(x) * 0.95) AS BIGINT)] AS p95 FROM x")
def gap_latency(spark, sf_dir):
    gap = F.col("created_ms") - F.lag("created_ms").over(Window.partitionBy("run_id").orderBy("line"))
    return metrics.latency_summary(Q._log(spark, sf_dir).withColumn("gap", gap), "gap", ["run_id"])


# ---------------------------------------------------------------- evaluation

_SEED = 1000
_PERM = O.PANEL + f""",
ka AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY market_id, completing_seq, event_index) AS n1, row_number() OVER (PARTITION BY window_id ORDER BY md5('{{seed}}:' || market_id || ':' || completing_seq || ':' || event_index), market_id, completing_seq, event_index) AS n2 FROM tb)"""


@query("WITH" + _PERM.format(seed=_SEED) + " SELECT a.window_id, a.market_id, a.completing_seq, a.event_index, b.elapsed AS elapsed_seconds, a.lag_seconds FROM ka a JOIN ka b ON a.window_id = b.window_id AND a.n1 = b.n2")
def permuted_features(spark, sf_dir):
    out = evaluation.permuted(Q._panel(spark, sf_dir), ["elapsed_seconds"], _SEED)
    return out.select("window_id", "market_id", F.col("completing_seq").cast("bigint").alias("completing_seq"), F.col("event_index").cast("bigint").alias("event_index"), F.col("elapsed_seconds").cast("bigint").alias("elapsed_seconds"), F.col("lag_seconds").cast("bigint").alias("lag_seconds"))


def _delta_sql() -> str:
    groups = {"lag_seconds": ("b.lag_seconds", "a.elapsed"), "elapsed_seconds": ("a.lag_seconds", "b.elapsed"), "joint": ("b.lag_seconds", "b.elapsed")}
    parts = []
    sql = "WITH" + O.PANEL
    for i, (name, (lag, elapsed)) in enumerate(groups.items()):
        sql += f""",
k{i} AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY market_id, completing_seq, event_index) AS n1, row_number() OVER (PARTITION BY window_id ORDER BY md5('{_SEED + i}:' || market_id || ':' || completing_seq || ':' || event_index), market_id, completing_seq, event_index) AS n2 FROM tb),
p{i} AS (SELECT a.window_id, a.c, a.y, a.qd, {lag} AS lag_seconds, {elapsed} AS elapsed FROM k{i} a JOIN k{i} b ON a.window_id = b.window_id AND a.n1 = b.n2),
q{i} AS (SELECT *, CASE WHEN lag_seconds <= 30 THEN 'a' WHEN lag_seconds <= 60 THEN 'b' WHEN lag_seconds <= 120 THEN 'c' ELSE 'd' END || CASE WHEN elapsed < 100 THEN 'e' WHEN elapsed < 200 THEN 'f' ELSE 'g' END AS bucket FROM p{i}),
e{i} AS (SELECT q.window_id, sum(abs(coalesce(bc, gc) - c) * qd) / sum(qd) AS m, sum((least(1 - 1e-12, greatest(1e-12, coalesce(bp, gp))) - y) ** 2 * qd) / sum(qd) AS b FROM q{i} q JOIN gm USING (window_id) LEFT JOIN bm USING (window_id, bucket) GROUP BY q.window_id)"""
        parts.append(f"SELECT window_id, '{name}' AS permutation, round(e{i}.m - z.m, 6) AS weighted_mae_delta, round(e{i}.b - z.b, 6) AS weighted_brier_delta FROM e{i} JOIN z USING (window_id)")
    return sql + ",\nz AS (SELECT window_id, sum(abs(pc - c) * qd) / sum(qd) AS m, sum((least(1 - 1e-12, greatest(1e-12, pp)) - y) ** 2 * qd) / sum(qd) AS b FROM pd GROUP BY window_id)\n" + "\nUNION ALL ".join(parts)


@query(_delta_sql())
def permutation_deltas(spark, sf_dir):
    p = Q._panel(spark, sf_dir).select("window_id", "market_id", "completing_seq", "event_index", "lag_seconds", "elapsed_seconds", "pair_cost", "paired_shares", "favorable")
    groups = {"lag_seconds": ["lag_seconds"], "elapsed_seconds": ["elapsed_seconds"], "joint": ["lag_seconds", "elapsed_seconds"]}
    return rounded(evaluation.permutation_deltas(p, evaluation.timing_bucket_rules(p), groups, _SEED), "weighted_mae_delta", "weighted_brier_delta")


def _three_folds(spark, sf_dir):
    p = Q._panel(spark, sf_dir)
    flat = p.withColumn("predicted", F.lit(1.0)).withColumn("probability", F.lit(0.5))
    weight = p.groupBy("window_id").agg(F.sum(F.col("paired_shares").cast("double")).alias("weight"))
    out = None
    for name, rows in (("timing_bucket", evaluation.timing_bucket_predictions(p)), ("global_mean", evaluation.global_mean_predictions(p)), ("flat", flat)):
        part = metrics.regression_metrics(rows, ["window_id"]).join(metrics.plain_scores(rows, ["window_id"]), "window_id").join(weight, "window_id").select(F.lit(name).alias("model"), "window_id", "rows", "weight", "weighted_mae", "brier")
        out = part if out is None else out.unionByName(part)
    return out


_FOLDS3 = O.PANEL + """,
f3 AS (SELECT 'timing_bucket' AS model, window_id, count(*) AS n, sum(qd) AS w, sum(abs(pc - c) * qd) / sum(qd) AS m, avg((pp - y) ** 2) AS b FROM pd GROUP BY window_id
  UNION ALL SELECT 'global_mean', window_id, count(*), sum(qd), sum(abs(gc - c) * qd) / sum(qd), avg((gp - y) ** 2) FROM (SELECT pd.*, gm.gp FROM pd JOIN gm USING (window_id)) GROUP BY window_id
  UNION ALL SELECT 'flat', window_id, count(*), sum(qd), sum(abs(1.0 - c) * qd) / sum(qd), avg((0.5 - y) ** 2) FROM pd GROUP BY window_id),
wn AS (SELECT count(*) FILTER (p.m < b.m) AS mae_wins, count(*) FILTER (p.b < b.b) AS brier_wins, count(*) AS n, min(p.n) AS least FROM f3 p JOIN f3 b USING (window_id) WHERE p.model = 'timing_bucket' AND b.model = 'global_mean'),
av AS (SELECT model, avg(m) AS m, avg(b) AS b, sum(m * w) / sum(w) AS wm, sum(b * w) / sum(w) AS wb FROM f3 GROUP BY model)"""


def _gate_sql(m: str, b: str, more: str = "") -> str:
    at = lambda c, name: f"(SELECT {c} FROM av WHERE model = '{name}')"
    checks = {"mae_better_than_base": f"{at(m, 'timing_bucket')} < {at(m, 'global_mean')}", "brier_better_than_base": f"{at(b, 'timing_bucket')} < {at(b, 'global_mean')}", "mae_wins_enough": "mae_wins >= 4", "brier_wins_enough": "brier_wins >= 4", "mae_better_than_plain": f"{at(m, 'timing_bucket')} < {at(m, 'flat')}", "brier_better_than_plain": f"{at(b, 'timing_bucket')} < {at(b, 'flat')}"}
    if more:
        checks |= {"leakage_audit_passed": "true", "all_days_reportable": "n = 7 AND least > 0"}
    return "WITH" + _FOLDS3 + ", g AS (SELECT mae_wins, brier_wins, " + ", ".join(f"{c} AS {k}" for k, c in checks.items()) + " FROM wn) SELECT *, " + " AND ".join(checks) + " AS passed FROM g"


@query(_gate_sql("m", "b"))
def external_validation_gate(spark, sf_dir):
    return live.external_gate(_three_folds(spark, sf_dir), "timing_bucket", "global_mean", "flat")


@query(_gate_sql("wm", "wb", "more"))
def confirmation_gate(spark, sf_dir):
    return live.external_gate(_three_folds(spark, sf_dir), "timing_bucket", "global_mean", "flat", by_weight=True, days=7)


@query("WITH" + _FOLDS3 + " SELECT p.window_id, round(p.m, 6) AS weighted_mae, round(p.b, 6) AS brier, round(b.m, 6) AS weighted_mae_b, round(b.b, 6) AS brier_b FROM f3 p JOIN f3 b USING (window_id) WHERE p.model = 'timing_bucket' AND b.model = 'global_mean'")
def fold_pairs(spark, sf_dir):
    f = _three_folds(spark, sf_dir).select("model", "window_id", "weighted_mae", "brier")
    out = live.zip_folds(f.where("model = 'timing_bucket'").drop("model"), f.where("model = 'global_mean'").drop("model"))
    return rounded(out, "weighted_mae", "brier", "weighted_mae_b", "brier_b")


@query("WITH" + _FOLDS3 + " SELECT model, round(m, 6) AS weighted_mae, row_number() OVER (ORDER BY m, model) AS place FROM av")
def report_order(spark, sf_dir):
    """Models in the order of their mean error; a row a model."""
    rows = _three_folds(spark, sf_dir).groupBy("model").agg(F.avg("weighted_mae").alias("weighted_mae"))
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("weighted_mae", "model")).cast("bigint"))
    return rounded(out.orderBy("place"), "weighted_mae")


@query("WITH" + O.FIFO + ", v AS (SELECT 'lag_seconds' AS feature, CAST(lag_seconds AS DOUBLE) AS x FROM pairs UNION ALL SELECT 'elapsed_seconds', elapsed FROM pairs UNION ALL SELECT 'pair_cost', c FROM pairs) SELECT feature, round(quantile_cont(x, 0.5), 6) AS median FROM v GROUP BY feature")
def feature_medians(spark, sf_dir):
    found = models.medians(Q._panel(spark, sf_dir), ("lag_seconds", "elapsed_seconds", "pair_cost"))
    return rounded(spark.createDataFrame(list(found.items()), "feature string, median double"), "median")


@query("WITH" + O.PANEL + """,
tr AS (SELECT wl.window_id AS held, tb.elapsed AS x, tb.c, tb.qd AS w FROM wl JOIN tb ON tb.window_id <> wl.window_id),
sc AS (SELECT held, avg(x) AS mx, stddev_samp(x) AS sx FROM tr GROUP BY held),
zz AS (SELECT held, (x - mx) / sx AS z, c, w FROM tr JOIN sc USING (held)),
mm AS (SELECT held, sum(w * z) / sum(w) AS mz, sum(w * c) / sum(w) AS mc FROM zz GROUP BY held),
bb AS (SELECT held, any_value(mz) AS mz, any_value(mc) AS mc, sum(w * (z - mz) * (c - mc)) / (sum(w * (z - mz) ** 2) + 1) AS beta FROM zz JOIN mm USING (held) GROUP BY held),
pr2 AS (SELECT tb.window_id, c, qd, mc + beta * ((elapsed - mx) / sx - mz) AS p FROM tb JOIN bb ON bb.held = tb.window_id JOIN sc ON sc.held = tb.window_id)
SELECT window_id, count(*) AS rows, round(sum(abs(p - c) * qd) / sum(qd), 6) AS weighted_mae, round(avg(abs(p - c)), 6) AS mae, round(sum((p - c) * qd) / sum(qd), 6) AS weighted_bias FROM pr2 GROUP BY window_id""")
def ridge_lowo(spark, sf_dir):
    """Every window scored by a ridge regression on one input that was fitted to the others."""
    out = folds.held_out_linear(Q._panel(spark, sf_dir), {"elapsed": ("elapsed_seconds",)})
    return rounded(out.select("window_id", "rows", "weighted_mae", "mae", "weighted_bias"), "weighted_mae", "mae", "weighted_bias")


@query("WITH" + O.FIFO + ", wl AS (SELECT DISTINCT window_id FROM f), b AS (SELECT window_id, '61-120s' AS bucket, sum(qd) AS q, sum(c * qd) / sum(qd) AS c FROM pairs WHERE lag_seconds BETWEEN 61 AND 120 GROUP BY window_id UNION ALL SELECT window_id, 'middle_100_199', sum(qd), sum(c * qd) / sum(qd) FROM pairs WHERE elapsed BETWEEN 100 AND 199 GROUP BY window_id) SELECT wl.window_id, n.bucket, round(coalesce(q, 0), 6) AS paired_shares, round(c, 6) AS weighted_cost, c IS NOT NULL AS complete FROM wl CROSS JOIN (VALUES ('61-120s'), ('middle_100_199')) AS n(bucket) LEFT JOIN b ON b.window_id = wl.window_id AND b.bucket = n.bucket")
def primary_buckets(spark, sf_dir):
    every = Q.fills(spark, sf_dir).select(Q.window_of(F.col("market_id")).alias("window_id"))
    return rounded(metrics.primary_buckets(Q._panel(spark, sf_dir), every), "paired_shares", "weighted_cost")


# ---------------------------------------------------------------- snapshots and audits


def _named(spark, sf_dir):
    p = Q._predictions(spark, sf_dir)
    return p.withColumn("n", F.row_number().over(Window.partitionBy("market_id").orderBy("sequence"))).withColumn("snapshot_id", F.concat(F.lit("s:"), "prediction_id"))


_PN = O.BIND.replace("WHERE number % 11 <> 0", "")


@query("WITH" + O.BIND + " SELECT 'p:' || market_id || ':' || tick AS prediction_id, CASE WHEN number % 17 = 0 THEN 'snapshot_missing' WHEN number % 13 = 0 THEN 'snapshot_not_prior' END AS problem, CASE WHEN number % 17 <> 0 THEN tick * 1000 + CASE WHEN number % 13 = 0 THEN 5 ELSE -1 END END AS snapshot_sequence FROM pn")
def prediction_snapshots(spark, sf_dir):
    p = _named(spark, sf_dir)
    snapshots = p.where("n % 17 <> 0").select("snapshot_id", (F.col("sequence") + F.when(F.col("n") % 13 == 0, 5).otherwise(-1)).alias("sequence"))
    return live.predictions_with_snapshots(p, snapshots).select("prediction_id", "problem", "snapshot_sequence")


@query("WITH" + O.BIND + " SELECT count(*) AS rows, count(*) FILTER (number % 29 = 0) AS not_recomputed, count(*) FILTER (number % 23 = 0 AND number % 29 <> 0) AS not_recorded, count(*) FILTER (number % 19 = 0 AND number % 23 <> 0 AND number % 29 <> 0) AS different, count(*) FILTER (number % 29 = 0 OR number % 23 = 0 OR number % 19 = 0) = 0 AS passed FROM pn WHERE NOT (number % 23 = 0 AND number % 29 = 0)")
def replay_audit(spark, sf_dir):
    """Recorded predictions against a replay: some are missing on either side, and some differ by a millionth."""
    p = _named(spark, sf_dir)
    recorded = p.where("n % 23 <> 0").withColumn("probability", F.col("probability") + F.when(F.col("n") % 19 == 0, 1e-6).otherwise(0.0))
    return live.audit(recorded, p.where("n % 29 <> 0"), ["prediction_id"], ["predicted_pair_cost", "probability"])


_ORDER = ("market_metadata", "btc_candle", "source_health", "state_quarantine", "normalized_fill", "state_application", "tick", "prediction", "pair_formation", "outcome_label", "score_binding")
_MODELS = {"flow": lambda rows: rows.withColumn("predicted", 1 + F.col("fill_count_60s") / 100).withColumn("probability", 1 / (2 + F.col("fill_count_60s")))}


def _recorded_log(spark, sf_dir) -> tuple[DataFrame, tuple[int, int]]:
    """The log that a live run over the table would have left, with planted faults: a count of fills (every fifth market at one
    tick), a predicted cost (every seventh market), labels (every fourth). Snapshots and bindings come from the batch operators."""
    e, led = adapter.events(spark, sf_dir), written(Q.the_ledger(spark, sf_dir), "ledger")
    days = e.select("day").distinct().withColumn("market_id", F.concat(F.lit("m"), F.col("day").cast("string")))
    number = F.substring("market_id", 2, 20).cast("bigint")
    start = F.col("day") * 300
    meta = days.select("market_id", (start - 30).alias("sequence"), (~(F.col("day") % 6).isin(1, 2)).alias("eligible"), start.alias("market_start"), F.lit(True).alias("active"), (F.col("day") % 11 == 5).alias("closed"))
    stops = led.where((F.col("side") == "SELL") & (number % 12 == 3)).groupBy("market_id").agg(F.min("epoch").alias("sequence"))
    candles, healthy = adapter.candles(spark, sf_dir), e.where("k % 3 = 0").select("epoch")
    ticks = days.select("market_id", F.explode(F.array(*[start + o for o in _OFFSETS])).alias("tick"))
    hour = days.agg(F.min("day")).first()[0] * 300 // 3600 % 24
    built = live.build_ticks(ticks, meta, stops, healthy, candles, led, (hour, hour + 2))
    proof = _provenance(ticks, led, candles)

    def event(df: DataFrame, kind: str, second: str, key: Column, payload: Column, name: Column | None = None) -> DataFrame:
        at = _ORDER.index("tick" if kind in ("feature_snapshot", "unscorable_tick") else kind)
        place = (F.col(second) * 16 + at) * 10_000_000 + F.row_number().over(Window.partitionBy(F.col(second)).orderBy(key)) - 1
        made = F.timestamp_millis(F.col(second) * 1000 + 500)
        return df.select(F.lit("v1").alias("schema_version"), F.lit(kind).alias("event_type"), (F.concat(F.lit(f"{kind}:"), key.cast("string")) if name is None else name).alias("event_id"), F.lit("r").alias("run_id"), place.alias("sequence"), made.cast("string").alias("created_at"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"), F.lit(None).cast("string").alias("supersedes_event_id"))

    key = F.concat_ws(":", "market_id", F.col("tick").cast("string"))
    rows = written(built.join(proof, ["market_id", "tick"], "left").withColumn("as_of_sequence", (F.col("tick") * 16 + _ORDER.index("tick")) * 10_000_000 - 1), "ticks")
    planted = F.when((number % 5 == 1) & (F.col("tick") % 300 == 120), 1.0).otherwise(0.0)
    values = {c: F.col(c).cast("double") + (planted if c == "fill_count_60s" else 0.0) for c in replay.FEATURES}
    feature_map = F.map_from_arrays(F.array(*[F.lit(c) for c in values]), F.array(*values.values()))
    shots = event(rows.where("scorable"), "feature_snapshot", "tick", key, F.struct("market_id", "tick", "as_of_sequence", F.lit(list(replay.FEATURES)).alias("feature_order"), feature_map.alias("features"), *replay.PROVENANCE))
    others = event(rows.where("NOT scorable"), "unscorable_tick", "tick", key, F.struct("market_id", "tick", "as_of_sequence", "reason"))
    count = values["fill_count_60s"]
    out = F.struct((1 + count / 100 + F.when(number % 7 == 2, 1e-6).otherwise(0.0)).alias("predicted"), (1 / (2 + count)).alias("probability"))
    made = rows.where("scorable")
    predictions = event(made, "prediction", "tick", key, F.struct("market_id", F.concat(F.lit("feature_snapshot:"), key).alias("snapshot_event_id"), F.map_from_arrays(F.array(F.lit("flow")), F.array(out)).alias("outputs"), F.lit(True).alias("candidate"), F.lit(False).alias("reconstructed")))

    pairs = matching.fifo_pairs(ledger.buys_of_clean_markets(led)).select("market_id", "completing_seq", "event_index", F.col("pair_cost").cast("double").alias("pair_cost"), F.col("paired_shares").cast("double").alias("paired_shares"), F.col("formed_at_epoch").cast("bigint").alias("second"))
    pairs = pairs.withColumn("id", F.concat_ws(":", "market_id", F.col("completing_seq").cast("string"), F.col("event_index").cast("string")))
    # a market has six ticks at most, so its pairs meet them by equality of the market
    prior = pairs.join(made.select("market_id", "tick"), "market_id").where("tick < second").groupBy("id").agg(F.max("tick").alias("bound"))
    pairs = written(pairs.join(prior, "id", "left"), "pairs")
    bound = F.when(F.col("bound").isNotNull(), F.concat_ws(":", F.lit("prediction"), "market_id", F.col("bound").cast("string")))
    own = F.concat(F.lit("pair_formation:"), F.col("id")).alias("pair_event_id")
    favorable = (F.col("pair_cost") < 1) != (number % 4 == 3)
    k = F.col("id")
    parts = [
        event(meta.withColumnRenamed("sequence", "second"), "market_metadata", "second", F.col("market_id"), F.struct("market_id", "eligible", "market_start", "active", "closed")),
        event(candles.withColumn("second", F.col("open_epoch") + 60), "btc_candle", "second", F.col("open_epoch"), F.struct("open_epoch", *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")])),
        event(healthy.withColumnRenamed("epoch", "second").distinct(), "source_health", "second", F.col("second"), F.struct(F.lit("target").alias("source"), F.lit("poll_ok").alias("status"))),
        event(stops.withColumnRenamed("sequence", "second"), "state_quarantine", "second", F.col("market_id"), F.struct("market_id")),
        event(led, "normalized_fill", "epoch", F.col("source_trade_id"), F.struct("market_id", "source_trade_id", F.col("source_trade_id").alias("ingest_id"), "oside", "side", F.col("price").cast("string").alias("price"), F.col("shares").cast("string").alias("shares"), "epoch", F.col("epoch").alias("receive_epoch"))),
        event(led, "state_application", "epoch", F.col("source_trade_id"), F.struct("market_id", F.concat(F.lit("normalized_fill:"), "source_trade_id").alias("fill_event_id"), F.lit("applied").alias("status"), F.lit(False).alias("quarantined"))),
        shots, others, predictions,
        event(pairs, "pair_formation", "second", k, F.struct("market_id", "pair_cost", "paired_shares", F.col("second").alias("formed_at_epoch"))),
        event(pairs, "outcome_label", "second", k, F.struct(own, "pair_cost", favorable.alias("favorable"))),
        event(pairs, "score_binding", "second", k, F.struct(own, bound.alias("prediction_event_id"), F.when(bound.isNotNull(), "bound_strictly_prior_score").otherwise("unbound_no_strictly_prior_score").alias("status"))),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return written(log, "log"), (hour, hour + 2)


def _provenance(ticks: DataFrame, led: DataFrame, candles: DataFrame) -> DataFrame:
    """What a snapshot records beside its features: six ticks a market meet its fills by equality of the market."""
    seen = ticks.join(led.where("side = 'BUY'").select("market_id", "epoch", "source_trade_id"), "market_id").where("epoch <= tick")
    last = F.max(F.struct("epoch", "source_trade_id"))
    seen = seen.groupBy("market_id", "tick").agg(F.max("epoch").alias("max_source_epoch"), F.max("epoch").alias("max_receive_epoch"), F.count("*").alias("applied_buy_fill_count"), last.alias("x"))
    seen = seen.withColumn("max_fill_key", F.concat_ws("|", F.col("x.epoch").cast("string"), "x.source_trade_id", "x.source_trade_id")).drop("x")
    start = (F.substring("market_id", 2, 20).cast("bigint") * 300).alias("market_start")
    known = features.candle_features(ticks.select(F.col("tick").alias("event_epoch"), start), candles).select(F.col("event_epoch").alias("tick"), "btc_reference_epoch", "btc_reference_price").distinct()
    found = ticks.join(seen, ["market_id", "tick"], "left").join(known, "tick", "left")
    return found.withColumn("applied_buy_fill_count", F.coalesce("applied_buy_fill_count", F.lit(0))).withColumn("btc_reference_price", F.col("btc_reference_price").cast("double"))


@query("WITH base AS (" + ORACLES["feature_tick_results"] + """),
ticks AS (SELECT *, CAST(substr(market_id, 2) AS BIGINT) AS d FROM base),
ap AS (WITH""" + O.LED + """ SELECT count(*) AS n FROM led),
pr AS (WITH""" + O.FIFO + """ SELECT count(*) AS n, count(*) FILTER (CAST(substr(market_id, 2) AS BIGINT) % 4 = 3) AS bad FROM pairs),
k AS (SELECT 'application' AS kind, n AS events, 0 AS problems FROM ap UNION ALL SELECT 'pair', n, bad FROM pr
      UNION ALL SELECT 'snapshot', count(*), count(*) FILTER (d % 5 = 1 AND tick % 300 = 120) FROM ticks WHERE scorable HAVING count(*) > 0
      UNION ALL SELECT 'unscorable_tick', count(*), 0 FROM ticks WHERE NOT scorable HAVING count(*) > 0
      UNION ALL SELECT 'prediction', count(*), count(*) FILTER (d % 7 = 2) FROM ticks WHERE scorable HAVING count(*) > 0)
SELECT kind, events, CAST(problems AS BIGINT) AS problems, problems = 0 AS passed FROM k""")
def log_replay(spark, sf_dir):
    """A recorded log with planted faults, rebuilt from its events: how many of each kind, and how many differ."""
    log, hours = _recorded_log(spark, sf_dir)
    return replay.replay_summary(replay.replay(log, _MODELS, hours=hours))
