"""SQL for DuckDB that computes the registered queries a second way, on the same tables."""

from __future__ import annotations

# ---------------------------------------------------------------- building blocks, each a list of common table expressions

EV = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
         CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 / 288) AS BIGINT) AS ec, CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 / 86400) AS BIGINT) AS d FROM events)"""
RAW = EV + """,
raw AS (SELECT event_id, 'ev-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'acct-' || user_id AS account, 'm' || d AS market_id, 'm' || d || CASE WHEN k % 2 = 0 THEN '-up' ELSE '-down' END AS asset,
          CASE WHEN event_type = 'error' AND d % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN k % 2 = 0 THEN 'Up' ELSE 'Down' END AS outcome, CASE WHEN k % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS oside,
          CAST(value AS DECIMAL(18,8)) AS shares, CAST(0.30 + 0.004 * k AS DECIMAL(10,8)) AS price, ec, d, user_id || ':' || ec AS tx, d * 300 AS mstart, 'w' || (d // 5) AS window_id FROM ev)"""
LED = RAW + """,
f AS (SELECT * FROM raw WHERE shares > 0),
led AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ec, id) AS seq, CAST(price AS DECIMAL(38,8)) * shares AS notional FROM f)"""
ELIG = """,
elig AS (SELECT market_id, count(DISTINCT outcome) = 2 AND bool_or(oside = 'UP') AND bool_or(oside = 'DOWN') AS eligible FROM f GROUP BY market_id)"""
BUYS = LED + ELIG + """,
buys AS (SELECT led.* FROM led JOIN elig USING (market_id) WHERE eligible AND side = 'BUY' AND market_id NOT IN (SELECT market_id FROM led WHERE side = 'SELL'))"""


def fifo(order: str = "seq", partition: str = "market_id", source: str = "buys") -> str:
    """Overlap of both sides' cumulative intervals, as an interval join."""
    p = ", ".join(f"{{t}}.{c}" for c in partition.split(", "))
    on = " AND ".join(f"u.{c} = d.{c}" for c in partition.split(", "))
    return f""",
o AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY market_id ORDER BY ec, {order}) AS seq FROM {source}),
cum AS (SELECT *, sum(shares) OVER (PARTITION BY {partition}, oside ORDER BY seq ROWS UNBOUNDED PRECEDING) AS hi FROM o),
pr AS (SELECT u.market_id, u.window_id, u.mstart, greatest(u.seq, d.seq) AS completing_seq, least(u.seq, d.seq) AS lot_seq, least(u.hi, d.hi) - greatest(u.hi - u.shares, d.hi - d.shares) AS q, least(u.hi, d.hi) AS b,
         u.price + d.price AS cost, greatest(u.ec, d.ec) - least(u.ec, d.ec) AS lag_seconds, greatest(u.ec, d.ec) AS t, CASE WHEN u.seq > d.seq THEN u.id ELSE d.id END AS completing_id
       FROM cum u JOIN cum d ON {on} AND u.oside = 'UP' AND d.oside = 'DOWN' AND least(u.hi, d.hi) > greatest(u.hi - u.shares, d.hi - d.shares)),
pairs AS (SELECT *, row_number() OVER (PARTITION BY market_id, completing_seq ORDER BY b) - 1 AS event_index, t - mstart AS elapsed, CAST(cost AS DOUBLE) AS c, CAST(q AS DOUBLE) AS qd FROM pr)""".replace("{t}", "u") if p else ""


FIFO = BUYS + fifo()
LIFO = """,
sg AS (SELECT market_id, seq, sum(CASE WHEN oside = 'UP' THEN shares ELSE -shares END) OVER w AS s, coalesce(sum(CASE WHEN oside = 'UP' THEN shares ELSE -shares END) OVER (PARTITION BY market_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM buys WINDOW w AS (PARTITION BY market_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT market_id, s AS a FROM sg UNION SELECT market_id, 0 FROM sg),
el AS (SELECT market_id, a, lead(a) OVER (PARTITION BY market_id ORDER BY a) AS z FROM lv),
cr AS (SELECT el.market_id, a, z, seq, row_number() OVER w AS rn, lead(seq) OVER w AS nx FROM el JOIN sg ON sg.market_id = el.market_id AND least(s, s0) <= a AND greatest(s, s0) >= z WHERE z IS NOT NULL WINDOW w AS (PARTITION BY el.market_id, a ORDER BY seq)),
lifo AS (SELECT market_id, nx AS completing_seq, seq AS lot_seq, sum(z - a) AS q FROM cr WHERE rn % 2 = 1 AND nx IS NOT NULL GROUP BY ALL)"""
WAVG = """,
wc AS (SELECT *, sum(CASE WHEN oside = 'UP' THEN shares ELSE 0 END) OVER w AS qu, sum(CASE WHEN oside = 'DOWN' THEN shares ELSE 0 END) OVER w AS qd0,
         CAST(sum(CASE WHEN oside = 'UP' THEN notional ELSE 0 END) OVER w AS DOUBLE) AS vu, CAST(sum(CASE WHEN oside = 'DOWN' THEN notional ELSE 0 END) OVER w AS DOUBLE) AS vd,
         max(CASE WHEN oside = 'UP' THEN ec END) OVER w AS tu, max(CASE WHEN oside = 'DOWN' THEN ec END) OVER w AS td FROM buys WINDOW w AS (PARTITION BY market_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
wp AS (SELECT *, least(qu, qd0) - coalesce(lag(least(qu, qd0)) OVER (PARTITION BY market_id ORDER BY seq), 0) AS rise FROM wc),
wavg AS (SELECT market_id, mstart, seq AS completing_seq, rise AS q, vu / CAST(qu AS DOUBLE) + vd / CAST(qd0 AS DOUBLE) AS c, ec - CASE WHEN oside = 'UP' THEN td ELSE tu END AS lag_seconds, ec AS t FROM wp WHERE rise > 0)"""
METHODS = FIFO + LIFO + WAVG + """,
m AS (SELECT 'fifo' AS method, market_id, CAST(q AS DOUBLE) AS q, c FROM pairs
      UNION ALL SELECT 'lifo', l.market_id, CAST(l.q AS DOUBLE), CAST(a.price + b.price AS DOUBLE) FROM lifo l JOIN buys a ON a.market_id = l.market_id AND a.seq = l.completing_seq JOIN buys b ON b.market_id = l.market_id AND b.seq = l.lot_seq
      UNION ALL SELECT 'weighted_average', market_id, CAST(q AS DOUBLE), c FROM wavg)"""
INV = LED + """,
net AS (SELECT *, sum(CASE WHEN oside = 'UP' THEN sg ELSE 0 END) OVER w AS up_net, sum(CASE WHEN oside = 'DOWN' THEN sg ELSE 0 END) OVER w AS down_net
        FROM (SELECT *, CASE WHEN side = 'BUY' THEN shares ELSE -shares END AS sg FROM led) WINDOW w AS (PARTITION BY market_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
inv AS (SELECT *, least(greatest(up_net, 0), greatest(down_net, 0)) AS paired, abs(greatest(up_net, 0) - greatest(down_net, 0)) AS dir,
          CASE WHEN greatest(up_net, 0) > greatest(down_net, 0) THEN 'UP' WHEN greatest(down_net, 0) > greatest(up_net, 0) THEN 'DOWN' END AS dside,
          CASE WHEN side = 'SELL' AND shares > greatest(0, CASE WHEN oside = 'UP' THEN up_net ELSE down_net END + shares) THEN shares - greatest(0, CASE WHEN oside = 'UP' THEN up_net ELSE down_net END + shares) END AS over FROM net)"""
WIN = FIFO + """,
we AS (SELECT window_id, min(ec) AS start_epoch FROM f GROUP BY window_id),
wm AS (SELECT window_id, sum(qd) AS q, sum(c * qd) / sum(qd) AS c FROM pairs GROUP BY window_id),
wr AS (SELECT window_id, start_epoch, c, coalesce(q, 0) AS q, q IS NOT NULL AS complete FROM we LEFT JOIN wm USING (window_id)),
ad AS (SELECT * FROM wr WHERE complete AND q >= 500 AND c IS NOT NULL)"""
CANDLES = EV + """,
cd AS (SELECT ec // 60 * 60 AS open_epoch, arg_min(p, (ec, event_id)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (ec, event_id)) AS close FROM (SELECT *, CAST(value + 1 AS DECIMAL(18,8)) AS p FROM ev) GROUP BY 1),
cl AS (SELECT open_epoch + 60 AS ce, CAST(close AS DOUBLE) AS close, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low FROM cd)"""
BTC = """,
bt AS (SELECT mo.t, mo.ms, c0.ce AS ref, c0.close AS p0, c6.close AS p60, c12.close AS p120, cs.close AS ps,
         (SELECT max(high) FROM cl WHERE ce <= mo.t AND ce >= mo.ms) - (SELECT min(low) FROM cl WHERE ce <= mo.t AND ce >= mo.ms) AS swing
       FROM mo ASOF LEFT JOIN cl c0 ON mo.t >= c0.ce ASOF LEFT JOIN cl c6 ON mo.t - 60 >= c6.ce ASOF LEFT JOIN cl c12 ON mo.t - 120 >= c12.ce ASOF LEFT JOIN cl cs ON mo.ms >= cs.ce),
btc AS (SELECT t, ms, ref, round(p0, 6) AS btc_reference_price, round(p0 / nullif(p60, 0) - 1, 6) AS btc_return_60s, round(p0 / nullif(p120, 0) - 1, 6) AS btc_return_120s, round(abs(p0 / nullif(p60, 0) - 1), 6) AS btc_absolute_return_60s,
          round(p0 / nullif(ps, 0) - 1, 6) AS btc_return_since_market_start, round(swing / nullif(ps, 0), 6) AS btc_range_since_market_start FROM bt)"""
PRE = FIFO.replace(EV.strip(), CANDLES.strip(), 1) + """,
mo AS (SELECT DISTINCT t, mstart AS ms FROM pairs)""" + BTC + """,
st AS (SELECT p.market_id, p.completing_seq, p.event_index, x.seq, x.ec, x.oside, x.shares, p.t, lag(x.oside) OVER (PARTITION BY p.market_id, p.completing_seq, p.event_index ORDER BY x.seq) AS before_side FROM pairs p LEFT JOIN buys x ON x.market_id = p.market_id AND x.seq < p.completing_seq),
ag AS (SELECT market_id, completing_seq, event_index, coalesce(sum(shares) FILTER (oside = 'UP'), 0) AS u, coalesce(sum(shares) FILTER (oside = 'DOWN'), 0) AS d,
         count(*) FILTER (ec >= t - 15) AS n15, count(*) FILTER (ec >= t - 30) AS n30, count(*) FILTER (ec >= t - 60) AS n60,
         coalesce(sum(shares) FILTER (ec >= t - 15), 0) AS q15, coalesce(sum(shares) FILTER (ec >= t - 30), 0) AS q30, coalesce(sum(shares) FILTER (ec >= t - 60), 0) AS q60,
         count(*) FILTER (ec = t) AS same, any_value(t) - max(ec) FILTER (oside = 'UP') AS su, any_value(t) - max(ec) FILTER (oside = 'DOWN') AS sd, max(seq) FILTER (ec >= t - 120) AS prior FROM st GROUP BY ALL),
sw AS (SELECT a.market_id, a.completing_seq, a.event_index, count(*) AS n FROM st a JOIN buys b ON b.market_id = a.market_id AND b.seq = a.seq - 1 WHERE a.ec >= a.t - 60 AND b.ec >= a.t - 60 AND a.oside <> b.oside GROUP BY ALL),
pre AS (SELECT p.window_id, p.market_id, p.completing_seq AS prediction_fill_sequence, p.event_index AS target_event_index, p.qd, p.c, p.c < 1 AS favorable, p.lag_seconds AS lag_seconds_label_only, ag.*, coalesce(sw.n, 0) AS switches, btc.* FROM pairs p
        JOIN ag USING (market_id, completing_seq, event_index) LEFT JOIN sw USING (market_id, completing_seq, event_index) LEFT JOIN btc ON btc.t = p.t AND btc.ms = p.mstart)"""
HELD = """round(CAST({u} AS DOUBLE), 6) AS up_inventory, round(CAST({d} AS DOUBLE), 6) AS down_inventory, round(CAST(least({u}, {d}) AS DOUBLE), 6) AS paired_inventory, round(CAST(abs({u} - {d}) AS DOUBLE), 6) AS residual_inventory,
  round(CAST({u} - {d} AS DOUBLE) / nullif(CAST({u} + {d} AS DOUBLE), 0), 6) AS inventory_imbalance, round(CAST(q15 AS DOUBLE), 6) AS fill_qty_15s, round(CAST(q30 AS DOUBLE), 6) AS fill_qty_30s, round(CAST(q60 AS DOUBLE), 6) AS fill_qty_60s"""
COUNTS = "n15 AS fill_count_15s, n30 AS fill_count_30s, n60 AS fill_count_60s, switches AS side_switches_60s, same AS same_second_fill_count, su AS seconds_since_last_up_fill, sd AS seconds_since_last_down_fill"
PANEL = FIFO + """,
tb AS (SELECT *, CASE WHEN lag_seconds <= 30 THEN 'a' WHEN lag_seconds <= 60 THEN 'b' WHEN lag_seconds <= 120 THEN 'c' ELSE 'd' END || CASE WHEN elapsed < 100 THEN 'e' WHEN elapsed < 200 THEN 'f' ELSE 'g' END AS bucket, CAST(c < 1 AS INTEGER) AS y FROM pairs),
wl AS (SELECT DISTINCT window_id FROM tb),
gm AS (SELECT wl.window_id, sum(c * qd) / sum(qd) AS gc, sum(y * qd) / sum(qd) AS gp FROM wl JOIN tb ON tb.window_id <> wl.window_id GROUP BY wl.window_id),
bm AS (SELECT wl.window_id, bucket, sum(c * qd) / sum(qd) AS bc, sum(y * qd) / sum(qd) AS bp FROM wl JOIN tb ON tb.window_id <> wl.window_id GROUP BY ALL),
pd AS (SELECT tb.*, gc, coalesce(bc, gc) AS pc, coalesce(bp, gp) AS pp FROM tb JOIN gm USING (window_id) LEFT JOIN bm USING (window_id, bucket)),
fo AS (SELECT 'global_mean' AS model, window_id, sum(abs(gc - c) * qd) / sum(qd) AS wm, avg(abs(gc - c)) AS ma, sum(qd) AS w FROM pd GROUP BY window_id
       UNION ALL SELECT 'timing_bucket', window_id, sum(abs(pc - c) * qd) / sum(qd), avg(abs(pc - c)), sum(qd) FROM pd GROUP BY window_id)"""
BIND = FIFO + """,
tk AS (SELECT market_id, ec // 10 * 10 AS tick, count(*) AS n, avg(CAST(price AS DOUBLE)) AS mp FROM buys GROUP BY ALL),
pn AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY tick) AS number FROM tk),
pq AS (SELECT 'p:' || market_id || ':' || tick AS prediction_id, market_id, tick * 1000 + n % 7 * 100 AS created_ms, tick * 1000 AS sq, mp * 2 AS pcost, least(1.0, greatest(0.0, 1.5 - mp)) AS prob FROM pn WHERE number % 11 <> 0),
lp AS (SELECT market_id || ':' || completing_seq || ':' || event_index AS pair_id, market_id, t, t * 1000 + 500 AS sq, c, qd FROM pairs),
bd AS (SELECT lp.*, x.prediction_id, x.created_ms AS prediction_ms, x.pcost, x.prob FROM lp LEFT JOIN LATERAL (SELECT * FROM pq WHERE pq.market_id = lp.market_id AND pq.created_ms < lp.t * 1000 AND pq.sq < lp.sq ORDER BY pq.created_ms DESC, pq.sq DESC LIMIT 1) x ON true)"""
SCORED = BIND + """,
sc AS (SELECT 'linear' AS model, prob, pcost, c, CAST(c < 1 AS INTEGER) AS y, qd FROM bd WHERE prediction_id IS NOT NULL UNION ALL SELECT 'flat', 0.5, pcost, c, CAST(c < 1 AS INTEGER), qd FROM bd WHERE prediction_id IS NOT NULL)"""
LOG = EV + """,
ln AS (SELECT 'run' || d % 3 AS run_id, event_id AS line, row_number() OVER (PARTITION BY d % 3 ORDER BY event_id) - 1 AS n, event_type, ec * 1000 AS created_ms, 'source' || k % 4 AS source, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END AS status FROM ev),
lg AS (SELECT *, n + n // 97 AS sequence, run_id || ':' || CASE WHEN n % 101 = 100 THEN 'x' ELSE CAST(n + n // 97 AS VARCHAR) END AS event_id FROM ln)"""
LOOKUP = EV + """,
lk AS (SELECT DISTINCT d FROM ev),
lc AS (SELECT 'm' || d AS market_id, d, CASE d % 6 WHEN 1 THEN 'slug_not_supported' WHEN 2 THEN 'invalid_outcome_arrays' WHEN 3 THEN 'expected_two_outcomes' WHEN 4 THEN 'outcomes_not_up_down' WHEN 5 THEN 'tokens_not_unique' END AS reason_code, CASE WHEN d % 6 <> 1 THEN d * 300 END AS market_start FROM lk)"""
BUCKET_COLUMNS = "count(c) AS events, round(coalesce(sum(qd), 0), 6) AS paired_shares, round(sum(c * qd) / sum(qd), 6) AS weighted_cost, round(sum(CASE WHEN c < 1 THEN qd ELSE 0 END) / nullif(CASE WHEN count(c) > 0 THEN sum(qd) END, 0), 6) AS below_one_share, round(coalesce(sum(qd) / (SELECT sum(qd) FROM pairs), 0), 6) AS share_of_total"


def buckets(bounds: list[tuple[str, str]]) -> str:
    """A row for each (label, condition on pairs)."""
    return "WITH" + FIFO + "\n" + "\nUNION ALL ".join(f"SELECT '{label}' AS label, {BUCKET_COLUMNS} FROM pairs WHERE {condition}" for label, condition in bounds)


def nearest(p: float, x: str = "x") -> str:
    return f"round(list_extract({x}, CAST(floor((len({x}) - 1) * {p} + 0.5) AS BIGINT) + 1), 6)"


PAIR_COLUMNS = "market_id, completing_seq, lot_seq, round(CAST(q AS DOUBLE), 6) AS paired_shares, round(CAST(cost AS DOUBLE), 6) AS pair_cost, lag_seconds"
SUMMARY = "round(sum(q), 6) AS paired_shares, round(sum(c * q) / sum(q), 6) AS weighted_cost"


def _fifo_sql(order: str) -> str:
    return "WITH" + BUYS + fifo(order) + f" SELECT {PAIR_COLUMNS} FROM pairs"


ORACLES: dict[str, str] = {
    "normalize_accept_reject": "WITH" + RAW + " SELECT status, CAST(sum(n) AS BIGINT) AS records FROM (SELECT CASE WHEN shares > 0 THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS n FROM raw GROUP BY 1 UNION ALL VALUES ('rejected', 12), ('accepted', 1), ('duplicate', 1)) GROUP BY status HAVING sum(n) > 0",
    "reject_reasons": "WITH" + RAW + " SELECT reject_reason, CAST(sum(n) AS BIGINT) AS records FROM (SELECT 'non_positive_size' AS reject_reason, count(*) AS n FROM raw WHERE shares <= 0 UNION ALL VALUES ('missing_fields:outcome', 1), ('invalid_side', 1), ('invalid_price', 1), ('price_out_of_range', 2), ('invalid_size', 1), ('non_positive_size', 2), ('invalid_timestamp', 1), ('implausible_timestamp', 2), ('missing_fields:proxyWallet,size', 1)) GROUP BY 1",
    "validation_report": "WITH" + RAW + " SELECT count(*) + 14 AS total, count(*) FILTER (shares > 0) + 1 AS accepted, count(*) FILTER (shares <= 0) + 12 AS invalid, CAST(1 AS BIGINT) AS duplicates, min(ec) FILTER (shares > 0) + 1577836800 AS first_epoch, greatest(max(ec) FILTER (shares > 0) + 1577836800, 1600000000) AS last_epoch, false AS clean FROM raw",
    "identity_hash": "WITH" + RAW + """ SELECT event_id, sha256('{"asset":"' || asset || '","price":"' || price || '","proxyWallet":"' || account || '","side":"' || side || '","size":"' || shares || '","timestamp":"' || ec || '","transactionHash":"' || tx || '"}') AS identity_hash FROM raw""",
    "market_eligibility": "WITH" + LED + ", c AS (SELECT market_id, d, count(DISTINCT outcome) AS n FROM f GROUP BY ALL) SELECT market_id, d % 7 <> 3 AND n = 2 AS eligible, CASE WHEN d % 7 = 3 THEN 'unresolved_history_completeness' WHEN n <> 2 THEN 'expected_2_outcomes_found_' || n END AS reason FROM c",
    "canonical_ledger": "WITH" + LED + " SELECT id AS source_trade_id, market_id, ec AS epoch, seq AS market_seq, row_number() OVER (ORDER BY ec, id) AS fill_seq, oside, round(CAST(notional AS DOUBLE), 6) AS notional FROM led",
    "inventory_running": "WITH" + INV + " SELECT id AS source_trade_id, round(CAST(up_net AS DOUBLE), 6) AS up_net, round(CAST(down_net AS DOUBLE), 6) AS down_net, round(CAST(paired AS DOUBLE), 6) AS paired_shares, round(CAST(dir AS DOUBLE), 6) AS directional_shares, dside AS directional_side, round(CAST(over AS DOUBLE), 6) AS oversold_by FROM inv",
    "pair_flow": "WITH" + INV + ", x AS (SELECT market_id, seq, paired, greatest(0, paired - coalesce(lag(paired) OVER (PARTITION BY market_id ORDER BY seq), 0)) AS rise FROM inv) SELECT market_id, round(CAST(sum(rise) AS DOUBLE), 6) AS formation_flow, round(CAST(arg_max(paired, seq) AS DOUBLE), 6) AS ending_paired FROM x GROUP BY market_id",
    "market_summary": "WITH" + INV + ELIG + """ SELECT market_id, min(ec) AS first_epoch, max(ec) AS last_epoch, count(*) AS fills, round(CAST(coalesce(sum(notional) FILTER (side = 'BUY'), 0) AS DOUBLE), 6) AS buy_notional, round(CAST(coalesce(sum(notional) FILTER (side = 'SELL'), 0) AS DOUBLE), 6) AS sell_notional,
  round(CAST(arg_max(up_net, seq) AS DOUBLE), 6) AS ending_up, round(CAST(arg_max(down_net, seq) AS DOUBLE), 6) AS ending_down, round(CAST(arg_max(paired, seq) AS DOUBLE), 6) AS ending_paired, round(CAST(arg_max(dir, seq) AS DOUBLE), 6) AS ending_directional, round(CAST(max(paired) AS DOUBLE), 6) AS max_paired, bool_and(eligible) AS history_complete, count(DISTINCT over) AS warnings FROM inv JOIN elig USING (market_id) GROUP BY market_id""",
    "exposure_by_market": "WITH" + INV + """ SELECT market_id, round(sum(CASE WHEN paired + dir > 0 THEN CAST(shares AS DOUBLE) * CAST(paired AS DOUBLE) / CAST(paired + dir AS DOUBLE) END) / CAST(sum(CASE WHEN paired + dir > 0 THEN shares END) AS DOUBLE), 6) AS paired_event_ratio,
  round(sum(CASE WHEN paired + dir > 0 THEN CAST(shares AS DOUBLE) * CAST(dir AS DOUBLE) / CAST(paired + dir AS DOUBLE) END) / CAST(sum(CASE WHEN paired + dir > 0 THEN shares END) AS DOUBLE), 6) AS directional_event_ratio,
  round(CAST(arg_max(paired, seq) AS DOUBLE) / nullif(CAST(arg_max(paired + dir, seq) AS DOUBLE), 0), 6) AS paired_end_ratio, round(CAST(arg_max(dir, seq) AS DOUBLE) / nullif(CAST(arg_max(paired + dir, seq) AS DOUBLE), 0), 6) AS directional_end_ratio FROM inv GROUP BY market_id""",
    "trading_activity": "WITH" + LED + " SELECT count(*) AS fills, count(DISTINCT ec // 3600) AS active_hours, round(count(*) / nullif(CAST(count(DISTINCT ec // 3600) AS DOUBLE), 0), 6) AS fills_per_active_hour, round(avg(CAST(notional AS DOUBLE)), 6) AS average_notional FROM led",
    "average_buy_cost": "WITH" + BUYS + """ SELECT id AS source_trade_id, round(CAST(sum(CASE WHEN oside = 'UP' THEN notional ELSE 0 END) OVER w AS DOUBLE) / nullif(CAST(sum(CASE WHEN oside = 'UP' THEN shares ELSE 0 END) OVER w AS DOUBLE), 0), 6) AS up_avg_cost,
  round(CAST(sum(CASE WHEN oside = 'DOWN' THEN notional ELSE 0 END) OVER w AS DOUBLE) / nullif(CAST(sum(CASE WHEN oside = 'DOWN' THEN shares ELSE 0 END) OVER w AS DOUBLE), 0), 6) AS down_avg_cost FROM buys WINDOW w AS (PARTITION BY market_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    "fifo_residual_cost": "WITH" + LED + """,
r AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN shares ELSE 0 END) OVER w AS b, sum(CASE WHEN side = 'SELL' THEN shares ELSE 0 END) OVER w AS s FROM led WINDOW w AS (PARTITION BY market_id, oside ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT market_id, oside, max(b) AS bb, max(s) - greatest(0, max(s - b)) AS used FROM r GROUP BY ALL)
SELECT market_id, oside, round(CAST(any_value(greatest(0, bb - used)) AS DOUBLE), 6) AS held, CASE WHEN any_value(bb - used) > 0 THEN round(CAST(sum(CASE WHEN side = 'BUY' THEN CAST(price AS DECIMAL(38,8)) * greatest(0, b - greatest(b - shares, used)) ELSE 0 END) AS DOUBLE), 6) END AS cost FROM r JOIN e USING (market_id, oside) GROUP BY ALL""",
    "contained_markets": "WITH" + LED + " SELECT DISTINCT market_id FROM f WHERE mstart >= (SELECT min(ec) + 300 FROM f) AND mstart + 300 <= (SELECT max(ec) - 300 FROM f)",
    "fifo_pairs": _fifo_sql("id"),
    "fifo_pairs_price_asc": _fifo_sql("price, id"),
    "fifo_pairs_price_desc": _fifo_sql("price DESC, id"),
    "lifo_pairs": "WITH" + BUYS + LIFO + " SELECT market_id, completing_seq, lot_seq, round(CAST(q AS DOUBLE), 6) AS paired_shares FROM lifo",
    "lifo_pairs_by_levels": "WITH" + BUYS + LIFO + " SELECT market_id, completing_seq, lot_seq, round(CAST(q AS DOUBLE), 6) AS paired_shares FROM lifo",
    "wavg_pairs": "WITH" + BUYS + WAVG + " SELECT market_id, completing_seq, round(CAST(q AS DOUBLE), 6) AS paired_shares, round(c, 6) AS pair_cost, lag_seconds FROM wavg",
    "method_summary": "WITH" + METHODS + f" SELECT method, count(DISTINCT market_id) AS markets, count(*) AS events, {SUMMARY}, round(sum(CASE WHEN c < 1 THEN q ELSE 0 END) / sum(q), 6) AS below_one_share FROM m GROUP BY method",
    "chronological_summary": "WITH" + FIFO + " SELECT count(DISTINCT market_id) AS markets, count(*) AS events, round(sum(qd), 6) AS paired_shares, round(sum(c * qd) / sum(qd), 6) AS weighted_cost, round(sum(CASE WHEN c < 1 THEN qd ELSE 0 END) / sum(qd), 6) AS below_one_share, round(sum(CASE WHEN lag_seconds = 0 THEN qd ELSE 0 END) / sum(qd), 6) AS zero_lag_share, round(1 - sum(c * qd) / sum(qd), 6) AS gross_edge, (SELECT count(DISTINCT market_id) FROM led JOIN elig USING (market_id) WHERE eligible AND side = 'SELL') AS excluded_sell_markets FROM pairs",
    "fifo_latency_buckets": buckets([("0s", "lag_seconds <= 0"), ("1s", "lag_seconds = 1"), *((f"{a}-{b}s", f"lag_seconds BETWEEN {a} AND {b}") for a, b in ((2, 5), (6, 15), (16, 30), (31, 60), (61, 120))), (">120s", "lag_seconds > 120")]),
    "fifo_market_time_buckets": buckets([(f"{a}-{a + 29}", f"elapsed BETWEEN {a} AND {a + 29}") for a in range(0, 300, 30)]),
    "fifo_market_time_bands": buckets([("early_0_99", "elapsed BETWEEN 0 AND 99"), ("middle_100_199", "elapsed BETWEEN 100 AND 199"), ("late_200_299", "elapsed BETWEEN 200 AND 299")]),
    "per_market_methods": "WITH" + METHODS + " SELECT market_id, " + ", ".join(f"count(*) FILTER (method = '{x}') AS {x}_events, round(sum(q) FILTER (method = '{x}'), 6) AS {x}_paired_shares, round(sum(c * q) FILTER (method = '{x}') / sum(q) FILTER (method = '{x}'), 6) AS {x}_weighted_cost" for x in ("fifo", "lifo", "weighted_average")) + " FROM m GROUP BY market_id",
    "cost_distribution": "WITH" + FIFO + f", a AS (SELECT list_sort(list(c)) AS x, avg(c) AS mean, median(c) AS med FROM (SELECT sum(c * qd) / sum(qd) AS c FROM pairs GROUP BY market_id)) SELECT CAST(len(x) AS BIGINT) AS n, round(mean, 6) AS mean, round(med, 6) AS median, {nearest(0.1)} AS p10, {nearest(0.25)} AS p25, {nearest(0.75)} AS p75, {nearest(0.9)} AS p90, round(x[1], 6) AS least, round(x[-1], 6) AS most FROM a",
    "tx_hash_diagnostic": "WITH" + BUYS + fifo("id", "tx, market_id") + ", e AS (SELECT tx, count(*) AS n, count(DISTINCT oside) AS s FROM buys GROUP BY tx) SELECT (SELECT count(*) FROM e) AS transactions, (SELECT count(*) FROM e WHERE s = 2) AS two_sided, (SELECT max(n) FROM e) AS most_fills, (SELECT round(avg(n), 6) FROM e) AS mean_fills, count(*) AS pairs, round(sum(qd), 6) AS paired_shares, round(sum(c * qd) / sum(qd), 6) AS weighted_cost FROM pairs",
    "hypothesis_summary": "WITH" + WIN + f""",
lo AS (SELECT a.window_id, sum(b.c * b.q) / sum(b.q) AS x FROM ad a LEFT JOIN ad b ON b.window_id <> a.window_id GROUP BY a.window_id),
s AS (SELECT count(*) AS requested, count(*) FILTER (complete) AS complete, (SELECT count(*) FROM ad) AS adequate, (SELECT sum(c * q) / sum(q) FROM ad) AS pooled, (SELECT avg(c) FROM ad) AS equal_mean, (SELECT list_sort(list(c)) FROM ad) AS x, (SELECT count(*) FROM ad WHERE c < 1) AS below_one, (SELECT bool_and(coalesce(x < 1, false)) FROM lo) AS all_below FROM wr)
SELECT CASE WHEN adequate < 4 OR complete < requested THEN 'insufficient_data' WHEN pooled >= 1 THEN 'not_replicated' WHEN below_one / CAST(adequate AS DOUBLE) >= 0.6 AND all_below THEN 'replicated' ELSE 'mixed' END AS classification, requested, complete, adequate, round(pooled, 6) AS pooled, round(equal_mean, 6) AS equal_mean,
  {nearest(0.5)} AS median, {nearest(0.25)} AS p25, {nearest(0.75)} AS p75, round(x[1], 6) AS least, round(x[-1], 6) AS most, below_one, round(below_one / CAST(adequate AS DOUBLE), 6) AS below_one_fraction FROM s""",
    "leave_one_out": "WITH" + WIN + " SELECT a.window_id, round(sum(b.c * b.q) / sum(b.q), 6) AS pooled_without FROM ad a LEFT JOIN ad b ON b.window_id <> a.window_id GROUP BY a.window_id",
    "cumulative_pooled": "WITH" + WIN + " SELECT a.window_id, a.start_epoch, round(sum(b.q), 6) AS cumulative_shares, round(sum(b.c * b.q) / sum(b.q), 6) AS cumulative_cost FROM ad a JOIN ad b ON (b.start_epoch, b.window_id) <= (a.start_epoch, a.window_id) GROUP BY ALL",
    "collection_windows": "WITH" + EV + ", s AS (SELECT min(ec) AS a, max(ec) AS b FROM ev) SELECT x AS window_start, least(x + 1000, b) AS window_end FROM s, unnest(range(a, b, 1000)) AS u(x)",
    "window_subdivision": "WITH RECURSIVE" + EV + """,
s AS (SELECT min(ec) AS a, max(ec) + 1 AS b, count(*) // 5 AS lim FROM ev),
w AS (SELECT a, b, 1 AS level FROM s UNION ALL
      SELECT CASE WHEN h = 0 THEN w.a ELSE w.a + (w.b - w.a) // 2 END, CASE WHEN h = 0 THEN w.a + (w.b - w.a) // 2 ELSE w.b END, level + 1 FROM w, (VALUES (0), (1)) AS v(h) WHERE level < 12 AND w.b - w.a > 300 AND (SELECT count(*) FROM ev WHERE ec >= w.a AND ec < w.b) > (SELECT lim FROM s))
SELECT a AS window_start, b AS window_end, (SELECT count(*) FROM ev WHERE ec >= w.a AND ec < w.b) AS records, (SELECT count(*) FROM ev WHERE ec >= w.a AND ec < w.b) > (SELECT lim FROM s) AS ceiling_hit FROM w""",
    "window_completeness": "WITH" + EV + ", c AS (SELECT d // 5 AS w, count(*) AS n FROM ev GROUP BY 1), b AS (SELECT *, n > avg(n) OVER () OR w % 2 <> 0 AS bad FROM c) SELECT count(*) AS windows, count(*) FILTER (bad) AS unresolved, count(*) FILTER (bad) AS unresolved_windows FROM b",
    "dedup_first_wins": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1",
    "upsert_new_rows": "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 3 <> 0 ORDER BY l_orderkey, l_partkey, l_suppkey",
    "candles_ohlc": "WITH" + CANDLES + " SELECT open_epoch, round(CAST(open AS DOUBLE), 6) AS open, round(CAST(high AS DOUBLE), 6) AS high, round(CAST(low AS DOUBLE), 6) AS low, round(CAST(close AS DOUBLE), 6) AS close, 60 AS interval_seconds FROM cd",
    "btc_asof_features": "WITH" + CANDLES + ", mo AS (SELECT DISTINCT ec AS t, d * 300 AS ms FROM ev)" + BTC + " SELECT t AS event_epoch, ms AS market_start, ref AS btc_reference_epoch, btc_reference_price, btc_return_60s, btc_return_120s, btc_absolute_return_60s, btc_return_since_market_start, btc_range_since_market_start FROM btc",
    "pre_event_panel": "WITH" + PRE + " SELECT window_id, market_id, prediction_fill_sequence, target_event_index, round(qd, 6) AS paired_shares, round(c, 6) AS pair_cost, favorable, lag_seconds_label_only, " + HELD.format(u="u", d="d") + f", {COUNTS}, prior AS max_prior_fill_sequence, btc_return_60s FROM pre",
    "leakage_audit": "WITH" + PRE + " SELECT count(*) AS rows, count(*) FILTER (prior >= prediction_fill_sequence) AS sequence_violations, count(*) FILTER (ref > t) AS candle_violations, count(*) FILTER (prior >= prediction_fill_sequence OR ref > t) = 0 AS passed, least(100, count(*) FILTER (prior >= prediction_fill_sequence OR ref > t)) AS messages FROM pre",
    "panel_coverage": "WITH" + PRE + " SELECT window_id, count(*) AS rows, count(DISTINCT market_id) AS markets, round(avg(CAST(favorable AS INTEGER)), 6) AS favorable_ratio, " + ", ".join(f"round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS known_{c}" for c in ("btc_return_60s", "btc_return_120s", "btc_absolute_return_60s", "btc_return_since_market_start", "btc_range_since_market_start")) + " FROM pre GROUP BY window_id",
    "regime_panel": "WITH" + FIFO + """,
st AS (SELECT p.market_id, p.t, x.seq, x.ec, x.oside, x.shares, x.notional, lag(x.oside) OVER w AS bs, lag(x.ec) OVER w AS be FROM (SELECT DISTINCT market_id, t FROM pairs) p JOIN buys x ON x.market_id = p.market_id AND x.ec <= p.t WINDOW w AS (PARTITION BY p.market_id, p.t ORDER BY x.seq)),
ag AS (SELECT market_id, t, coalesce(sum(shares) FILTER (oside = 'UP'), 0) AS u, coalesce(sum(shares) FILTER (oside = 'DOWN'), 0) AS d, CAST(sum(notional) FILTER (oside = 'UP') AS DOUBLE) AS vu, CAST(sum(notional) FILTER (oside = 'DOWN') AS DOUBLE) AS vd,
         count(*) FILTER (ec >= t - 15) AS n15, count(*) FILTER (ec >= t - 30) AS n30, count(*) FILTER (ec >= t - 60) AS n60, coalesce(sum(shares) FILTER (ec >= t - 15), 0) AS q15, coalesce(sum(shares) FILTER (ec >= t - 30), 0) AS q30, coalesce(sum(shares) FILTER (ec >= t - 60), 0) AS q60,
         count(*) FILTER (ec = t) AS same, any_value(t) - max(ec) FILTER (oside = 'UP') AS su, any_value(t) - max(ec) FILTER (oside = 'DOWN') AS sd, count(*) FILTER (bs <> oside AND ec >= t - 60 AND be >= t - 60) AS switches FROM st GROUP BY ALL),
rp AS (SELECT p.*, sum(p.q) OVER (PARTITION BY market_id ORDER BY t, completing_seq, event_index ROWS UNBOUNDED PRECEDING) AS cum_q FROM pairs p)
SELECT rp.market_id, completing_seq, event_index, c < 1 AS favorable, c <= 0.98 AS strong_favorable, """ + HELD.format(u="u", d="d") + f", {COUNTS}, round(vu / CAST(u AS DOUBLE), 6) AS cumulative_up_vwap, round(vd / CAST(d AS DOUBLE), 6) AS cumulative_down_vwap, round(vu / CAST(u AS DOUBLE) + vd / CAST(d AS DOUBLE), 6) AS implied_complete_set_cost, round(CAST(cum_q AS DOUBLE), 6) AS cumulative_paired_quantity FROM rp JOIN ag ON ag.market_id = rp.market_id AND ag.t = rp.t",
    "lowo_global_mean": "WITH" + PANEL + " SELECT window_id, count(*) AS rows, round(sum(abs(gc - c) * qd) / sum(qd), 6) AS weighted_mae, round(avg(abs(gc - c)), 6) AS mae, round(sum((gc - c) * qd) / sum(qd), 6) AS weighted_bias FROM pd GROUP BY window_id",
    "lowo_timing_bucket": "WITH" + PANEL + " SELECT window_id, count(*) AS rows, round(sum(abs(pc - c) * qd) / sum(qd), 6) AS weighted_mae, round(avg(abs(pc - c)), 6) AS mae, round(sum((pc - c) * qd) / sum(qd), 6) AS weighted_bias FROM pd GROUP BY window_id",
    "brier_logloss": "WITH" + PANEL + ", k AS (SELECT *, least(1 - 1e-12, greatest(1e-12, pp)) AS p FROM pd) SELECT window_id, round(sum((p - y) ** 2 * qd) / sum(qd), 6) AS weighted_brier, round(sum(-(y * ln(p) + (1 - y) * ln(1 - p)) * qd) / sum(qd), 6) AS weighted_log_loss, round(avg((pp - y) ** 2), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM k GROUP BY window_id",
    "fold_summary": "WITH" + PANEL + " SELECT a.model, count(*) AS folds, round(avg(a.wm), 6) AS mean_weighted_mae, round(avg(a.ma), 6) AS mean_mae, round(avg(a.wm - b.wm), 6) AS delta_weighted_mae, round(avg(a.ma - b.ma), 6) AS delta_mae, count(*) FILTER (a.wm < b.wm) AS wins_weighted_mae, count(*) FILTER (a.ma < b.ma) AS wins_mae FROM fo a JOIN fo b ON b.model = 'global_mean' AND a.window_id = b.window_id GROUP BY a.model",
    "pooled_models": "WITH" + PANEL + " SELECT model, round(sum(wm * w) / sum(w), 6) AS weighted_mae, round(sum(ma * w) / sum(w), 6) AS mae FROM fo GROUP BY model",
    "advancement_gate": "WITH" + PANEL + ", g AS (SELECT avg(a.wm - b.wm) < 0 AS better_weighted_mae, avg(a.ma - b.ma) < 0 AS better_mae, count(*) FILTER (a.wm < b.wm) >= 4 AS enough_wins_weighted_mae, count(*) FILTER (a.ma < b.ma) >= 4 AS enough_wins_mae, count(*) = 7 AS all_days FROM fo a JOIN fo b ON b.model = 'global_mean' AND a.window_id = b.window_id WHERE a.model = 'timing_bucket') SELECT *, better_weighted_mae AND better_mae AND enough_wins_weighted_mae AND enough_wins_mae AND all_days AS advance FROM g",
    "strict_prior_binding": "WITH" + BIND + " SELECT pair_id, prediction_id, prediction_ms, CASE WHEN prediction_id IS NULL THEN 'unbound_no_strictly_prior_score' ELSE 'bound_strictly_prior_score' END AS status FROM bd",
    "binding_coverage": "WITH" + BIND + " SELECT count(*) FILTER (prediction_id IS NULL) AS missing, CAST(0 AS BIGINT) AS unknown FROM bd",
    "calibration_bins": "WITH" + SCORED + ", b AS (SELECT model, least(9, greatest(0, CAST(trunc(prob * 10) AS INTEGER))) AS bin, count(*) AS rows, sum(qd) AS w, sum(prob * qd) / sum(qd) AS mp, sum(y * qd) / sum(qd) AS fr FROM sc GROUP BY ALL) SELECT m.model, g.bin, coalesce(rows, 0) AS rows, round(coalesce(w, 0), 6) AS weight, round(mp, 6) AS mean_probability, round(fr, 6) AS favorable_rate FROM (SELECT DISTINCT model FROM sc) m CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) g LEFT JOIN b ON b.model = m.model AND b.bin = g.bin",
    "prospective_metrics": "WITH" + SCORED + " SELECT model, count(*) AS rows, round(sum(qd), 6) AS weight, round(sum(abs(pcost - c) * qd) / sum(qd), 6) AS weighted_mae, round(sum((prob - y) ** 2 * qd) / sum(qd), 6) AS weighted_brier FROM sc GROUP BY model",
    "prospective_report": "WITH" + BIND + ", s AS (SELECT count(*) AS evaluated, count(prediction_id) AS bound, count(*) - count(prediction_id) AS unbound, sum(qd) FILTER (prediction_id IS NOT NULL) AS bs, (SELECT count(*) FROM (SELECT t // 86400 FROM bd WHERE prediction_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)) AS reportable_days FROM bd) SELECT evaluated, bound, unbound, round(bs, 6) AS bound_shares, reportable_days, round(bound / nullif(CAST(evaluated AS DOUBLE), 0), 6) AS coverage, 15 >= 14 AND reportable_days >= 1 AND bound >= 1000 AS minimums_reached, false AS horizon_exhausted FROM s",
    "log_integrity": "WITH" + LOG + ", x AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY run_id ORDER BY line) + 1, 0) AS expected FROM lg) SELECT run_id, line, sequence, expected, CASE WHEN sequence <> expected THEN 'sequence_gap' ELSE 'event_id_mismatch' END AS reason FROM x WHERE sequence <> expected OR event_id <> run_id || ':' || sequence",
    "log_event_counts": "WITH" + LOG + " SELECT event_type, count(*) AS events, min(created_ms) AS first_ms, max(created_ms) AS last_ms FROM lg GROUP BY event_type",
    "source_health": "WITH" + LOG + " SELECT source, arg_max(status, line) AS last_status, max(line) AS last_sequence, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed FROM lg GROUP BY source",
    "log_monitor": "WITH" + LOG + ", n AS (SELECT max(created_ms) + 12000 AS now FROM lg), g AS (SELECT run_id, created_ms, created_ms - lag(created_ms) OVER (PARTITION BY run_id ORDER BY sequence) AS gap FROM lg), s AS (SELECT run_id, count(*) AS events, any_value(now) - max(created_ms) AS age_ms, max(gap) FILTER (gap >= 0 AND created_ms >= now - 900000) AS largest_gap_ms FROM g, n GROUP BY run_id) SELECT *, CASE WHEN age_ms > 60000 OR coalesce(largest_gap_ms, 0) > 60000 THEN 'critical' WHEN age_ms > 10000 OR coalesce(largest_gap_ms, 0) > 15000 THEN 'degraded' ELSE 'healthy' END AS status FROM s",
    "candle_revisions": "WITH" + EV + ", r AS (SELECT ec // 60 * 60 AS open_epoch, event_id AS sequence, sha256((ec // 60 * 60) || '|' || (k // 25)) AS fingerprint FROM ev), c AS (SELECT *, lag(fingerprint) OVER (PARTITION BY open_epoch ORDER BY sequence) AS b FROM r) SELECT open_epoch, sequence, fingerprint, lag(sequence) OVER (PARTITION BY open_epoch ORDER BY sequence) AS supersedes_sequence FROM c WHERE b IS NULL OR b <> fingerprint",
    "market_metadata_classify": "WITH" + LOOKUP + " SELECT market_id, reason_code IS NULL AS eligible, reason_code, market_start, CASE WHEN reason_code IS NULL THEN CAST(1 AS BIGINT) ELSE 0 END AS up_token_found FROM lc",
    "active_markets": "WITH" + LOOKUP + ", t AS (SELECT DISTINCT d * 300 + 17 AS tick FROM ev) SELECT market_id, market_start, tick FROM lc JOIN t ON market_start <= tick AND tick < market_start + 300 WHERE reason_code IS NULL",
    "tick_features": "WITH" + LED + """,
tk AS (SELECT market_id, min(ec) + 120 AS tick FROM led GROUP BY market_id),
x AS (SELECT tk.tick, led.* FROM tk JOIN led USING (market_id) WHERE side = 'BUY'),
sw AS (SELECT market_id, count(*) FILTER (b <> oside) AS n FROM (SELECT market_id, oside, lag(oside) OVER (PARTITION BY market_id ORDER BY ec, id) AS b FROM x WHERE ec BETWEEN tick - 60 AND tick) GROUP BY market_id),
ag AS (SELECT market_id, tick, coalesce(sum(shares) FILTER (oside = 'UP'), 0) AS u, coalesce(sum(shares) FILTER (oside = 'DOWN'), 0) AS d, count(*) FILTER (ec BETWEEN tick - 15 AND tick) AS n15, count(*) FILTER (ec BETWEEN tick - 30 AND tick) AS n30, count(*) FILTER (ec BETWEEN tick - 60 AND tick) AS n60,
  coalesce(sum(shares) FILTER (ec BETWEEN tick - 15 AND tick), 0) AS q15, coalesce(sum(shares) FILTER (ec BETWEEN tick - 30 AND tick), 0) AS q30, coalesce(sum(shares) FILTER (ec BETWEEN tick - 60 AND tick), 0) AS q60, count(*) FILTER (ec = tick) AS same,
  CASE WHEN count(*) FILTER (oside = 'UP') > 0 THEN greatest(0, any_value(tick) - max(ec) FILTER (oside = 'UP')) END AS su, CASE WHEN count(*) FILTER (oside = 'DOWN') > 0 THEN greatest(0, any_value(tick) - max(ec) FILTER (oside = 'DOWN')) END AS sd FROM x GROUP BY ALL),
z AS (SELECT ag.*, coalesce(sw.n, 0) AS switches FROM ag LEFT JOIN sw USING (market_id))
SELECT market_id, tick, """ + HELD.format(u="u", d="d") + f", {COUNTS} FROM z",
    "online_pairs": "WITH" + FIFO + " SELECT market_id, completing_id AS source_trade_id, event_index AS pair_index, round(qd, 6) AS paired_shares, round(c, 6) AS pair_cost, lag_seconds FROM pairs",
}
