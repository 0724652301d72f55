"""Running inventory, cost and exposure of markets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S


def running_inventory(ledger: DataFrame) -> DataFrame:
    """Net positions after each fill; they may be negative, paired and directional shares use what is held.

    anomaly says by how much a SELL exceeds what was held.
    """
    w = Window.partitionBy("market_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares"))
    rows = ledger.where("oside IS NOT NULL")
    for s, name in (("UP", "up_net"), ("DOWN", "down_net")):
        rows = rows.withColumn(name, F.sum(F.when(F.col("oside") == s, signed).otherwise(F.lit(0))).over(w))
    up, down = F.greatest(F.col("up_net"), F.lit(0)), F.greatest(F.col("down_net"), F.lit(0))
    own = F.when(F.col("oside") == "UP", F.col("up_net")).otherwise(F.col("down_net"))
    before = F.greatest(own + F.col("shares"), F.lit(0))
    excess = F.when((F.col("side") == "SELL") & (F.col("shares") > before), F.col("shares") - before)
    rows = rows.withColumn("paired_shares", F.least(up, down)).withColumn("directional_shares", F.abs(up - down)).withColumn("directional_side", F.when(up > down, "UP").when(down > up, "DOWN"))
    return rows.withColumn("oversold_by", excess).withColumn("anomaly", F.when(excess.isNotNull(), F.concat(F.lit("sell_exceeds_long_inventory_by="), F.col("oversold_by").cast("string"))))


def buy_average_costs(ledger: DataFrame) -> DataFrame:
    """Average buy cost after each fill of each side, exact where a market has no SELL."""
    w = Window.partitionBy("market_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    buy = lambda s, x: F.sum(F.when((F.col("oside") == s) & (F.col("side") == "BUY"), x).otherwise(F.lit(0))).over(w)
    rows = ledger
    for s, name in (("UP", "up"), ("DOWN", "down")):
        rows = rows.withColumn(f"{name}_avg_cost", S.ratio(buy(s, F.col("shares") * F.col("price")), buy(s, F.col("shares"))))
    return rows


def moving_average_costs(ledger: DataFrame) -> DataFrame:
    """(market_id, seq, up_net, down_net, up_cost, down_cost): moving-average cost with SELLs.

    A SELL leaves the average as it is and scales the cost to what remains; nothing left resets it; a BUY into a
    short position adds its full cost. The recurrence is a true fold, so each market is one group.
    """
    out = "market_id string, seq int, up_net double, down_net double, up_cost double, down_cost double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        net, cost, rows = {"UP": 0, "DOWN": 0}, {"UP": 0, "DOWN": 0}, []
        for seq, o, side, q, p in zip(pdf["seq"], pdf["oside"], pdf["side"], pdf["shares"], pdf["price"], strict=True):
            if side == "BUY":
                net[o], cost[o] = net[o] + q, cost[o] + q * p
            else:
                left = net[o] - q
                cost[o] = cost[o] / net[o] * left if left > 0 else 0
                net[o] = left
            rows.append((seq, *(float(x) for x in (net["UP"], net["DOWN"], cost["UP"], cost["DOWN"]))))
        found = pd.DataFrame(rows, columns=["seq", "up_net", "down_net", "up_cost", "down_cost"])
        found.insert(0, "market_id", pdf["market_id"].iloc[0])
        return found

    return ledger.where("oside IS NOT NULL").select("market_id", "seq", "oside", "side", "shares", "price").groupBy("market_id").applyInPandas(fold, out)


def pair_flow(inventory: DataFrame) -> DataFrame:
    """(market_id, formation_flow, ending_paired): all rises of the paired quantity, and where it ends."""
    before = F.coalesce(F.lag("paired_shares").over(Window.partitionBy("market_id").orderBy("seq")), F.lit(0))
    rows = inventory.withColumn("__rise", F.greatest(F.lit(0), F.col("paired_shares") - before))
    return rows.groupBy("market_id").agg(F.sum("__rise").alias("formation_flow"), F.max_by("paired_shares", "seq").alias("ending_paired"))


def fifo_residual_costs(ledger: DataFrame) -> DataFrame:
    """(market_id, oside, held, cost): cost of the oldest remaining lots after first-in-first-out sells.

    What a SELL takes beyond what is held is dropped: consumed = sold - the largest excess of sold over bought so far.
    """
    w = Window.partitionBy("market_id", "oside").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    amount = lambda s: F.sum(F.when(F.col("side") == s, F.col("shares")).otherwise(F.lit(0))).over(w)
    rows = ledger.where("oside IS NOT NULL").repartition("market_id").withColumn("bought", amount("BUY")).withColumn("sold", amount("SELL"))
    end = rows.groupBy("market_id", "oside").agg(F.max("bought").alias("b"), F.max("sold").alias("s"), F.greatest(F.lit(0), F.max(F.col("sold") - F.col("bought"))).alias("over"))
    end = end.withColumn("consumed", F.col("s") - F.col("over")).withColumn("held", F.greatest(F.lit(0), F.col("b") - F.col("consumed")))
    lots = rows.where("side = 'BUY'").join(end.select("market_id", "oside", "consumed", "held"), ["market_id", "oside"])
    part = F.greatest(F.lit(0), F.least(F.col("bought"), F.col("consumed") + F.col("held")) - F.greatest(F.col("bought") - F.col("shares"), F.col("consumed")))
    cost = lots.groupBy("market_id", "oside").agg(F.sum(part * F.col("price")).alias("cost"))
    return end.select("market_id", "oside", "held").join(cost, ["market_id", "oside"], "left").withColumn("cost", F.when(F.col("held") > 0, F.col("cost")))


def pair_accounting(ledger: DataFrame) -> DataFrame:
    """(market_id, formation_flow, ending_paired, weighted_pair_cost, fifo_pair_cost, gross_edge) for markets; edge = 1 - weighted cost."""
    flow = pair_flow(running_inventory(ledger))
    avg = moving_average_costs(ledger).groupBy("market_id").agg(F.max_by(F.struct("up_net", "down_net", "up_cost", "down_cost"), "seq").alias("x")).select("market_id", (S.ratio(F.col("x.up_cost"), F.greatest(F.col("x.up_net"), F.lit(0.0))) + S.ratio(F.col("x.down_cost"), F.greatest(F.col("x.down_net"), F.lit(0.0)))).alias("weighted_pair_cost"))
    fifo = fifo_residual_costs(ledger).groupBy("market_id").agg(F.sum(S.ratio(F.col("cost"), F.col("held"))).alias("c"), F.count("cost").alias("n")).select("market_id", F.when(F.col("n") == 2, F.col("c")).alias("fifo_pair_cost"))
    return flow.join(avg, "market_id", "left").join(fifo, "market_id", "left").withColumn("gross_edge", 1 - F.col("weighted_pair_cost"))


def market_summaries(ledger: DataFrame) -> DataFrame:
    """One row a market: times, counts, notionals, ending state, most paired, and the distinct sorted warnings."""
    rows = running_inventory(ledger)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("notional"))), F.lit(0))
    last = F.max_by(F.struct("up_net", "down_net", "paired_shares", "directional_shares"), "seq")
    found = rows.groupBy("market_id").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.count("*").alias("fills"), side("BUY").alias("buy_notional"), side("SELL").alias("sell_notional"), last.alias("e"), F.max("paired_shares").alias("max_paired"),
        F.bool_and("eligible_binary_market").alias("history_complete"), F.array_sort(F.collect_set("anomaly")).alias("warnings"),
    )
    return found.select("market_id", "first_epoch", "last_epoch", "fills", "buy_notional", "sell_notional", F.col("e.up_net").alias("ending_up"), F.col("e.down_net").alias("ending_down"), F.col("e.paired_shares").alias("ending_paired"), F.col("e.directional_shares").alias("ending_directional"), "max_paired", "history_complete", "warnings")


def exposure(inventory: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share-weighted paired and directional ratios over fills, and the ratios at the end (of the fill last in order)."""
    total = F.col("paired_shares") + F.col("directional_shares")
    some = total > 0
    weight = F.sum(F.when(some, F.col("shares")).otherwise(F.lit(0)))
    mean = lambda c: S.ratio(F.sum(F.when(some, F.col("shares").cast("double") * S.ratio(F.col(c), total))), weight)
    end = F.max_by(F.struct("paired_shares", "directional_shares"), F.struct("epoch", "market_id", "seq"))
    rows = inventory.groupBy(*(by or [])).agg(mean("paired_shares").alias("paired_event_ratio"), mean("directional_shares").alias("directional_event_ratio"), end.alias("e"))
    final = F.col("e.paired_shares") + F.col("e.directional_shares")
    return rows.select(*(by or []), "paired_event_ratio", "directional_event_ratio", S.ratio(F.col("e.paired_shares"), final).alias("paired_end_ratio"), S.ratio(F.col("e.directional_shares"), final).alias("directional_end_ratio"))


def trading_activity(fills: DataFrame) -> DataFrame:
    """Distinct UTC hours with fills, fills an hour, and the mean absolute notional; no fills give 0, 0, null, null."""
    hours = F.count_distinct(F.floor(F.unix_seconds("timestamp") / 3600))
    return fills.agg(F.count("*").alias("fills"), hours.alias("active_hours"), S.ratio(F.count("*"), hours).alias("fills_per_active_hour"), F.avg(F.abs(F.col("price") * F.col("shares")).cast("double")).alias("average_notional"))
