"""Matching complementary lots: first in first out, last in first out, weighted average.

FIFO needs no loop: the k-th share bought on one side always meets the k-th of the other, so pairs are
the overlaps of both sides' cumulative intervals. They meet in ranges of seconds and of levels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.operators.ranges import span, with_sums_before

PAIR = "market_id string, slug string, completing_seq int, lot_seq int, event_index int, paired_shares decimal(18,8), pair_cost decimal(12,8), lag_seconds bigint, formed_at_epoch bigint, elapsed_seconds bigint, completing_trade_id string, transaction_hash string"
#: Orders within a second: as in the ledger, or by price up or down.
TIE_BREAKS = {"canonical": ("seq",), "price_asc": ("price", "seq"), "price_desc": ("-price", "seq")}

#: Fills of a market that meet in a round of `lifo_pairs_by_levels`; a last round takes whole markets.
LIFO_CHUNKS = (64, 2048, 1 << 16, 1 << 21)
#: Shares of a side that one task takes when FIFO's intervals meet.
LEVELS = 1 << 17



def with_tie_break(buys: DataFrame, tie_break: str = "canonical") -> DataFrame:
    """seq renumbered within each market by (epoch, tie break)."""
    if tie_break == "canonical":
        return buys
    rows = buys.withColumn("__span", span("epoch"))
    own = F.row_number().over(Window.partitionBy("market_id", "__span").orderBy("epoch", *[F.expr(x) for x in TIE_BREAKS[tie_break]]))
    rows = with_sums_before(rows.withColumn("seq", own), "market_id", "__span", {"__before": F.lit(1)})
    return rows.withColumn("seq", (F.col("seq") + F.col("__before")).cast("int")).select(*buys.columns)


def _finish(pairs: DataFrame) -> DataFrame:
    """Pairs of two structs c (completing fill) and l (lot) with a quantity to the common columns."""
    start = S.market_start(F.col("c.slug"))
    return pairs.select(
        "market_id", F.col("c.slug").alias("slug"), F.col("c.seq").alias("completing_seq"), F.col("l.seq").alias("lot_seq"), "event_index", F.col("qty").cast("decimal(18,8)").alias("paired_shares"), (F.col("c.price") + F.col("l.price")).cast("decimal(12,8)").alias("pair_cost"),
        F.greatest(F.lit(0).cast("bigint"), F.col("c.epoch") - F.col("l.epoch")).alias("lag_seconds"), F.col("c.epoch").alias("formed_at_epoch"), (F.col("c.epoch") - start).alias("elapsed_seconds"), F.col("c.source_trade_id").alias("completing_trade_id"), F.col("c.transaction_hash").alias("transaction_hash"),
    )


def _cumulated(rows: DataFrame) -> DataFrame:
    """rows + hi: the shares of the market's side up to and with the fill, in spans of seconds with the sums before them."""
    rows = rows.withColumn("__span", span("epoch"))
    sums = {f"__{s}": F.when(F.col("oside") == s, F.col("shares")).otherwise(F.lit(0)) for s in ("UP", "DOWN")}
    own = F.sum("shares").over(Window.partitionBy("market_id", "__span", "oside").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    kind = rows.select(F.sum("shares").alias("s")).schema["s"].dataType
    before = F.when(F.col("oside") == "UP", F.col("__UP")).otherwise(F.col("__DOWN"))
    return with_sums_before(rows.withColumn("hi", own), "market_id", "__span", sums).withColumn("hi", (F.col("hi") + before).cast(kind))


def _cut(points: DataFrame, by: list[str], u_above: Column, d_above: Column, lo_below: Column) -> DataFrame:
    """points + lo, u, d: the next lower level, and of each side the fill that holds the shares below hi; what lies beyond the group is given."""
    down = Window.partitionBy(*by).orderBy(F.desc("hi"))  # descending, so that "next at or above" is a running frame
    held = down.rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({"lo": F.coalesce(F.lead("hi").over(down), lo_below), "u": F.coalesce(F.last("u", ignorenulls=True).over(held), u_above), "d": F.coalesce(F.last("d", ignorenulls=True).over(held), d_above)})


def fifo_pairs(buys: DataFrame, tie_break: str = "canonical", by: tuple[str, ...] = ("market_id",)) -> DataFrame:
    """One row for each pair of a completing fill and an earlier lot. `by`: what keeps its own queues (market, or transaction and market).

    A market is dealt by seconds for the cumulated shares and by their levels for the overlaps; a row a span and a row a range of levels carry
    over the borders, so no task holds a whole market. Queues of transactions are small and stay whole.
    """
    rows = with_tie_break(buys, tie_break)
    fill = F.struct("seq", "price", "epoch", "slug", "source_trade_id", "transaction_hash")
    sides = [F.max(F.when(F.col("oside") == s, F.col("fill"))).alias(n) for s, n in (("UP", "u"), ("DOWN", "d"))]
    if by == ("market_id",):
        at = ["market_id", "__levels"]
        rows = _cumulated(rows).select("market_id", F.floor(F.col("hi") / LEVELS).cast("bigint").alias("__levels"), "hi", "oside", fill.alias("fill"))
        points = rows.repartition(*at).groupBy(*at, "hi").agg(*sides)
        ends = points.groupBy(*at).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("hi"))).alias(f"__{c}") for c in ("u", "d")], F.max("hi").alias("__top"))
        down = Window.partitionBy("market_id").orderBy(F.desc("__levels"))
        above = down.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*at, F.lead("__top").over(down).alias("__lo"), *[F.last(f"__{c}", ignorenulls=True).over(above).alias(f"__{c}") for c in ("u", "d")])
        cut = _cut(points.join(ends, at), at, F.col("__u"), F.col("__d"), F.col("__lo"))
    else:
        rows = rows.repartition(*by).withColumn("hi", F.sum("shares").over(Window.partitionBy(*by, "oside").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
        points = rows.withColumn("fill", fill).groupBy(*by, "hi").agg(*sides)
        cut = _cut(points, list(by), F.lit(None), F.lit(None), F.lit(None))
    cut = cut.where("u IS NOT NULL AND d IS NOT NULL").withColumn("qty", F.col("hi") - F.coalesce("lo", F.lit(0)))
    later = F.col("u.seq") > F.col("d.seq")
    cut = cut.withColumn("c", F.when(later, F.col("u")).otherwise(F.col("d"))).withColumn("l", F.when(later, F.col("d")).otherwise(F.col("u")))
    cut = cut.withColumn("event_index", F.row_number().over(Window.partitionBy(*by, F.col("c.seq")).orderBy("hi")) - 1)
    return _finish(cut)


def lifo_pairs(buys: DataFrame) -> DataFrame:
    """Last in, first out. The stack of a market is a fold over its fills, so each market is one group; `lifo_pairs_by_levels` shares a market among tasks."""
    out = "market_id string, completing_seq int, lot_seq int, event_index int, qty decimal(18,8)"

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        stacks: dict[str, list[list]] = {"UP": [], "DOWN": []}
        rows = []
        for seq, side, shares in zip(pdf["seq"], pdf["oside"], pdf["shares"], strict=True):
            other, index = stacks["DOWN" if side == "UP" else "UP"], 0
            while shares > 0 and other:
                lot = other[-1]
                q = min(shares, lot[1])
                rows.append((seq, lot[0], index, q))
                shares, lot[1], index = shares - q, lot[1] - q, index + 1
                if lot[1] == 0:
                    other.pop()
            if shares > 0:
                stacks[side].append([seq, shares])
        found = pd.DataFrame(rows, columns=["completing_seq", "lot_seq", "event_index", "qty"])
        found.insert(0, "market_id", pdf["market_id"].iloc[0])
        return found

    pairs = buys.select("market_id", "seq", "oside", "shares").groupBy("market_id").applyInPandas(match, out)
    fill = F.struct("seq", "price", "epoch", "slug", "source_trade_id", "transaction_hash")
    fills = buys.select("market_id", "seq", fill.alias("f"))
    both = pairs.join(fills.select("market_id", F.col("seq").alias("completing_seq"), F.col("f").alias("c")), ["market_id", "completing_seq"]).join(fills.select("market_id", F.col("seq").alias("lot_seq"), F.col("f").alias("l")), ["market_id", "lot_seq"])
    return _finish(both)


def _meet(pieces: DataFrame) -> DataFrame:
    """One round of `lifo_pairs_by_levels` inside each (market_id, chunk): (seq, away, completing_seq, lo, hi), open where completing_seq is null.

    All ends of open pieces cut the levels of a chunk into cells. Levels are numbered, so a piece names its cells without a join.
    The crossings of a cell take turns: one away from zero is completed by the next one. A first one towards zero and a
    last one away stay open. The cells of two fills are neighbours, so they are one range of levels again. Pairs of earlier rounds pass.
    """
    of = Window.partitionBy("market_id", "chunk")
    level = pieces.schema["lo"].dataType
    null = lambda kind: F.lit(None).cast(kind)
    end = lambda x, top: F.struct(x.alias("level"), top.alias("top"))
    is_open = F.col("completing_seq").isNull()
    ends = pieces.withColumn("e", F.explode(F.when(is_open, F.array(end(F.col("lo"), F.lit(False)), end(F.col("hi"), F.lit(True)))).otherwise(F.array(end(null(level), F.lit(False)))))).select("*", "e.*")
    ends = ends.withColumn("at", F.dense_rank().over(of.orderBy("level"))).withColumn("up", F.lead("level").over(of.orderBy("level"))).withColumn("below", F.lag("at").over(of.orderBy("seq", "away", "level")))
    row = lambda cell, seq, away, completing, lo, hi: F.struct(cell.alias("cell"), seq.alias("seq"), away.alias("away"), completing.alias("completing_seq"), lo.alias("lo"), hi.alias("hi"))
    bounds = row(F.col("at"), null("int"), null("boolean"), null("int"), F.col("level"), F.col("up"))
    passed = row(-F.col("seq"), F.col("seq"), F.col("away"), F.col("completing_seq"), F.col("lo"), F.col("hi"))
    crossed = F.transform(F.sequence("below", F.col("at") - 1), lambda c: row(c, F.col("seq"), F.col("away"), null("int"), null(level), null(level)))
    some = F.when(~is_open, F.array(passed)).when(F.col("top") & (F.col("up") > F.col("level")), F.array_append(crossed, bounds)).when(F.col("top"), crossed).when(F.col("up") > F.col("level"), F.array(bounds))
    cells = ends.select("market_id", "chunk", F.explode(some).alias("x")).select("market_id", "chunk", "x.*")
    turn = Window.partitionBy("market_id", "chunk", "cell").orderBy("seq")  # the bounds of a cell come first
    before = turn.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("cell") < 0
    met = cells.select(
        "market_id", "chunk", "seq", "away", F.when(own, F.col("completing_seq")).when(F.col("away"), F.lead("seq").over(turn)).alias("completing_seq"),
        F.when(own, F.col("lo")).otherwise(F.first("lo").over(before)).alias("lo"), F.when(own, F.col("hi")).otherwise(F.first("hi").over(before)).alias("hi"), (own | F.col("away") | (F.row_number().over(turn) == 2)).alias("stays"),
    ).where("seq IS NOT NULL AND stays")
    return met.groupBy("market_id", "chunk", "seq", "away", "completing_seq").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _dealt(pieces: DataFrame) -> DataFrame:
    """Chunks dealt to tasks apart; else the partitioning by market of the steps before would satisfy every round, and a task hold a market in all of them."""
    return pieces.repartition("market_id", "chunk")


def lifo_pairs_by_levels(buys: DataFrame, chunks: tuple[int, ...] = LIFO_CHUNKS) -> DataFrame:
    """Last in, first out without a fold or a Python worker, by level crossing: S = bought UP - bought DOWN, and a fill crosses the levels between S before and after it.

    On each level a crossing away from zero is a lot and the next one, back, completes it. Fills meet in chunks of a market first;
    what a chunk leaves open is a fall to its lowest level and a rise from it, so the next round sees few of its fills, and the last one, of
    whole markets, the fewest. Chunks are dealt to tasks apart, so a large market is shared. A fill takes the youngest lots first.
    """
    by = Window.partitionBy("market_id", "__span").orderBy("seq")
    step = F.when(F.col("oside") == "UP", F.col("shares")).otherwise(-F.col("shares"))
    rows = buys.select("market_id", F.col("seq").cast("int").alias("seq"), span("epoch").alias("__span"), step.alias("step"))
    kind = rows.select(F.sum("step").alias("s")).schema["s"].dataType
    own = rows.select("*", F.row_number().over(by).alias("n"), F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    rows = with_sums_before(own, "market_id", "__span", {"__n": F.lit(1), "__s": F.col("step")})
    rows = rows.select("market_id", "seq", (F.col("n") + F.col("__n")).alias("n"), "step", (F.col("s") + F.col("__s")).cast(kind).alias("s"))
    rows = rows.withColumn("was", (F.col("s") - F.col("step")).cast(kind))
    zero = F.lit(0).cast(rows.schema["s"].dataType)
    side = lambda away, bound: F.struct(away.alias("away"), bound(F.least("s", "was"), zero).alias("lo"), bound(F.greatest("s", "was"), zero).alias("hi"))
    pieces = rows.select("market_id", "seq", "n", F.explode(F.array(side(F.col("s") > F.col("was"), F.greatest), side(F.col("s") < F.col("was"), F.least))).alias("p"))
    pieces = pieces.select("market_id", "seq", "p.*", F.lit(None).cast("int").alias("completing_seq"), F.floor((F.col("n") - 1) / chunks[0]).alias("chunk")).where("lo < hi")
    for size, larger in zip(chunks, (*chunks[1:], None), strict=True):
        wider = F.floor(F.col("chunk") / (larger // size)) if larger else F.lit(0).cast("bigint")
        # what is paired stays in chunks of its own, below zero, and never gathers with the market
        pieces = _meet(_dealt(pieces)).withColumn("chunk", F.when(F.col("completing_seq").isNull(), wider).when(F.col("chunk") < 0, F.col("chunk")).otherwise(-1 - F.col("chunk")))
    pairs = _meet(_dealt(pieces)).where("completing_seq IS NOT NULL").select("market_id", "completing_seq", F.col("seq").alias("lot_seq"), (F.col("hi") - F.col("lo")).alias("qty"))
    pairs = pairs.withColumn("event_index", F.row_number().over(Window.partitionBy("market_id", "completing_seq").orderBy(F.desc("lot_seq"))) - 1)
    fill = F.struct("seq", "price", "epoch", "slug", "source_trade_id", "transaction_hash")
    fills = buys.select("market_id", "seq", fill.alias("f")).repartition("market_id", "seq")
    completing, lot = (fills.select("market_id", F.col("seq").alias(n), F.col("f").alias(f)) for n, f in (("completing_seq", "c"), ("lot_seq", "l")))
    both = pairs.join(completing, ["market_id", "completing_seq"]).join(lot, ["market_id", "lot_seq"])
    return _finish(both)


def weighted_average_pairs(buys: DataFrame) -> DataFrame:
    """A row whenever the smaller side's cumulative quantity rises; the cost is both sides' average after the fill."""
    w = Window.partitionBy("market_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    side = lambda s, x: F.sum(F.when(F.col("oside") == s, x).otherwise(F.lit(0)))
    rows = buys
    for s in ("UP", "DOWN"):
        rows = rows.withColumn(f"q_{s}", side(s, F.col("shares")).over(w)).withColumn(f"v_{s}", side(s, F.col("shares") * F.col("price")).over(w)).withColumn(f"t_{s}", F.last(F.when(F.col("oside") == s, F.col("epoch")), ignorenulls=True).over(w))
    paired = F.least("q_UP", "q_DOWN")
    rows = rows.withColumn("paired", paired).withColumn("before", F.coalesce(F.lag("paired").over(Window.partitionBy("market_id").orderBy("seq")), F.lit(0)))
    rows = rows.where("paired > before")
    opposite = F.when(F.col("oside") == "UP", F.col("t_DOWN")).otherwise(F.col("t_UP"))
    return rows.select(
        "market_id", "slug", F.col("seq").alias("completing_seq"), F.lit(None).cast("int").alias("lot_seq"), F.lit(0).alias("event_index"), (F.col("paired") - F.col("before")).cast("decimal(18,8)").alias("paired_shares"),
        (S.ratio(F.col("v_UP"), F.col("q_UP")) + S.ratio(F.col("v_DOWN"), F.col("q_DOWN"))).alias("pair_cost"), F.greatest(F.lit(0).cast("bigint"), F.col("epoch") - opposite).alias("lag_seconds"), F.col("epoch").alias("formed_at_epoch"),
        (F.col("epoch") - S.market_start(F.col("slug"))).alias("elapsed_seconds"), F.col("source_trade_id").alias("completing_trade_id"), "transaction_hash",
    )


def pair_events_by_method(buys: DataFrame) -> DataFrame:
    """The three methods' events under one schema, with pair_cost as double."""
    parts = {"fifo": fifo_pairs(buys), "lifo": lifo_pairs(buys), "weighted_average": weighted_average_pairs(buys)}
    out = None
    for name, part in parts.items():
        part = part.withColumn("pair_cost", F.col("pair_cost").cast("double")).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
