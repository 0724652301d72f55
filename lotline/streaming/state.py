"""The online state of one market: inventory, unpaired lots, pairs, quarantine. Feature ticks are in operators/live.py.

One pure function advances a state by fills in arrival order; the batch form and the stream both use it.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Output rows of the batch form that are handed on together.
ROWS = 10_000
#: One row for each application of a fill and each pair it forms.
OUTPUT = "market_id string, source_trade_id string, kind string, pair_index int, up_trade_id string, down_trade_id string, paired_shares double, pair_cost double, lag_seconds bigint, reason string, up_inventory double, down_inventory double, paired_inventory double, residual_inventory double, imbalance double, cumulative_paired double, applied_fills int"
ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split() for c in OUTPUT.split(", "))])
INPUT = ["market_id", "source_trade_id", "oside", "side", "price", "shares", "epoch", "arrival"]


def new_state() -> dict:
    return {"held": {"UP": "0", "DOWN": "0"}, "lots": {"UP": [], "DOWN": []}, "seen": [], "paired": "0", "applied": 0, "quarantine": None}


def snapshot(held: dict[str, Decimal], paired: Decimal, applied: int) -> tuple:
    """up, down, paired, residual, imbalance (0 without shares), cumulative paired, applied fills."""
    up, down = held["UP"], held["DOWN"]
    total = up + down
    return float(up), float(down), float(min(up, down)), float(abs(up - down)), float((up - down) / total) if total else 0.0, float(paired), applied


class Market:
    """The running state of one market; `apply` takes one fill after the other and adds its output rows."""

    def __init__(self, state: dict):
        self.held = {k: Decimal(v) for k, v in state["held"].items()}
        self.lots = {k: deque([Decimal(q), Decimal(p), i, e] for q, p, i, e in v) for k, v in state["lots"].items()}
        self.paired, self.applied, self.stop = Decimal(state["paired"]), state["applied"], state["quarantine"]

    def apply(self, fill: tuple, duplicate: bool, out: list[tuple]) -> bool:
        """Whether the fill was applied."""
        market, trade, oside, side, price, shares, epoch = fill

        def emit(kind, index=None, up=None, down=None, q=None, cost=None, lag=None, reason=None):
            out.append((market, trade, kind, index, up, down, q, cost, lag, reason, *snapshot(self.held, self.paired, self.applied)))

        if duplicate:
            emit("duplicate")
            return False
        if self.stop:
            emit("blocked_quarantined", reason=self.stop)
            return False
        price, shares, held, own = Decimal(price), Decimal(shares), self.held, self.lots[oside]
        if side == "SELL":
            free = held[oside] - self.paired  # what the lots of this side hold
            self.stop = "sell_exceeds_observed_inventory" if shares > held[oside] else "sell_would_unwind_paired_inventory" if shares > free else None
            if self.stop:
                emit("quarantined", reason=self.stop)
                return False
            held[oside] -= shares
            while shares > 0:
                take = min(shares, own[0][0])
                own[0][0] -= take
                shares -= take
                if not own[0][0]:
                    own.popleft()
        else:
            held[oside] += shares
            own.append([shares, price, trade, epoch])
        self.applied += 1
        index, ups, downs = 0, self.lots["UP"], self.lots["DOWN"]
        while ups and downs:
            up, down = ups[0], downs[0]
            q = min(up[0], down[0])
            self.paired += q
            emit("pair", index, up[2], down[2], float(q), float(up[1] + down[1]), abs(int(up[3]) - int(down[3])))
            index += 1
            for lot, queue in ((up, ups), (down, downs)):
                lot[0] -= q
                if not lot[0]:
                    queue.popleft()
        emit("applied")
        return True


def advance(state: dict, fills: list[tuple], keep_seen: int | None = None) -> tuple[dict, list[tuple]]:
    """The state after the fills (market_id, id, oside, side, price, shares, epoch), and output rows.

    A fill whose id was seen is a duplicate. A SELL beyond the inventory, or beyond the unpaired part of it, puts the
    market into quarantine before anything changes; every later fill is blocked. keep_seen bounds the remembered ids;
    by default all are kept.
    """
    market, order, seen = Market(state), list(state["seen"]), set(state["seen"])
    out: list[tuple] = []
    for fill in fills:
        if market.apply(fill, fill[1] in seen, out):
            seen.add(fill[1])
            order.append(fill[1])
    if keep_seen is not None:
        order = order[-keep_seen:]
    return {"held": {k: str(v) for k, v in market.held.items()}, "lots": {k: [[str(q), str(p), i, int(e)] for q, p, i, e in v] for k, v in market.lots.items()}, "seen": order, "paired": str(market.paired), "applied": market.applied, "quarantine": market.stop}, out


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Output rows of fills sorted by market and arrival. Held are one batch and the unpaired lots of one market; ids are not, as each fill
    says whether its id came before and when first: it was applied then unless the market was in quarantine already."""
    name, market, stopped = object(), None, None
    for batch in batches:
        out: list[tuple] = []
        for *fill, arrival, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if fill[0] != name:
                name, market, stopped = fill[0], Market(new_state()), None
            duplicate = again and (stopped is None or (first, fill[1] or "") < stopped)
            market.apply(fill, duplicate, out)
            if market.stop and stopped is None:
                stopped = arrival, fill[1] or ""
            if len(out) >= ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("arrival", kind="stable")
    return list(pdf[INPUT[:-1]].itertuples(index=False, name=None))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def apply_batch(fills: DataFrame) -> DataFrame:
    """All fills at once (replay of an arrival log): a market is a true fold, so its fills stream through one task in order of arrival."""
    of = Window.partitionBy("market_id", "source_trade_id")
    # dealt by fill first: a partitioning by market would do, but its tasks hold whole markets
    rows = fills.select(*INPUT).repartition("market_id", "source_trade_id").select(*INPUT, F.min("arrival").over(of).alias("first"), (F.row_number().over(of.orderBy("arrival")) > 1).alias("again"))
    return rows.repartition("market_id").sortWithinPartitions("market_id", "arrival", "source_trade_id", "again").mapInArrow(folded, OUTPUT)


def apply_stream(fills: DataFrame, keep_seen: int | None = None) -> DataFrame:
    """The same for a stream of fills; a market's state is kept in the state store from batch to batch."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else new_state()
        got = [f for f in frames if len(f)]
        now, out = advance(now, _rows(pd.concat(got)) if got else [], keep_seen)
        state.update((json.dumps(now),))
        yield _frame(out)

    return fills.select(*INPUT).groupBy("market_id").applyInPandasWithState(step, OUTPUT, "state string", "append", "NoTimeout")


def quarantines(applied: DataFrame) -> DataFrame:
    return applied.where("kind = 'quarantined'").select("market_id", "source_trade_id", "reason")


def replay_differences(recorded: DataFrame, fills: DataFrame) -> DataFrame:
    """One row: rows of a recorded output that a replay of its fills lacks, and the other way round."""
    from lotline.operators.binding import same_rows

    return same_rows(recorded, apply_batch(fills))
