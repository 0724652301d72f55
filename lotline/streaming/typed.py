"""Streams whose state is typed and ends: list, map and value state by market, with timers that expire a market.

A market lives for some minutes; `keep` after the last event time seen for it all its state goes. Events later than the
watermark are dropped by the stream before they reach it, so with `keep` at least the watermark's delay nothing that still comes misses
a state that is gone. Until then each batch reads and writes only what its own rows touch.

Typed state needs the RocksDB state store, see `typed_state`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lotline.streaming.queries import BOUND
from lotline.streaming.state import INPUT, OUTPUT, _frame, advance, new_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """Chooses the state store that typed state needs, for the queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Expiring(StatefulProcessor):
    """Clears a key's state when the watermark passes its last event time by `keep_ms`."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = []
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def keep(self, state):
        self.states.append(state)
        return state

    def put_off(self, last_ms: int) -> None:
        """One timer a key, at its last event time and `keep_ms`."""
        at = last_ms + self.keep_ms
        for timer in list(self.handle.listTimers()):
            if timer >= at:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.states:
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def replace(state, rows: list[tuple]) -> None:
    """The list state holds these rows; a list of none isn't stored."""
    if rows:
        state.put(rows)
    elif state.exists():
        state.clear()


class Binding(_Expiring):
    """Predictions of a market that can still bind a pair, and the ids of pairs that are bound."""

    def open(self) -> None:
        self.predictions = self.keep(self.handle.getListState("predictions", "ms bigint, sequence bigint, id string"))
        self.bound = self.keep(self.handle.getMapState("bound", "id string", "ms bigint"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = [r for f in rows for r in f.itertuples(index=False)]
        held = [(int(p[0]), int(p[1]), p[2]) for p in self.predictions.get()] if self.predictions.exists() else []
        out = []
        for r in sorted(given, key=lambda r: (r.sequence, r.kind == "pair")):
            if r.kind == "prediction":
                held.append((int(r.ms), int(r.sequence), r.id))
            elif not self.bound.containsKey((r.id,)):
                self.bound.updateValue((r.id,), (int(r.ms),))
                best = max((p for p in held if p[0] < r.ms and p[1] < r.sequence), default=None)
                out.append((r.id, r.market_id, r.cost < 1, best and best[2], best and best[0], "bound_strictly_prior_score" if best else "unbound_no_strictly_prior_score"))
        if given:
            replace(self.predictions, self.useful(held, timerValues.getCurrentWatermarkInMs()))
            self.put_off(max(int(r.ms) for r in given))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BOUND.split(", ")]).astype({"prediction_ms": "Int64"})

    @staticmethod
    def useful(held: list[tuple], watermark_ms: int) -> list[tuple]:
        """Pairs to come aren't before the watermark: of the predictions before it only the last, in either order, can bind one."""
        before = [p for p in held if p[0] < watermark_ms]
        best, out = None, []
        for p in sorted(before, reverse=True):  # a later one with a lower sequence makes an earlier one useless
            if best is None or p[1] < best:
                best = p[1]
                out.append(p)
        return out + [p for p in held if p[0] >= watermark_ms]


def bind_stream(events: DataFrame, delay: str = "10 minutes", keep_ms: int = 900_000) -> DataFrame:
    """Label and binding of each pair, as streaming.queries.bind_stream, with typed state that ends.

    events: (market_id, kind, id, ms, sequence, cost); `ms` is the event time, and `delay` how late an event may come. A row without
    market or time is left out; a pair that comes again within `keep_ms` is bound once.
    """
    rows = events.where("market_id IS NOT NULL AND ms IS NOT NULL").select(F.lower("market_id").alias("market_id"), "kind", "id", "ms", "sequence", F.col("cost").cast("double").alias("cost"), F.timestamp_millis("ms").alias("event_time"))
    return rows.withWatermark("event_time", delay).groupBy("market_id").transformWithStateInPandas(Binding(keep_ms), StructType.fromDDL(BOUND), "Append", "EventTime")


class Market(_Expiring):
    """Inventory, unpaired lots, applied ids and quarantine of a market."""

    def open(self) -> None:
        self.core = self.keep(self.handle.getValueState("core", "up string, down string, paired string, applied int, quarantine string"))
        self.lots = {s: self.keep(self.handle.getListState(f"lots_{s}", "shares string, price string, id string, epoch bigint")) for s in ("UP", "DOWN")}
        self.seen = self.keep(self.handle.getMapState("seen", "id string", "epoch bigint"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = [f for f in rows if len(f)]
        if not given:
            yield _frame([])
            return
        fills = pd.concat(given).sort_values("arrival", kind="stable")
        state = new_state()
        if self.core.exists():
            up, down, paired, n, quarantine = self.core.get()
            state |= {"held": {"UP": up, "DOWN": down}, "paired": paired, "applied": int(n), "quarantine": quarantine}
            state["lots"] = {s: [list(x) for x in lots.get()] if lots.exists() else [] for s, lots in self.lots.items()}
        ids = list(dict.fromkeys(fills["source_trade_id"]))
        known = [i for i in ids if self.seen.containsKey((i,))]
        state["seen"] = list(known)
        state, out = advance(state, list(fills[INPUT[:-1]].itertuples(index=False, name=None)))
        last = int(fills["epoch"].max())
        for i in set(state["seen"]) - set(known):
            self.seen.updateValue((i,), (last,))
        self.core.update((state["held"]["UP"], state["held"]["DOWN"], state["paired"], state["applied"], state["quarantine"]))
        for s, lots in self.lots.items():
            replace(lots, [tuple(x) for x in state["lots"][s]])
        self.put_off(last * 1000)
        yield _frame(out)


def apply_stream(fills: DataFrame, delay: str = "10 minutes", keep_ms: int = 900_000) -> DataFrame:
    """The outcome of each fill and the pairs that it forms, as streaming.state.apply_stream, with typed state that ends."""
    rows = fills.where("market_id IS NOT NULL AND epoch IS NOT NULL").select(*INPUT, F.timestamp_seconds("epoch").alias("event_time"))
    return rows.withWatermark("event_time", delay).groupBy("market_id").transformWithStateInPandas(Market(keep_ms), StructType.fromDDL(OUTPUT), "Append", "EventTime")
