"""Streams: each stage is a query over the shared log folder with its own checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.schemas import PRICE, SHARES
from lotline.streaming.state import apply_stream

FILL_PAYLOAD = "market_id string, source_trade_id string, oside string, side string, price string, shares string, epoch bigint"


def fill_stream(log: DataFrame) -> DataFrame:
    """Fills of normalized_fill events, with their sequence as arrival order."""
    rows = log.where("event_type = 'normalized_fill'").select("sequence", F.from_json("payload", FILL_PAYLOAD).alias("p")).select("p.*", F.col("sequence").alias("arrival"))
    return rows.withColumn("price", F.col("price").cast(PRICE)).withColumn("shares", F.col("shares").cast(SHARES))


def deduplicated(fills: DataFrame, watermark: str | None = None, time_col: str = "timestamp") -> DataFrame:
    """First arrival of each trade id. Without a watermark all ids are remembered; one bounds the memory and drops later ones."""
    if watermark is None:
        return fills.dropDuplicates(["source_trade_id"])
    return fills.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["source_trade_id"])


def run_state_query(spark: SparkSession, log_path: str, out_path: str, checkpoint: str):
    """Applies all new fills of the log to the markets' states and appends the outcome as Parquet; started again it goes on where it stopped."""
    from lotline.sources.eventlog import stream_log

    query = apply_stream(fill_stream(stream_log(spark, log_path))).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


BOUND = "pair_id string, market_id string, favorable boolean, prediction_id string, prediction_ms bigint, status string"


def bind_stream(events: DataFrame) -> DataFrame:
    """Label and binding of each pair, exactly once, from a stream of predictions and pairs in one frame.

    events: (market_id, kind, id, ms, sequence, cost): kind `prediction` with the time it was made, or `pair` with that of
    its second. A pair binds the last prediction made before its second with a lower sequence, as bind_strictly_prior does;
    it is bound when it comes, so a prediction that comes later can't bind it again. A market's state holds its predictions
    and the ids of its bound pairs.
    """

    def step(key, frames, state):
        held = json.loads(state.get[0]) if state.exists else {"predictions": [], "bound": []}
        done, out = set(held["bound"]), []
        rows = [r for f in frames for r in f.itertuples(index=False)]
        for r in sorted(rows, key=lambda r: (r.sequence, r.kind == "pair")):
            if r.kind == "prediction":
                held["predictions"].append([int(r.ms), int(r.sequence), r.id])
            elif r.id not in done:
                done.add(r.id)
                held["bound"].append(r.id)
                best = max((p for p in held["predictions"] if p[0] < r.ms and p[1] < r.sequence), default=None)
                out.append((r.id, r.market_id, r.cost < 1, best and best[2], best and best[0], "bound_strictly_prior_score" if best else "unbound_no_strictly_prior_score"))
        state.update((json.dumps(held),))
        names = [c.split()[0] for c in BOUND.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"prediction_ms": "Int64"})

    rows = events.select(F.lower("market_id").alias("market_id"), "kind", "id", "ms", "sequence", F.col("cost").cast("double").alias("cost"))
    return rows.groupBy("market_id").applyInPandasWithState(step, BOUND, "state string", "append", "NoTimeout")


REVISION = "open_epoch bigint, sequence bigint, fingerprint string, supersedes_sequence bigint"


def candle_revision_stream(polled: DataFrame, now: Column, interval: int = 60) -> DataFrame:
    """Rows to append for polled candles (open_epoch, sequence, fingerprint): closed ones only, the first and every changed version."""

    def step(key, frames, state):
        last = list(state.get) if state.exists else [None, None]
        out = []
        for r in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.sequence):
            if r.fingerprint != last[0]:
                out.append((int(r.open_epoch), int(r.sequence), r.fingerprint, last[1]))
                last = [r.fingerprint, int(r.sequence)]
        state.update(tuple(last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REVISION.split(", ")]).astype({"supersedes_sequence": "Int64"})

    closed = polled.where(F.col("open_epoch") + interval <= now).select("open_epoch", "sequence", "fingerprint")
    return closed.groupBy("open_epoch").applyInPandasWithState(step, REVISION, "fingerprint string, sequence bigint", "append", "NoTimeout")


def score_vectors(rows: DataFrame, models: dict) -> DataFrame:
    """rows + predicted_<name> and probability_<name> of every model, all over the same inputs; unknown inputs get each model's own fill."""
    for name, model in models.items():
        rows = model.score(rows).withColumnsRenamed({"predicted": f"predicted_{name}", "probability": f"probability_{name}"})
    return rows


def run_scoring_query(stream: DataFrame, models, out_path: str, checkpoint: str):
    """Scores feature snapshots batch by batch: the attempt is written before the predictions; a batch that is run again
    replaces its own folders, so each snapshot is scored once. models: one model, or several by name."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("*").withColumn("attempted_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out_path}/attempts/batch={number}")
        scored = score_vectors(batch, models) if isinstance(models, dict) else models.score(batch)
        scored.write.mode("overwrite").parquet(f"{out_path}/predictions/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_stages(stages: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Runs the engine's stages over the shared log folder in their order, each a query with its own checkpoint, so a stage
    that is started again goes on where it stopped; a stage that fails stops those after it."""
    return {name: start() for name, start in stages.items()}
