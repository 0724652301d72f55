"""Poll stages as streams over page files, and several stages run together.

A poller writes each response as one JSON line (poll_id, account, received_ms, http_status, body) into a folder; http_status is null
where nothing came back. The stage reads new files once, by its checkpoint, and writes raw, health, admission and fill
events. A batch that is run again replaces its own folders, and trades that an earlier batch has settled are left out, so a restart
adds nothing. Settled trades are kept by the day of the trade, and a batch reads those of its own days only.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.operators.markets import latest, side_of_token
from lotline.operators.normalize import KNOWN, normalize_records

PAGE = "poll_id string, account string, received_ms bigint, http_status int, body string"
SETTLED = "source_trade_id string, market_id string, asset_id string, admitted boolean, reason_code string, outcome_side string, disagrees boolean, poll_id string, record_index int, received_ms bigint, side string, price decimal(10,8), shares decimal(18,8), timestamp timestamp, day date, batch bigint"


def poll_status(pages: DataFrame) -> DataFrame:
    """pages + `records` (JSON texts of the body's objects) and `status`: null for a good poll, else what is wrong with it.

    A body that is no list of objects can't be parsed; a record of another account than the polled one (letters' case aside)
    spoils the whole page.
    """
    items = F.when(F.ltrim("body").startswith("["), F.from_json("body", "array<string>"))
    objects = F.coalesce(F.forall(items, lambda x: F.coalesce(F.ltrim(x).startswith("{") & F.from_json(x, "map<string,string>").isNotNull(), F.lit(False))), F.lit(False))
    wallet = lambda x: F.lower(F.coalesce(F.get_json_object(x, "$.proxyWallet"), F.lit("")))
    alien = F.exists(items, lambda x: ~wallet(x).isin("") & (wallet(x) != F.lower("account")))
    status = F.when(F.col("http_status").isNull(), "transport_failed").when(~F.col("http_status").between(200, 299), "request_failed").when(~objects, "parse_failed").when(alien, "account_mismatch")
    return pages.withColumn("status", status).withColumn("records", F.when(F.col("status").isNull(), items))


def normalized_polls(checked: DataFrame) -> DataFrame:
    """Typed records of the good pages, with their page and place; `status` says which are accepted, rejected or repeated in their page."""
    rows = checked.where("status IS NULL").select("poll_id", "received_ms", F.posexplode("records").alias("record_index", "x")).withColumn("m", F.from_json("x", "map<string,string>"))
    rows = rows.select("poll_id", "received_ms", "record_index", *[F.try_element_at("m", F.lit(k)).alias(k) for k in KNOWN if k != "status"])
    return normalize_records(rows, ("poll_id",), "record_index")


def settled_trades(normalized: DataFrame, metadata: DataFrame, before: DataFrame | None) -> DataFrame:
    """The admission of each accepted trade that isn't settled: the first time it comes, by poll time, poll and place.

    metadata: (market_id, sequence, eligible, reason_code, token_sides); of a market the latest record counts, letters' case aside.
    """
    good = normalized.where("status = 'accepted'").withColumn("day", F.to_date("timestamp"))
    first = F.row_number().over(Window.partitionBy("source_trade_id").orderBy("received_ms", "poll_id", "record_index"))
    rows = good.withColumn("__n", first).where("__n = 1")
    if before is not None:
        rows = rows.join(before.select("source_trade_id", "day"), ["source_trade_id", "day"], "left_anti")
    known = latest(metadata.withColumn("market_id", F.lower("market_id")), ["market_id"]).select(F.col("market_id").alias("__m"), "eligible", F.col("reason_code").alias("__reason"), "token_sides")
    rows = rows.join(known, F.lower("market_id") == F.col("__m"), "left")
    ok = F.coalesce("eligible", F.lit(False))
    side = F.when(ok, side_of_token(F.col("token_sides"), F.col("asset_id")))
    reason = F.when(~ok, F.concat(F.lit("market_"), F.coalesce("__reason", F.lit("unknown")))).when(side.isNull(), "asset_not_in_durable_token_mapping").otherwise("eligible_market_asset_mapping")
    rows = rows.withColumn("outcome_side", side).withColumn("admitted", F.col("outcome_side").isNotNull()).withColumn("reason_code", reason)
    return rows.withColumn("disagrees", F.col("admitted") & ~F.upper(F.trim("outcome")).eqNullSafe(F.col("outcome_side"))).select(*[c.split()[0] for c in SETTLED.split(", ") if not c.startswith("batch")])


def raw_events(checked: DataFrame) -> DataFrame:
    """One event for each response: where it came from and a hash of its body."""
    body = F.coalesce("body", F.lit("")).cast("binary")
    return checked.where("http_status IS NOT NULL").select("poll_id", "account", "received_ms", "http_status", F.sha2(body, 256).alias("response_sha256"), F.octet_length(body).alias("body_size"))


def health_events(checked: DataFrame, normalized: DataFrame, settled: DataFrame) -> DataFrame:
    """(poll_id, received_ms, status, records, rejected, new_fills, not_admitted): a row for each poll, and one for each trade whose text and token disagree."""
    each = normalized.groupBy("poll_id").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    new = settled.groupBy("poll_id").agg(F.count_if("admitted").alias("new_fills"), F.count_if(~F.col("admitted")).alias("not_admitted"))
    polls = checked.select("poll_id", "received_ms", F.coalesce("status", F.lit("poll_ok")).alias("status")).join(each, "poll_id", "left").join(new, "poll_id", "left").fillna(0, ["records", "rejected", "new_fills", "not_admitted"])
    zero = F.lit(0).cast("bigint")
    odd = settled.where("disagrees").select("poll_id", "received_ms", F.lit("outcome_mapping_disagreement").alias("status"), *[zero.alias(c) for c in ("records", "rejected", "new_fills", "not_admitted")])
    return polls.unionByName(odd)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def collect_batch(pages: DataFrame, number: int, metadata: DataFrame, out: str) -> None:
    """Writes the events of some pages below out/{raw,health,settled}/batch=<number>; polls that come twice in a batch count once."""
    spark = pages.sparkSession
    checked = poll_status(pages.dropDuplicates(["poll_id"])).persist()
    try:
        normalized = normalized_polls(checked)
        days = [r[0] for r in normalized.where("status = 'accepted'").select(F.to_date("timestamp")).distinct().collect()]
        before = _read(spark, f"{out}/settled", SETTLED)
        if before is not None:
            before = before.where((F.col("batch") < number) & F.col("day").isin(days))
        path = f"{out}/settled/batch={number}"
        settled_trades(normalized, metadata, before).write.mode("overwrite").partitionBy("day").parquet(path)
        settled = spark.read.schema(", ".join(c for c in SETTLED.split(", ") if not c.startswith("batch"))).parquet(path)
        raw_events(checked).write.mode("overwrite").parquet(f"{out}/raw/batch={number}")
        health_events(checked, normalized, settled).write.mode("overwrite").parquet(f"{out}/health/batch={number}")
    finally:
        checked.unpersist()


def collector(spark: SparkSession, folder: str, out: str, checkpoint: str, metadata: Callable[[SparkSession], DataFrame], max_files: int = 100, once: bool = True, seconds: int = 1):
    """Starts the stage over the folder of page files; once: ends when all files there are read, else goes on at a beat of `seconds`."""
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", max_files).json(folder)
    writer = pages.writeStream.foreachBatch(lambda batch, number: collect_batch(batch, number, metadata(spark), out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def fill_events(spark: SparkSession, out: str) -> DataFrame:
    """The admitted fills of all batches so far, with their page, place and token's side."""
    rows = _read(spark, f"{out}/settled", SETTLED)
    return (spark.createDataFrame([], SETTLED) if rows is None else rows).where("admitted").drop("admitted", "reason_code")


# ---------------------------------------------------------------- cadence and stages together


def cadence(spark: SparkSession, tick: Callable[[int, int], None], frozen: Callable[[], int], checkpoint: str, seconds: int = 1):
    """Calls tick(second, cutoff) for every second that a live trigger fires; the cutoff, what `frozen` says the log ends with, is taken before
    the first of a batch and holds for all of it, so what is appended meanwhile belongs to the next. A batch that is run again after a
    crash calls its seconds again, with the cutoff of then; `tick` names what it writes by the second."""

    def step(batch: DataFrame, number: int) -> None:
        cutoff = frozen()
        for (second,) in batch.select(F.unix_timestamp("timestamp").alias("s")).distinct().orderBy("s").collect():  # seconds of one batch
            tick(second, cutoff)

    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beat.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


class StageFailed(RuntimeError):
    """A stage ended with an error; the others were stopped."""


def run_together(stages: dict[str, Callable[[], object]], until: Callable[[], bool] | None = None, poll: float = 0.2) -> None:
    """Starts all stages (functions that return a streaming query) and waits until all have ended or `until` holds; the first that
    fails stops the others. Each stage has its own checkpoint, so what is started again goes on where it stopped."""
    running: dict[str, object] = {}
    try:
        for name, start in stages.items():
            running[name] = start()
        while any(q.isActive for q in running.values()) and not (until and until()):
            for name, q in running.items():
                if not q.isActive and q.exception() is not None:
                    raise StageFailed(f"{name}: {str(q.exception())[:500]}")
            time.sleep(poll)
        for name, q in running.items():
            if not q.isActive and q.exception() is not None:
                raise StageFailed(f"{name}: {str(q.exception())[:500]}")
    finally:
        for q in running.values():
            if q.isActive:
                q.stop()
