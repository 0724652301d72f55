"""The append-only event log: writing, reading, integrity, health."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.operators.ranges import with_previous
from lotline.schemas import EVENT


class EventLog:
    """A single writer's NDJSON file with contiguous sequences; every line reaches the disk before append returns."""

    def __init__(self, path: str):
        self.path = path
        self.size, self.next_sequence = 0, 0
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                for line in file:
                    record = json.loads(line) if line.strip() else None
                    if not isinstance(record, dict) or record.get("sequence") != self.next_sequence:
                        raise ValueError(f"line {self.next_sequence} of {path} is no record or leaves a gap")
                    self.next_sequence += 1
            self.size = os.path.getsize(path)

    def append(self, record: dict) -> None:
        if record.get("sequence") != self.next_sequence:
            raise ValueError(f"expected sequence {self.next_sequence}")
        if (os.path.getsize(self.path) if os.path.exists(self.path) else 0) != self.size:
            raise ValueError("the file was changed by someone else")
        line = (json.dumps(record, sort_keys=True, separators=(",", ":")) + "\n").encode()
        with open(self.path, "ab") as file:
            file.write(line)
            file.flush()
            os.fsync(file.fileno())
        self.size += len(line)
        self.next_sequence += 1

    def records_from(self, offset: int) -> tuple[list[dict], int]:
        """Records from a byte offset on, and the offset after them; the offset must be a record's border."""
        with open(self.path, "rb") as file:
            if offset:
                file.seek(offset - 1)
                if file.read(1) != b"\n":
                    raise ValueError("offset is within a record")
            rest = file.read()
        if rest and not rest.endswith(b"\n"):
            raise ValueError("the last record is incomplete")
        return [json.loads(x) for x in rest.splitlines()], offset + len(rest)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records with the payload as JSON text; lines that are none have only nulls."""
    return spark.read.text(path).select(F.from_json("value", EVENT).alias("r")).select("r.*")


def stream_log(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The log folder as a stream: each new file is read once, by the query's checkpoint."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.from_json("value", EVENT).alias("r")).select("r.*")


def integrity(log: DataFrame, order: str = "line") -> DataFrame:
    """Lines that break the log's rules: a record missing, a sequence that does not follow the one before (it resumes from there), or a wrong id."""
    rows = with_previous(log, "run_id", order, {"expected": (F.col("sequence") + 1, F.lit(True))}).withColumn("expected", F.coalesce("expected", F.lit(0).cast("bigint")))
    reason = F.when(F.col("sequence").isNull(), "not_a_record").when(F.col("sequence") != F.col("expected"), "sequence_gap").when(F.col("event_id") != F.concat_ws(":", "run_id", F.col("sequence").cast("string")), "event_id_mismatch")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("run_id", order, "sequence", "expected", "reason")


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("events"), F.min("created_ms").alias("first_ms"), F.max("created_ms").alias("last_ms"))


def source_health(log: DataFrame) -> DataFrame:
    """The last status of each source and how many of each kind it had."""
    return log.groupBy("source").agg(F.max_by("status", "sequence").alias("last_status"), F.max("sequence").alias("last_sequence"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))


def monitor(log: DataFrame, now_ms: int, recent_ms: int = 900_000) -> DataFrame:
    """One row a run: age of the last event, the largest gap of the recent window, and a status ladder."""
    recent = F.col("created_ms") >= now_ms - recent_ms
    gap = F.col("created_ms") - F.col("__before")
    rows = with_previous(log, "run_id", "sequence", {"__before": (F.col("created_ms"), F.lit(True))}).withColumn("__gap", F.when((gap >= 0) & recent, gap))
    out = rows.groupBy("run_id").agg(F.count("*").alias("events"), (F.lit(now_ms) - F.max("created_ms")).alias("age_ms"), F.max("__gap").alias("largest_gap_ms"))
    worst = lambda a, b: (F.col("age_ms") > a) | (F.coalesce("largest_gap_ms", F.lit(0)) > b)
    return out.withColumn("status", F.when(worst(60_000, 60_000), "critical").when(worst(10_000, 15_000), "degraded").otherwise("healthy"))


def candle_revisions(rows: DataFrame) -> DataFrame:
    """(open_epoch, sequence, fingerprint) in arrival order to rows to append: the first and every changed one, with what it supersedes; repeats go."""
    w = Window.partitionBy("open_epoch").orderBy("sequence")
    before = F.lag(F.struct("fingerprint", "sequence")).over(w)
    out = rows.withColumn("__b", before)
    return out.where("__b IS NULL OR __b.fingerprint <> fingerprint").withColumn("supersedes_sequence", F.lag("sequence").over(w)).drop("__b")
