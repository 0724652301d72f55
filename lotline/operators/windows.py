"""Collection windows: planning, subdivision at the offset ceiling, completeness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.sources.raw import OFFSET_CEILING

RESULT = "window_start bigint, window_end bigint, records bigint, exhausted boolean, ceiling_hit boolean"


def generate_windows(spark: SparkSession, start: int, end: int, seconds: int = 30 * 86400) -> DataFrame:
    """(window_start, window_end): half-open, without overlap, the last one cut at the end; none if start >= end."""
    if seconds <= 0:
        raise ValueError("windows need a positive length")
    if start >= end:
        return spark.createDataFrame([], "window_start bigint, window_end bigint")
    rows = spark.range(start, end, seconds).withColumnRenamed("id", "window_start")
    return rows.withColumn("window_end", F.least(F.col("window_start") + seconds, F.lit(end)))


def daily_windows(windows: DataFrame) -> DataFrame:
    """Adds an id as 2026-07-01T12-18Z."""
    at = lambda c, f: F.date_format(F.timestamp_seconds(F.col(c)), f)
    return windows.withColumn("window_id", F.concat(at("window_start", "yyyy-MM-dd'T'HH"), F.lit("-"), at("window_end", "HH"), F.lit("Z")))


@dataclass(frozen=True)
class WindowResult:
    window_start: int
    window_end: int
    records: int
    exhausted: bool
    ceiling_hit: bool


def collect_window(fetch: Callable[[int, int, int, int], int], start: int, end: int, limit: int = 500, done: frozenset[int] = frozenset()) -> WindowResult:
    """Pages through one window: a short page ends it, an offset beyond the ceiling too. fetch(start, end, offset, limit) gives a page's size; done offsets count as full."""
    total, offset = 0, 0
    while offset <= OFFSET_CEILING:
        n = limit if offset in done else fetch(start, end, offset, limit)
        total += n
        if n < limit:
            return WindowResult(start, end, total, True, False)
        offset += limit
    return WindowResult(start, end, total, False, True)


def collect_subdivided(fetch: Callable[[int, int, int, int], int], start: int, end: int, seconds: int, least: int, limit: int = 500) -> list[WindowResult]:
    """Windows in order; one that hits the ceiling is halved down to `least` seconds. Parents stay in the list beside their halves."""
    out: list[WindowResult] = []
    todo = [(a, min(a + seconds, end)) for a in range(start, end, seconds)][::-1]
    while todo:
        a, b = todo.pop()
        out.append(collect_window(fetch, a, b, limit))
        if out[-1].ceiling_hit and b - a > least:
            middle = a + (b - a) // 2
            todo += [(middle, b), (a, middle)]
    return out


def subdivide(counts: DataFrame, start: int, end: int, ceiling: int, least: int, levels: int = 12) -> DataFrame:
    """The same plan where arrivals are known: (epoch) rows are counted per window, and windows over the ceiling are halved, level by level."""
    spark = counts.sparkSession
    now = spark.createDataFrame([(start, end)], "window_start bigint, window_end bigint")
    out = None
    for _ in range(levels):
        hit = now.join(counts, (F.col("epoch") >= F.col("window_start")) & (F.col("epoch") < F.col("window_end")), "left").groupBy("window_start", "window_end").agg(F.count("epoch").alias("records"))
        hit = hit.withColumn("ceiling_hit", F.col("records") > ceiling)
        out = hit if out is None else out.unionByName(hit)
        wide = hit.where(F.col("ceiling_hit") & (F.col("window_end") - F.col("window_start") > least))
        if not wide.limit(1).count():
            break
        middle = F.col("window_start") + F.floor((F.col("window_end") - F.col("window_start")) / 2)
        now = wide.select("window_start", middle.alias("window_end")).unionByName(wide.select(middle.alias("window_start"), "window_end"))
    return out


def completeness(results: DataFrame) -> DataFrame:
    """One row: windows, unresolved ones (ceiling hit or not exhausted), and which they are."""
    bad = F.col("ceiling_hit") | ~F.col("exhausted")
    return results.agg(F.count("*").alias("windows"), F.count_if(bad).alias("unresolved"), F.array_sort(F.collect_list(F.when(bad, F.struct("window_start", "window_end")))).alias("unresolved_windows"))
