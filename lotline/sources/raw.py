"""Files: raw pages with their manifest, stored fills, candle pages, target configuration.

Raw pages are kept as they came; everything else is Parquet or JSON read with explicit schemas.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.schemas import MANIFEST, STORED_FILL

RAW_PAGE = "array<map<string,string>>"
#: The largest offset that the public API serves.
OFFSET_CEILING = 10_000


def endpoint_url(base: str, account: str, limit: int, offset: int, window_start: int | None = None, window_end: int | None = None) -> str:
    """The request's address, for provenance."""
    window = "".join(f"&{k}={v}" for k, v in (("start", window_start), ("end", window_end)) if v is not None)
    return f"{base}/trades?user={account}&limit={limit}&offset={offset}&takerOnly=false{window}"


def write_raw_page(folder: str, account: str, offset: int, fetched_at: datetime, content: bytes, limit: int, endpoint: str = "", window: tuple[int, int] | None = None) -> str:
    """Stores one response and appends its manifest line; a name holds the content's hash, so writing again is harmless."""
    os.makedirs(folder, exist_ok=True)
    digest = hashlib.sha256(content).hexdigest()
    path = os.path.join(folder, f"{account}_{offset:09d}_{fetched_at:%Y%m%dT%H%M%SZ}_{digest[:12]}.json")
    with open(path + ".part", "wb") as file:
        file.write(content)
    os.replace(path + ".part", path)
    line = {"account": account, "offset": offset, "limit": limit, "page_path": path, "sha256": digest, "record_count": len(json.loads(content)), "fetched_at": fetched_at.isoformat(), "endpoint": endpoint}
    line |= {"window_start": window[0], "window_end": window[1]} if window else {}
    with open(os.path.join(folder, "manifest.jsonl"), "a", encoding="utf-8") as file:
        file.write(json.dumps(line, sort_keys=True) + "\n")
    return path


def archive(folder: str, content: bytes) -> str:
    """Content-addressed store: a file for each content, verified where it is there already."""
    path = os.path.join(folder, hashlib.sha256(content).hexdigest() + ".bin")
    os.makedirs(folder, exist_ok=True)
    try:
        with open(path, "xb") as file:
            file.write(content)
    except FileExistsError:
        with open(path, "rb") as file:
            if file.read() != content:
                raise ValueError(f"{path} holds other content") from None
    return path


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines; a missing file gives no rows, blank lines are skipped."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(path)


def completed_offsets(manifest: DataFrame) -> DataFrame:
    """(account, offsets) of pages taken without a window."""
    return manifest.where("window_start IS NULL AND window_end IS NULL").groupBy("account").agg(F.array_sort(F.collect_set("offset")).alias("offsets"))


def completed_window_offsets(manifest: DataFrame) -> DataFrame:
    rows = manifest.where("window_start IS NOT NULL AND window_end IS NOT NULL")
    return rows.groupBy("account", "window_start", "window_end").agg(F.array_sort(F.collect_set("offset")).alias("offsets"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_path, record_index, record map<string,string>): numbers stay text, so decimals stay exact."""
    pages = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("page_path"), F.from_json("value", RAW_PAGE).alias("records"))
    return pages.select("page_path", F.posexplode("records").alias("record_index", "record"))


def write_fills(fills: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with the stored schema, also for an empty table."""
    stored = [c.split(" ", 1) for c in STORED_FILL.split(", ")]
    fills.select(*[F.col(n).cast(t).alias(n) for n, t in stored]).write.mode(mode).parquet(path)


def load_fills(spark: SparkSession, path: str, account: str | None = None) -> DataFrame:
    """Stored fills with exact decimals; empty optional texts are null; an account is pushed to the scan."""
    from lotline.schemas import FILL

    rows = spark.read.schema(STORED_FILL).parquet(path)
    rows = rows if account is None else rows.where(F.col("account") == account)
    kinds = dict(c.split(" ", 1) for c in FILL.split(", "))
    optional = {"transaction_hash", "slug", "event_slug", "title"}
    return rows.select(*[(F.nullif(F.col(n), F.lit("")) if n in optional else F.col(n)).cast(t).alias(n) for n, t in kinds.items()])


def upsert_fills(target: DataFrame, new: DataFrame, key: str = "source_trade_id", order: list | None = None) -> DataFrame:
    """Rows of `new` that are not in `target`, the first of each key in `order`; append them to the target."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*(order or [key])))).where("__n = 1").drop("__n")
    return first.join(target.select(key), key, "left_anti")


def upsert_counts(target: DataFrame, new: DataFrame, key: str = "source_trade_id") -> DataFrame:
    """One row: how many rows of `new` an upsert inserts (the first of each key that the target lacks) and skips."""
    seen = target.select(key).distinct().withColumn("__seen", F.lit(True))
    each = new.groupBy(key).agg(F.count("*").alias("n")).join(seen, key, "left")
    inserted = F.count_if(F.col("__seen").isNull())
    return each.agg(inserted.alias("inserted"), (F.coalesce(F.sum("n"), F.lit(0)) - inserted).alias("skipped"))


def parse_candle_pages(pages: DataFrame, interval: int = 60) -> DataFrame:
    """Candles from (page_no, value): rows are [time, low, high, open, close, volume]; of an epoch the last page wins."""
    rows = pages.select("page_no", F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    row = F.struct(*[F.col("r")[i].cast("decimal(18,8)").alias(n) for i, n in ((3, "open"), (2, "high"), (1, "low"), (4, "close"))])
    last = rows.groupBy(F.col("r")[0].cast("bigint").alias("open_epoch")).agg(F.max_by(row, F.col("page_no")).alias("x"))
    return last.select("open_epoch", "x.*", F.lit(interval).alias("interval_seconds"))


#: Reasons that set a candle row aside, in the order in which they are checked.
CANDLE_REASONS = ("short_row", "not_a_number", "not_aligned", "negative_value", "high_below_low")


def check_candle_rows(pages: DataFrame, interval: int = 60) -> DataFrame:
    """(page_no, row_no, open_epoch, open, high, low, close, volume, reason) of every row of the pages (page_no, value); reason is null for good rows.

    Rows are [time, low, high, open, close, volume]. A page that is no list has one row without values, of reason `short_row`.
    """
    rows = pages.select("page_no", F.posexplode_outer(F.from_json("value", "array<string>")).alias("row_no", "row")).withColumn("c", F.from_json("row", "array<string>"))
    number = lambda i: F.expr(f"try_cast(get(c, {i}) AS DECIMAL({28 if i == 5 else 18},8))")
    names = {"low": 1, "high": 2, "open": 3, "close": 4, "volume": 5}
    out = rows.select("page_no", "row_no", F.coalesce(F.size("c"), F.lit(-1)).alias("n"), F.expr("try_cast(get(c, 0) AS BIGINT)").alias("open_epoch"), *[number(i).alias(k) for k, i in names.items()])
    unknown = F.col("open_epoch").isNull()
    for k in names:
        unknown = unknown | F.col(k).isNull()
    checks = (F.col("n") < 6, unknown, F.pmod(F.col("open_epoch"), F.lit(interval)) != 0, F.least(*names) < 0, F.col("high") < F.col("low"))
    reason = F.lit(None).cast("string")
    for name, check in reversed(list(zip(CANDLE_REASONS, checks, strict=True))):
        reason = F.when(check, name).otherwise(reason)
    return out.select("page_no", "row_no", "open_epoch", "open", "high", "low", "close", "volume", reason.alias("reason"))


def accepted_candles(checked: DataFrame, interval: int = 60) -> DataFrame:
    """Candles of the good rows; of an epoch the last page, and in it the last row, wins."""
    row = F.struct("open", "high", "low", "close")
    last = checked.where("reason IS NULL").groupBy("open_epoch").agg(F.max_by(row, F.struct("page_no", "row_no")).alias("x"))
    return last.select("open_epoch", "x.*", F.lit(interval).alias("interval_seconds"))


def candle_provenance(pages: DataFrame, start: int, end: int, interval: int = 60) -> DataFrame:
    """One row: what was asked for, what came, and a hash of the pages in their order, over the hashes of each."""
    good = accepted_candles(check_candle_rows(pages, interval), interval)
    came = good.agg(F.min("open_epoch").alias("first_epoch"), F.max("open_epoch").alias("last_epoch"), F.count("*").alias("candles"))
    each = F.struct("page_no", F.sha2(F.coalesce("value", F.lit("")).cast("binary"), 256).alias("h"))
    asked = pages.agg(F.count("*").alias("pages"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(each)), lambda x: x["h"])).cast("binary"), 256).alias("pages_sha256"))
    return asked.crossJoin(came).select(F.lit(start).cast("bigint").alias("start"), F.lit(end).cast("bigint").alias("end"), "pages", "pages_sha256", "first_epoch", "last_epoch", "candles")  # two single rows


def retried(fetch, attempts: int = 5, busy: int = 429, sleep=time.sleep):
    """fetch(params) -> (status, body), asked again while the source is busy: after 1, 2, 4 ... seconds, at most `attempts` times in all.

    What comes last is returned; a status of 400 or more is an error.
    """

    def ask(params):
        for attempt in range(attempts):
            status, body = fetch(params)
            if status != busy or attempt == attempts - 1:
                break
            sleep(float(2**attempt))
        if status >= 400:
            raise OSError(f"status {status} for {params}")
        return body

    return ask


def collect_candles(spark: SparkSession, fetch, start: int, end: int, path: str, **options) -> DataFrame:
    """Asks for the ranges from warm-up to end, keeps the pages as they came in `path`, and returns them (page_no, value)."""
    ask = retried(fetch, **options)
    pages = [(i, ask({"start": a, "end": b})) for i, (a, b) in enumerate(candle_requests(start, end))]
    spark.createDataFrame(pages, "page_no bigint, value string").coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("page_no bigint, value string").json(path)


def candle_requests(start: int, end: int, warm_up: int = 180, interval: int = 60, chunk: int = 240) -> list[tuple[int, int]]:
    """Half-open request ranges that cover start - warm_up to end."""
    step = interval * chunk
    return [(a, min(a + step, end)) for a in range(start - warm_up, end, step)]


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("multiLine", True).schema("nickname string, wallet string, status string, notes string").json(path)
    return rows.withColumn("status", F.coalesce("status", F.lit("unverified")))
