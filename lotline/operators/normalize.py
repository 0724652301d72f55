"""Raw records to validated fills, with the first failing reason of each rejected record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions import scalars as S
from lotline.schemas import PRICE, SHARES

REQUIRED = ("asset", "conditionId", "outcome", "price", "proxyWallet", "side", "size", "timestamp")
KNOWN = (*REQUIRED, "id", "transactionHash", "slug", "eventSlug", "title", "outcomeIndex", "takerOrderId", "feeRateBps", "status", "lastUpdate", "bucketIndex", "makerAddress")
OPTIONAL = ("id", "transactionHash", "slug", "eventSlug", "title", "outcomeIndex")


def missing_fields(numeric_zero_counts: tuple[str, ...] = ()):
    """Sorted names of required fields that are absent or empty; in the named fields a JSON number 0 also counts as absent."""
    checks = []
    for name in sorted(REQUIRED):
        absent = F.coalesce(F.col(name), F.lit("")) == ""
        if name in numeric_zero_counts:
            absent = absent | (F.col(name).try_cast("double") == 0)
        checks.append(F.when(absent, F.lit(name)))
    return F.array_compact(F.array(*checks))


def normalize_records(records: DataFrame, page_cols: tuple[str, ...] = (), order_col: str | None = None, source: str = "public_api", numeric_zero_counts: tuple[str, ...] = ()) -> DataFrame:
    """Every record with its typed fields, `source_trade_id`, `status` (accepted, rejected or duplicate) and `reject_reason`.

    Duplicates are found among the valid records of one page (page_cols), the first in order_col is accepted.
    Values are text, so decimals stay exact; columns not known are passed through.
    """
    rows = records
    for name in (*REQUIRED, *OPTIONAL):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    missing = missing_fields(numeric_zero_counts)
    price, shares, ts = S.parse_decimal(F.col("price"), PRICE), S.parse_decimal(F.col("size"), SHARES), S.parse_epoch(F.col("timestamp"))
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_fields:"), F.array_join(missing, ",")))
        .when(~F.col("side").isin("BUY", "SELL"), "invalid_side")
        .when(price.isNull(), "invalid_price")
        .when((price < 0) | (price > 1), "price_out_of_range")
        .when(shares.isNull(), "invalid_size")
        .when(shares <= 0, "non_positive_size")
        .when(ts.isNull(), "invalid_timestamp")
        .when(~S.plausible(ts), "implausible_timestamp")
    )
    digest = S.identity_hash(account=F.col("proxyWallet"), asset=F.col("asset"), price=F.col("price"), side=F.col("side"), size=F.col("size"), timestamp=F.col("timestamp"), transaction_hash=F.col("transactionHash"))
    out = rows.select("*", reason.alias("reject_reason"), F.coalesce(F.nullif(F.col("id"), F.lit("")), digest).alias("source_trade_id"), price.alias("__price"), shares.alias("__shares"), ts.alias("__ts"))
    number = F.row_number().over(Window.partitionBy(*page_cols, "source_trade_id", F.col("reject_reason").isNull()).orderBy(order_col or "source_trade_id"))
    out = out.withColumn("status", F.when(F.col("reject_reason").isNotNull(), "rejected").when(number > 1, "duplicate").otherwise("accepted"))
    extra = [c for c in records.columns if c not in KNOWN]
    return out.select(
        F.lit(source).alias("source"), "source_trade_id", F.col("proxyWallet").alias("account"), F.col("conditionId").alias("market_id"), F.col("asset").alias("asset_id"), F.col("__ts").alias("timestamp"),
        "outcome", "side", F.col("__price").alias("price"), F.col("__shares").alias("shares"), F.col("transactionHash").alias("transaction_hash"), F.col("outcomeIndex").try_cast("bigint").alias("outcome_index"),
        "slug", F.col("eventSlug").alias("event_slug"), "title", "status", "reject_reason", *extra,
    )


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("status") == "accepted").drop("status", "reject_reason")


def residual(record, provenance: dict | None = None):
    """JSON text of the unknown keys of a record map, with provenance values added."""
    rest = F.map_filter(record, lambda k, v: ~k.isin(*KNOWN))
    more = F.create_map(*[x for k, v in sorted((provenance or {}).items()) for x in (F.lit(k), v.cast("string"))]) if provenance else None
    return F.to_json(F.map_concat(rest, more) if more is not None else rest)


def validation_report(normalized: DataFrame) -> DataFrame:
    """One row: counts, time range, and whether nothing was rejected or repeated."""
    n = lambda s: F.count_if(F.col("status") == s)
    ok = F.col("status") == "accepted"
    return normalized.agg(F.count("*").alias("total"), n("accepted").alias("accepted"), n("rejected").alias("invalid"), n("duplicate").alias("duplicates"), F.min(F.when(ok, F.col("timestamp"))).alias("first_ts"), F.max(F.when(ok, F.col("timestamp"))).alias("last_ts"), (n("rejected") + n("duplicate") == 0).alias("clean"))


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (cross-window dedup)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
