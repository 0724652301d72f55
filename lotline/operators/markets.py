"""Market metadata: classification of lookup records, token sides, active markets, as-of values of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.functions import scalars as S


def string_array(c: Column) -> Column:
    """An array of strings out of JSON text; null if it is none."""
    return F.from_json(c, "array<string>")


def classify_lookup(records: DataFrame) -> DataFrame:
    """Adds eligible, reason_code, market_start and token_sides (map of token to UP or DOWN); outcomes and tokens pair by position."""
    names, tokens = F.transform(string_array(F.col("outcomes")), lambda x: F.upper(F.trim(x))), string_array(F.col("clobTokenIds"))
    start = S.market_start(F.col("slug"))
    reason = (
        F.when(start.isNull(), "slug_not_supported")
        .when(names.isNull() | tokens.isNull(), "invalid_outcome_arrays")
        .when((F.size(names) != 2) | (F.size(tokens) != 2), "expected_two_outcomes")
        .when(~F.array_sort(names).eqNullSafe(F.array(F.lit("DOWN"), F.lit("UP"))), "outcomes_not_up_down")
        .when(F.size(F.array_distinct(tokens)) != 2, "tokens_not_unique")
    )
    return records.withColumn("reason_code", reason).withColumn("eligible", F.col("reason_code").isNull()).withColumn("market_start", start).withColumn("token_sides", F.when(F.col("eligible"), F.map_from_arrays(tokens, names)))


def side_of_token(token_sides: Column, token: Column) -> Column:
    return F.try_element_at(token_sides, token)


def latest(rows: DataFrame, key: list[str], sequence: str = "sequence", as_of: int | None = None) -> DataFrame:
    """The row with the highest sequence of each key, at or before a sequence if one is given."""
    rows = rows if as_of is None else rows.where(F.col(sequence) <= as_of)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("x")).select(*key, "x.*")


def active_markets(metadata: DataFrame, epoch: int, as_of: int | None = None) -> DataFrame:
    """Ids of markets whose latest metadata is eligible and that run at the epoch."""
    rows = latest(metadata, ["market_id"], "sequence", as_of)
    return rows.where(F.col("eligible") & (F.col("market_start") <= epoch) & (F.col("market_start") + S.MARKET_SECONDS > epoch)).select("market_id", "market_start")


def active_markets_at(metadata: DataFrame, ticks: DataFrame, as_of: int | None = None) -> DataFrame:
    """(market_id, market_start, tick) of the markets that run at each tick; starts are multiples of a market's length, so slots meet by equality."""
    rows = latest(metadata, ["market_id"], "sequence", as_of).where("eligible").select("market_id", "market_start")
    slot = ticks.select("tick", (F.floor(F.col("tick") / S.MARKET_SECONDS) * S.MARKET_SECONDS).alias("market_start"))
    return rows.join(slot, "market_start").select("market_id", "market_start", "tick")


def metadata_gate(fills: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fills with the side of their token; admitted if their market has exactly one eligible lookup record."""
    one = metadata.groupBy("market_id").agg(F.count("*").alias("lookups"), F.first("eligible").alias("eligible"), F.first("token_sides").alias("token_sides"))
    rows = fills.join(one, "market_id", "left")
    ok = (F.coalesce("lookups", F.lit(0)) == 1) & F.coalesce("eligible", F.lit(False))
    token = side_of_token(F.col("token_sides"), F.col("asset_id"))
    return rows.withColumn("admitted", ok).withColumn("token_side", F.when(ok, token)).withColumn("side_disagrees", ok & token.isNotNull() & (token != F.col("oside"))).drop("lookups", "eligible", "token_sides")


def admit(raw: DataFrame, metadata: DataFrame, account: str | None = None) -> DataFrame:
    """Polled fills as the engine takes them: the first row of each id, admitted by the gate, with the token's side in place of the text's.

    `side_disagrees` says where the two differ. A fill of another account than the polled one is an error.
    """
    if account is not None:
        raw = raw.withColumn("account", F.when(F.col("account") == account, F.col("account")).otherwise(F.raise_error(F.lit("a fill of another account"))))
    first = raw.dropDuplicates(["source_trade_id"])
    rows = metadata_gate(first, metadata)
    return rows.withColumn("oside", F.when(F.col("admitted"), F.coalesce("token_side", "oside"))).drop("token_side")
