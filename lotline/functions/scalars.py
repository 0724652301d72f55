"""Column expressions: labels, parsing, hashes. All of them are built-in functions, so plans stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the reports.
LATENCY_LABELS = ("0s", "1s", "2-5s", "6-15s", "16-30s", "31-60s", "61-120s", ">120s")
LATENCY_UPPER = (0, 1, 5, 15, 30, 60, 120)
BAND_LABELS = ("early_0_99", "middle_100_199", "late_200_299")
UP_NAMES = ("UP", "YES", "LONG")
DOWN_NAMES = ("DOWN", "NO", "SHORT")
SLUG = r"^btc-updown-5m-(\d+)$"
MARKET_SECONDS = 300
#: Epoch values from here on are milliseconds.
MILLIS_FROM = 100_000_000_000


def latency_bucket(lag: Column) -> Column:
    """Label of a lag in seconds; null counts as 0."""
    out = F.lit(LATENCY_LABELS[-1])
    for upper, label in reversed(list(zip(LATENCY_UPPER, LATENCY_LABELS))):
        out = F.when(lag <= upper, label).otherwise(out)
    return F.when(lag.isNull(), LATENCY_LABELS[0]).otherwise(out)


def market_time_bucket(elapsed: Column) -> Column:
    """Label of the 30 seconds of a market that a moment lies in; null outside it."""
    low = (F.floor(elapsed / 30) * 30).cast("int")
    return F.when((elapsed >= 0) & (elapsed < MARKET_SECONDS), F.concat_ws("-", low.cast("string"), (low + 29).cast("string")))


def market_time_bucket_labels() -> list[str]:
    return [f"{k}-{k + 29}" for k in range(0, MARKET_SECONDS, 30)]


def market_time_band(elapsed: Column) -> Column:
    inside = (elapsed >= 0) & (elapsed < MARKET_SECONDS)
    return F.when(inside, F.when(elapsed < 100, BAND_LABELS[0]).when(elapsed < 200, BAND_LABELS[1]).otherwise(BAND_LABELS[2]))


def timing_bucket(lag: Column, elapsed: Column) -> Column:
    """Lag class and third of the market, for the timing baseline."""
    a = F.when(lag.isNull(), "lag_unknown").when(lag <= 30, "lag_le_30").when(lag <= 60, "lag_31_60").when(lag <= 120, "lag_61_120").otherwise("lag_gt_120")
    b = F.when(elapsed.isNull(), "time_unknown").when(elapsed < 100, "early").when(elapsed < 200, "middle").otherwise("late")
    return F.concat_ws("|", a, b)


def market_start(slug: Column) -> Column:
    """Start epoch in the slug of a five-minute market, null for any other slug."""
    return F.nullif(F.regexp_extract(slug, SLUG, 1), F.lit("")).try_cast("bigint")


def normalized_outcome(outcome: Column) -> Column:
    return F.upper(F.trim(outcome))


def outcome_side(outcome: Column) -> Column:
    """UP, DOWN or null."""
    name = normalized_outcome(outcome)
    return F.when(name.isin(*UP_NAMES), "UP").when(name.isin(*DOWN_NAMES), "DOWN")


def parse_epoch(text: Column) -> Column:
    """Whole seconds or milliseconds as text to a timestamp; anything else is null."""
    n = F.trim(text).try_cast("bigint")
    whole = F.trim(text).rlike(r"^[+-]?\d+$")
    return F.when(whole & (n >= MILLIS_FROM), F.timestamp_millis(n)).when(whole, F.timestamp_seconds(n))


def plausible(ts: Column) -> Column:
    """Between 2019-10-01 and 2040-01-01, both included."""
    return ts.between(F.timestamp_seconds(F.lit(1569888000)), F.timestamp_seconds(F.lit(2208988800)))


def parse_decimal(text: Column, kind: str) -> Column:
    """Exact decimal from text; bad text is null."""
    return F.trim(text).try_cast(kind)


def identity_hash(*, account: Column, asset: Column, price: Column, side: Column, size: Column, timestamp: Column, transaction_hash: Column) -> Column:
    """SHA-256 over compact JSON of the seven identifying fields with sorted keys; missing values are ''."""
    fields = {"asset": asset, "price": price, "proxyWallet": account, "side": side, "size": size, "timestamp": timestamp, "transactionHash": transaction_hash}
    parts = [F.concat(F.lit(f'"{k}":"'), F.coalesce(v.cast("string"), F.lit("")), F.lit('"')) for k, v in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def candle_fingerprint(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


def floor_minute(epoch: Column) -> Column:
    return epoch - F.pmod(epoch, F.lit(60))


def simple_return(now: Column, before: Column) -> Column:
    """now / before - 1; null if before is null or 0."""
    return F.try_divide(now.cast("double"), before.cast("double")) - 1


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def seconds_since(now: Column, then: Column) -> Column:
    """Whole seconds, never negative; null if there is no earlier moment."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0).cast("bigint"), (now - then).cast("bigint")))


def claim_status(measured: Column, target: float, tolerance: float) -> Column:
    return F.when(measured.isNull(), "inconclusive").when(F.abs(measured - F.lit(target)) <= tolerance, "supported").otherwise("not_supported")


def calibration_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), (p * bins).cast("int")))


def elapsed_days(start: Column, end: Column) -> Column:
    """Calendar days from start to end, both included."""
    return F.datediff(end, start) + 1


def strict_int(json_text: Column) -> Column:
    """A whole number out of a JSON value's text: true, "7" and 1.5 are none."""
    return F.when(json_text.rlike("^-?[0-9]+$"), json_text.try_cast("bigint"))


def one_of(c: Column, *allowed: str) -> Column:
    """The value if it is one of the allowed ones, else null."""
    return F.when(c.isin(*allowed), c)


def nearest_rank(ordered: Column, p: float) -> Column:
    """Element of a sorted array at (n - 1) * p, the index rounded half up."""
    return F.get(ordered, F.floor((F.size(ordered) - 1) * F.lit(p) + F.lit(0.5)).cast("int"))


def ceil_rank(ordered: Column, p: float) -> Column:
    """Element of a sorted array at ceil(n * p) - 1."""
    return F.get(ordered, F.greatest(F.lit(0), F.ceil(F.size(ordered) * F.lit(p)).cast("int") - 1))


def median_of(ordered: Column) -> Column:
    """Middle of a sorted array of doubles, the mean of two if their number is even."""
    n = F.size(ordered)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return (low.cast("double") + high.cast("double")) / 2
