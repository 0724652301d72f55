"""Schemas of the engine's tables. Money and shares are exact decimals; ratios are doubles."""

PRICE = "decimal(10,8)"
SHARES = "decimal(18,8)"

#: A validated fill.
FILL = f"source string, source_trade_id string, account string, market_id string, asset_id string, timestamp timestamp, outcome string, side string, price {PRICE}, shares {SHARES}, transaction_hash string, outcome_index bigint, slug string, event_slug string, title string, raw_extra string"
#: The same at rest: decimals as text keep their precision whatever the reader.
STORED_FILL = FILL.replace(PRICE, "string").replace(SHARES, "string")
#: A reference candle; it is seen from its close on.
CANDLE = "open_epoch bigint, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), interval_seconds int"
#: A record of the append-only event log.
EVENT = "schema_version string, event_type string, event_id string, run_id string, sequence bigint, created_at string, payload string, supersedes_event_id string"
#: A line of the raw page manifest.
MANIFEST = "account string, offset bigint, limit bigint, page_path string, sha256 string, record_count bigint, fetched_at string, endpoint string, window_start bigint, window_end bigint"
