"""Sources, event log, streaming state, binding, windows, models, and queries against SQL."""

import json
from datetime import UTC, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from lotline.operators import binding, evaluation, markets, models, normalize, windows
from lotline.plans.oracle import ORACLES
from lotline.plans.queries import REGISTRY
from lotline.sources import eventlog, raw
from lotline.streaming import queries as streams
from lotline.streaming import state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "~"
    return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", ["normalize_accept_reject", "canonical_ledger", "market_summary", "fifo_latency_buckets", "lifo_pairs", "lifo_pairs_by_levels", "wavg_pairs", "hypothesis_summary", "regime_panel", "btc_asof_features", "lowo_timing_bucket", "strict_prior_binding", "log_integrity", "candle_revisions", "online_pairs", "tick_features"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = REGISTRY[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want and want


def test_raw_pages_and_normalisation(spark, tmp_path):
    page = [{"id": "a", "conditionId": "m", "asset": "x", "proxyWallet": "w", "outcome": "Up", "side": "BUY", "size": 200, "price": 0.44, "timestamp": 1727740800000, "extra": "kept", "feeRateBps": 3}, {"conditionId": "m", "asset": "x", "proxyWallet": "w", "outcome": "Up", "side": "SELL", "size": 50, "price": 0.55, "timestamp": 1727740801}]
    folder = str(tmp_path / "raw")
    for _ in range(2):
        path = raw.write_raw_page(folder, "w", 0, datetime(2026, 1, 1, tzinfo=UTC), json.dumps(page).encode(), 500)
    manifest = raw.load_manifest(spark, folder + "/manifest.jsonl")
    assert manifest.count() == 2 and raw.completed_offsets(manifest).first()["offsets"] == [0]
    assert raw.load_manifest(spark, folder + "/none.jsonl").count() == 0
    rows = raw.read_pages(spark, path)
    fields = [*normalize.REQUIRED, "id"]
    flat = rows.select("page_path", "record_index", "record", *[F.col("record")[f].alias(f) for f in fields])
    out = normalize.normalize_records(flat, ("page_path",), "record_index").orderBy("record_index").collect()
    assert [r["status"] for r in out] == ["accepted", "accepted"] and out[0]["price"] == Decimal("0.44") and len(out[1]["source_trade_id"]) == 64
    assert out[1]["timestamp"].timestamp() - out[0]["timestamp"].timestamp() == 1
    assert json.loads(rows.select(normalize.residual(F.col("record"), {"page": F.lit("p")})).first()[0]) == {"extra": "kept", "page": "p"}


def test_numeric_zero_price_counts_as_missing_only_on_request(spark):
    row = {f: "1" for f in normalize.REQUIRED} | {"side": "BUY", "price": "0", "timestamp": "1600000000"}
    df = spark.createDataFrame([row])
    assert normalize.normalize_records(df).first()["status"] == "accepted"
    assert normalize.normalize_records(df, numeric_zero_counts=("price",)).first()["reject_reason"] == "missing_fields:price"


def test_stored_fills_round_trip_and_upsert(spark, tmp_path):
    good = normalize.accepted(normalize.normalize_records(spark.createDataFrame([{f: "1" for f in normalize.REQUIRED} | {"side": "BUY", "price": "0.12345678", "timestamp": "1600000000", "id": i, "slug": ""} for i in ("a", "b")])))
    full = good.withColumn("raw_extra", F.lit("{}"))
    raw.write_fills(full, str(tmp_path / "f"))
    back = raw.load_fills(spark, str(tmp_path / "f"), "1")
    assert back.count() == 2 and back.first()["price"] == Decimal("0.12345678") and back.first()["slug"] is None
    raw.write_fills(full.where("false"), str(tmp_path / "e"))
    assert raw.load_fills(spark, str(tmp_path / "e")).count() == 0
    new = raw.upsert_fills(back.where("source_trade_id = 'a'"), back.unionByName(back))
    assert [r["source_trade_id"] for r in new.collect()] == ["b"]


def test_event_log(tmp_path, spark):
    path = str(tmp_path / "log.ndjson")
    log = eventlog.EventLog(path)
    for i in range(3):
        log.append({"sequence": i, "run_id": "r", "event_id": f"r:{i}", "event_type": "x"})
    with pytest.raises(ValueError):
        log.append({"sequence": 9})
    records, end = log.records_from(0)
    assert len(records) == 3 and log.records_from(end) == ([], end)
    with pytest.raises(ValueError):
        log.records_from(5)
    assert eventlog.EventLog(path).next_sequence == 3
    with open(path, "a") as file:
        file.write('{"sequence": 7}\n')
    with pytest.raises(ValueError):
        eventlog.EventLog(path)
    with pytest.raises(ValueError):
        log.append({"sequence": 3})
    assert raw.archive(str(tmp_path / "a"), b"x") == raw.archive(str(tmp_path / "a"), b"x")


FILLS = [("UP", "BUY", ".40", "5"), ("DOWN", "BUY", ".55", "3"), ("UP", "SELL", ".5", "2"), ("UP", "BUY", ".1", "1"), ("UP", "SELL", ".5", "3"), ("UP", "BUY", ".1", "1")]


def state_fills(n=None):
    return [("m", f"t{i}", o, s, Decimal(p), Decimal(q), 100 + i) for i, (o, s, p, q) in enumerate(FILLS[:n])]


def test_state_machine():
    now, out = state.advance(state.new_state(), state_fills())
    kinds = [r[2] for r in out]
    assert kinds == ["applied", "pair", "applied", "applied", "applied", "quarantined", "blocked_quarantined"]
    assert out[1][6:8] == (3.0, 0.95) and out[5][9] == "sell_would_unwind_paired_inventory"
    assert state.advance(state.new_state(), [("m", "z", "UP", "SELL", Decimal(1), Decimal(3), 1)])[1][0][9] == "sell_exceeds_observed_inventory"
    a, first = state.advance(state.new_state(), state_fills(3))
    b, rest = state.advance(a, state_fills()[3:])
    assert first + rest == out and b == now
    assert state.advance(a, state_fills(1))[1][0][2] == "duplicate"


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"event_type": "normalized_fill", "sequence": i, "payload": json.dumps(dict(zip(("market_id", "source_trade_id", "oside", "side", "price", "shares", "epoch"), (m, t, o, s, str(p), str(q), e))))}) for i, (m, t, o, s, p, q, e) in enumerate(state_fills())]
    for k, part in enumerate((lines[:3], lines[3:])):
        (tmp_path / "log" / f"{k}.ndjson").write_text("\n".join(part) + "\n")
        streams.run_state_query(spark, log, out, mark)
    streams.run_state_query(spark, log, out, mark)
    got = spark.read.parquet(out)
    batch = state.apply_batch(streams.fill_stream(eventlog.read_log(spark, log)))
    assert binding.same_rows(got, batch).first() == (0, 0) and got.count() == 7


def test_binding_is_strict(spark):
    pairs = spark.createDataFrame([("p", "M1", 100, 50)], "pair_id string, market_id string, formed_at_epoch bigint, sequence bigint")
    kind = "prediction_id string, market_id string, created_ms bigint, sequence bigint, candidate boolean, reconstructed boolean"
    rows = [("early", "m1", 90_000, 1, True, False), ("last", "m1", 99_999, 2, True, False), ("at", "m1", 100_000, 3, True, False), ("re", "m1", 99_999, 4, True, True)]
    assert binding.bind_strictly_prior(pairs, spark.createDataFrame(rows, kind)).first()["prediction_id"] == "last"
    late = [("early", "m1", 90_000, 1, True, False), ("later_appended", "m1", 99_999, 60, True, False)]
    assert binding.bind_strictly_prior(pairs, spark.createDataFrame(late, kind)).first()["prediction_id"] == "early"
    assert binding.bind_strictly_prior(pairs, spark.createDataFrame(rows[2:], kind)).first()["status"].startswith("unbound")


def test_windows(spark):
    got = [tuple(r) for r in windows.generate_windows(spark, 0, 25, 10).collect()]
    assert sorted(got) == [(0, 10), (10, 20), (20, 25)] and windows.generate_windows(spark, 5, 5, 10).count() == 0
    sizes = {(0, 8): 2000, (0, 4): 10, (4, 8): 3}
    fetch = lambda a, b, offset, limit: max(0, min(limit, sizes[a, b] * 10 - offset))
    plan = windows.collect_subdivided(fetch, 0, 8, 8, 1)
    assert [(r.window_start, r.window_end, r.ceiling_hit) for r in plan] == [(0, 8, True), (0, 4, False), (4, 8, False)]


def test_metadata(spark):
    rows = spark.createDataFrame([("m", "btc-updown-5m-300", '["Up","Down"]', '["a","b"]'), ("n", "x", "[]", "[]")], "market_id string, slug string, outcomes string, clobTokenIds string")
    got = {r["market_id"]: r for r in markets.classify_lookup(rows).collect()}
    assert got["m"]["token_sides"] == {"a": "UP", "b": "DOWN"} and got["n"]["reason_code"] == "slug_not_supported"


def test_held_out_rows_are_never_trained_on(spark):
    panel = spark.createDataFrame([("a", 1.0, 1.0, True), ("b", 3.0, 1.0, False), ("c", 5.0, 2.0, False)], "window_id string, pair_cost double, paired_shares double, favorable boolean")
    got = {r["window_id"]: r["predicted"] for r in evaluation.global_mean_predictions(panel).collect()}
    assert got == {"a": pytest.approx(13 / 3), "b": pytest.approx(11 / 3), "c": pytest.approx(2.0)}
    seen = evaluation.leave_one_window_out(panel, lambda train, held: held.select("window_id").crossJoin(train.select(F.col("window_id").alias("t"))))
    assert seen.where("window_id = t").count() == 0


def test_boosted_trees_have_all_rounds(spark, monkeypatch):
    asked = []

    def one_round(kind):
        return lambda **options: asked.append((options["maxIter"], options["stepSize"])) or kind(**{**options, "maxIter": 1})

    monkeypatch.setattr(models, "GBTRegressor", one_round(models.GBTRegressor))
    monkeypatch.setattr(models, "GBTClassifier", one_round(models.GBTClassifier))
    rows = spark.createDataFrame([(float(i), 1.0 + 0.001 * i, i < 200, 1.0) for i in range(400)], "a double, pair_cost double, favorable boolean, paired_shares double")
    models.train(rows, ("a",), "boosted")
    assert asked == [(100, 0.05)] * 2


def test_ridge_equals_its_closed_form_and_freezing_fails_closed(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(60, 2)), rng.uniform(1, 3, 60)
    y = 1 + x @ [0.3, -0.2] + rng.normal(size=60) * 0.1
    rows = spark.createDataFrame([(*map(float, a), float(b), bool(b < 1), float(c)) for a, b, c in zip(x, y, w)], "a double, b double, pair_cost double, favorable boolean, paired_shares double")
    model = models.train(rows, ("a", "b"))
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    beta = np.linalg.solve(zc.T @ (zc * w[:, None]) + np.eye(2), zc.T @ (w * yc))
    want = np.average(y, weights=w) + zc @ beta
    got = np.array([r["predicted"] for r in model.score(rows).collect()])
    assert np.abs(got - want).max() < 1e-6
    model.freeze(str(tmp_path))
    back = models.load_frozen(spark, str(tmp_path), ("a", "b"))
    assert [r["predicted"] for r in back.score(rows).collect()] == list(got)
    with pytest.raises(ValueError):
        models.load_frozen(spark, str(tmp_path), ("b", "a"))
    (tmp_path / "cost" / "more").write_text("x")
    with pytest.raises(ValueError):
        models.load_frozen(spark, str(tmp_path))
