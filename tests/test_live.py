"""The live engine's queries against SQL, streams against their batch forms, sinks, gates."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lotline.operators import binding, live, markets, metrics
from lotline.plans import live as plans
from lotline.plans.oracle import ORACLES as CORE
from lotline.plans.queries import REGISTRY
from lotline.sources import eventlog, sinks
from lotline.streaming import queries as streams
from tests.test_engine import SF, TABLES, plain

QUERIES = REGISTRY | plans.REGISTRY
ORACLES = CORE | plans.ORACLES


@pytest.mark.parametrize("name", ["active_markets", "admitted_fills", "applied_fills", "btc_volatility", "candle_pages", "claims_table", "feature_tick_results", "fold_pairs", "gap_latency", "manifest_window_offsets", "market_status_as_of", "online_applications", "operational_monitor", "pair_accounting", "payload_coercion", "permuted_features", "prediction_snapshots", "primary_buckets", "replay_audit", "run_start_check", "sell_aware_avg_cost", "upsert_counts"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, found = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want and want


def test_every_reason_and_the_features_are_met(spark):
    rows = QUERIES["feature_tick_results"](spark, "/root/testdata/sf0.01").collect()
    met = {r["reason"] for r in rows}
    assert None in met and {"market_metadata_unknown_or_ineligible", "outside_market_window", "market_state_quarantined"} <= met
    assert all((r["up_inventory"] is not None) == r["scorable"] for r in rows)


def test_the_first_reason_wins(spark):
    rows = spark.createDataFrame([(i, *[j >= i for j in range(9)]) for i in range(10)], "i int, " + ", ".join(f"c{j} boolean" for j in range(9)))
    got = {r["i"]: r["r"] for r in rows.select("i", live.tick_reason([F.col(f"c{j}") for j in range(9)]).alias("r")).collect()}
    assert [got[i] for i in range(10)] == [*live.TICK_REASONS, None]


def events_of(spark):
    rows = [("M1", "prediction", "p1", 1000, 1, None), ("m1", "pair", "a", 2000, 2, 0.9), ("m1", "prediction", "p2", 1500, 3, None), ("m1", "pair", "b", 2000, 4, 1.1), ("m1", "pair", "c", 1500, 5, 1.0), ("m2", "pair", "d", 9000, 6, 0.5), ("m2", "prediction", "p3", 100, 7, None), ("m1", "pair", "a", 2000, 8, 0.9)]
    return spark.createDataFrame(rows, "market_id string, kind string, id string, ms bigint, sequence bigint, cost double")


def streamed(spark, frames, apply, tmp_path, name):
    """What `apply` appends when each frame comes in a batch of its own, with a restart in between."""
    folder, schema = str(tmp_path / "in"), frames[0].schema
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        q = apply(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_binding_is_exactly_once_and_equals_the_batch(spark, tmp_path):
    e = events_of(spark)
    got = {r["pair_id"]: (r["prediction_id"], r["favorable"]) for r in streamed(spark, [e.where("sequence <= 3"), e.where("sequence BETWEEN 4 AND 6"), e.where("sequence > 6")], streams.bind_stream, tmp_path, "bind").collect()}
    assert got == {"a": ("p1", True), "b": ("p2", False), "c": ("p1", False), "d": (None, True)}
    pairs = e.where("kind = 'pair' AND sequence < 8").select(F.col("id").alias("pair_id"), "market_id", F.floor(F.col("ms") / 1000).cast("bigint").alias("formed_at_epoch"), "sequence")
    made = e.where("kind = 'prediction'").select(F.col("id").alias("prediction_id"), "market_id", F.col("ms").alias("created_ms"), "sequence", F.lit(True).alias("candidate"), F.lit(False).alias("reconstructed"))
    batch = {r["pair_id"]: r["prediction_id"] for r in binding.bind_strictly_prior(pairs, made).collect()}
    assert {k: v for k, v in batch.items() if k != "c"} == {k: v[0] for k, v in got.items() if k != "c"}


def test_streamed_revisions_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "x"), (0, 2, "x"), (60, 3, "y"), (0, 4, "z"), (0, 5, "z"), (60, 6, "q"), (120, 7, "open")], "open_epoch bigint, sequence bigint, fingerprint string")
    apply = lambda s: streams.candle_revision_stream(s, F.lit(150))
    got = streamed(spark, [rows.where("sequence <= 3"), rows.where("sequence > 3")], apply, tmp_path, "rev")
    want = eventlog.candle_revisions(rows.where("open_epoch < 100"))
    assert sorted(map(tuple, got.select("open_epoch", "sequence", "fingerprint", "supersedes_sequence").collect()), key=str) == sorted(map(tuple, want.select("open_epoch", "sequence", "fingerprint", "supersedes_sequence").collect()), key=str)


class Flat:
    def score(self, rows):
        return rows.withColumn("predicted", F.lit(1.0)).withColumn("probability", F.lit(0.5))


def test_scoring_writes_the_attempt_and_every_model(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    spark.range(5).write.parquet(folder)
    stream = spark.readStream.schema("id bigint").parquet(folder)
    for _ in range(2):
        streams.run_scoring_query(stream, {"a": Flat(), "b": Flat()}, str(tmp_path / "out"), str(tmp_path / "ck"))
    scored = spark.read.parquet(str(tmp_path / "out" / "predictions"))
    assert scored.count() == spark.read.parquet(str(tmp_path / "out" / "attempts")).count() == 5
    assert {"predicted_a", "probability_a", "predicted_b", "probability_b"} <= set(scored.columns)
    assert list(streams.run_stages({"one": lambda: 1, "two": lambda: 2}).values()) == [1, 2]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i % 3}", None if i == 4 else i / 2) for i in range(20)], "n int, window_id string, x double").withColumn("cost", F.col("n").cast("decimal(10,4)"))
    sinks.write_panel(rows, str(tmp_path / "panel"), "window_id")
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 20
    sinks.write_sample_csv(rows, str(tmp_path / "csv"), ["n"], 7)
    assert [r["n"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [str(i) for i in range(7)]
    path = sinks.write_report_json(str(tmp_path / "r" / "report.json"), b=rows.limit(2).orderBy("n"), a=rows.where("n = 4"))
    text = open(path).read()
    assert json.loads(text)["a"] == [{"n": 4, "window_id": "w1", "x": None, "cost": "4.0000"}] and text.index('"a"') < text.index('"b"')
    table = open(sinks.write_report_markdown(str(tmp_path / "r.md"), "Report", some_rows=rows.where("n = 4"))).read()
    assert "## some rows" in table and "| 4 | w1 |  | 4.0000 |" in table
    sinks.write_coverage_json(str(tmp_path / "c.json"), rows.groupBy("window_id").count())
    with pytest.raises(ValueError):
        sinks.report_rows(rows, 10)


def test_folds_must_agree_and_other_accounts_are_refused(spark):
    a = spark.createDataFrame([("w1", 0.1), ("w2", 0.2)], "window_id string, m double")
    assert live.zip_folds(a, a).count() == 2
    for b in (a.where("window_id = 'w1'"), a.unionByName(a)):
        with pytest.raises(Exception, match="folds differ"):
            live.zip_folds(a, b).collect()
    meta = markets.classify_lookup(spark.createDataFrame([("m", "btc-updown-5m-0", '["Up","Down"]', '["u","d"]', 1)], "market_id string, slug string, outcomes string, clobTokenIds string, sequence bigint"))
    fills = spark.createDataFrame([("1", "m", "u", "DOWN", "me"), ("1", "m", "u", "DOWN", "me"), ("2", "x", "u", "UP", "me")], "source_trade_id string, market_id string, asset_id string, oside string, account string")
    got = {r["source_trade_id"]: (r["admitted"], r["oside"], r["side_disagrees"]) for r in markets.admit(fills, meta, "me").collect()}
    assert got["1"] == (True, "UP", True) and got["2"][0] is False
    with pytest.raises(Exception, match="another account"):
        markets.admit(fills, meta, "you").collect()


def test_ranks_of_counted_values(spark):
    rows = spark.createDataFrame([(k, v) for k, n in (("a", 1), ("b", 4), ("c", 41)) for v in range(n)], "k string, v int")
    got = {r["k"]: (r["n"], r["median"], r["p95"]) for r in metrics.latency_summary(rows, "v", ["k"]).collect()}
    assert got == {"a": (1, 0.0, 0), "b": (4, 1.5, 3), "c": (41, 20.0, 38)}


@pytest.mark.parametrize("name", ["permutation_deltas", "ridge_lowo", "external_validation_gate"])
def test_evaluations_read_written_pairs_and_equal_sql(spark, name):
    """The pairs are computed once, not in each branch of the plan: nothing but written files is scanned."""
    test_query_equals_sql(spark, name)
    assert all("/lotline/" in f for f in QUERIES[name](spark, SF).inputFiles())
