"""Poll stages over page files, and stages that run together."""

import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotline.streaming import collect

META = "market_id string, sequence bigint, eligible boolean, reason_code string, token_sides map<string,string>"


def trade(i, market="m1", asset="up", outcome="Up", wallet="0xA", **more):
    return {"id": f"t{i}", "proxyWallet": wallet, "conditionId": market, "asset": asset, "side": "BUY", "outcome": outcome, "price": 0.25, "size": 3.5, "timestamp": 1_700_000_000 + i * 40_000} | more


def metadata(spark):
    return spark.createDataFrame([("M1", 1, False, "slug_not_supported", None), ("M1", 2, True, None, {"up": "UP", "down": "DOWN"}), ("m2", 1, False, "tokens_not_unique", None)], META)


POLLS = [
    ("p1", 200, json.dumps([trade(1), trade(2, asset="down", outcome="Down"), trade(1)])),
    ("p2", 200, json.dumps([trade(2, asset="down", outcome="Down"), trade(3, outcome="Down"), trade(4, market="m2"), trade(5, market="m9"), trade(6, asset="other"), trade(7, price=2)])),
    ("p3", None, None),
    ("p4", 503, "[]"),
    ("p5", 200, '{"error": 1}'),
    ("p6", 200, '[{"id": "x"'),
    ("p7", 200, "[1, 2]"),
    ("p8", 200, json.dumps([trade(8), trade(9, wallet="0xB")])),
    ("p9", 200, "[]"),
    ("p10", 204, None),
    ("p11", 200, json.dumps([trade(8), trade(4, market="m2"), trade(10, wallet="")])),
]


def poll(folder, number, polls):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{number:04d}.json"), "w", encoding="utf-8") as file:
        for i, (name, status, body) in enumerate(polls):
            file.write(json.dumps({"poll_id": name, "account": "0xa", "received_ms": 1000 * number + i, "http_status": status, "body": body}) + "\n")


def outcome(spark, out):
    settled = {r["source_trade_id"]: r for r in spark.read.parquet(f"{out}/settled").collect()}
    health = sorted((r["poll_id"], r["status"]) for r in spark.read.parquet(f"{out}/health").collect())
    return settled, health, spark.read.parquet(f"{out}/settled").count(), spark.read.parquet(f"{out}/raw").count()


def run(spark, tmp_path, **options):
    collect.collector(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "ck"), metadata, **options).awaitTermination()


def test_every_status_and_admission_is_met_and_a_restart_adds_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    for i in range(3):
        poll(str(tmp_path / "pages"), i, POLLS[i * 4 : i * 4 + 4])
        run(spark, tmp_path, max_files=1)
    settled, health, rows, raw = outcome(spark, out)
    assert dict(x for x in health if x[1] != "outcome_mapping_disagreement") == {"p1": "poll_ok", "p2": "poll_ok", "p3": "transport_failed", "p4": "request_failed", "p5": "parse_failed", "p6": "parse_failed", "p7": "parse_failed", "p8": "account_mismatch", "p9": "poll_ok", "p10": "parse_failed", "p11": "poll_ok"}
    assert [x for x in health if x[1] == "outcome_mapping_disagreement"] == [("p2", "outcome_mapping_disagreement")]
    assert {k: (r["admitted"], r["reason_code"], r["outcome_side"], r["poll_id"]) for k, r in settled.items()} == {
        "t1": (True, "eligible_market_asset_mapping", "UP", "p1"), "t2": (True, "eligible_market_asset_mapping", "DOWN", "p1"), "t3": (True, "eligible_market_asset_mapping", "UP", "p2"),
        "t4": (False, "market_tokens_not_unique", None, "p2"), "t5": (False, "market_unknown", None, "p2"), "t6": (False, "asset_not_in_durable_token_mapping", None, "p2"), "t8": (True, "eligible_market_asset_mapping", "UP", "p11"),
    } and rows == 7 and raw == 10
    fills = {r["source_trade_id"]: (r["shares"], r["record_index"]) for r in collect.fill_events(spark, out).collect()}
    assert fills == {"t1": (Decimal("3.5"), 0), "t2": (Decimal("3.5"), 1), "t3": (Decimal("3.5"), 1), "t8": (Decimal("3.5"), 0)}
    run(spark, tmp_path)
    assert outcome(spark, out)[1:] == (health, rows, raw)
    pages = spark.read.schema(collect.PAGE).json(str(tmp_path / "pages" / "0001.json"))
    collect.collect_batch(pages, 1, metadata(spark), out)  # a batch that is run again, as after a crash before its commit
    assert outcome(spark, out)[1:] == (health, rows, raw)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], collect.PAGE)
    collect.collect_batch(pages, 0, metadata(spark), str(tmp_path / "out"))
    assert collect.fill_events(spark, str(tmp_path / "out")).count() == 0 and collect.fill_events(spark, str(tmp_path / "none")).count() == 0


def copying(spark, tmp_path, name, fail=None):
    """A stage that copies numbers into its own folder, and fails at one."""

    def write(batch, number):
        if fail and batch.where(F.col("x") == fail[0]).count():
            raise ValueError("planted")
        batch.write.mode("overwrite").parquet(str(tmp_path / name / f"batch={number}"))

    stream = spark.readStream.schema("x bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    return lambda: stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(processingTime="0 seconds").start()


def test_a_stage_that_fails_stops_all_and_a_restart_goes_on(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for i in range(4):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"x": i}))
    fail = [2]
    stages = {"a": copying(spark, tmp_path, "a"), "b": copying(spark, tmp_path, "b", fail), "c": copying(spark, tmp_path, "c")}
    with pytest.raises(collect.StageFailed, match="b: "):
        collect.run_together(stages)
    assert not [q for q in spark.streams.active]
    fail[0] = None

    def numbers(name):
        return sorted(r["x"] for r in spark.read.parquet(str(tmp_path / name)).collect()) if (tmp_path / name).exists() and list((tmp_path / name).glob("*/*.parquet")) else []

    collect.run_together(stages, until=lambda: all(len(numbers(n)) == 4 for n in stages))
    assert [numbers(n) for n in stages] == [[0, 1, 2, 3]] * 3 and not [q for q in spark.streams.active]


def test_a_tick_sees_the_log_as_it_was_before(spark, tmp_path):
    log, seen = [7], []

    def tick(second, cutoff):
        seen.append((second, cutoff))
        log.append(log[-1] + 1)  # something is appended while the tick runs

    collect.run_together({"cadence": lambda: collect.cadence(spark, tick, lambda: log[-1], str(tmp_path / "ck"))}, until=lambda: len(seen) >= 3)
    assert seen[0][1] == 7 and [s for s, _ in seen] == sorted({s for s, _ in seen})
