"""Typed streaming state that ends, against the batch forms."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotline.operators import binding
from lotline.streaming import state as states
from lotline.streaming import typed


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    typed.typed_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, frames, apply, tmp_path):
    """What comes out when each frame is a batch of its own, with a restart after the first half; and the state's rows after each batch."""
    folder, out, ck, sizes = (str(tmp_path / x) for x in ("in", "out", "ck")), None, None, []
    folder, out, ck = folder
    for part in (frames[: len(frames) // 2], frames[len(frames) // 2 :]):
        for frame in part:
            frame.coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(frames[0].schema).parquet(folder)
            q = apply(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            sizes.append(sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]))
    return spark.read.parquet(out), sizes


def test_binding_equals_the_batch_and_its_state_stays_small(rocks, tmp_path):
    rng, rows, sequence = random.Random(1), [], 0
    for m in range(400):  # a market every ten seconds, each with some predictions and pairs
        for i in range(8):
            sequence += 1
            ms = 10**9 + m * 10_000 + i * 1000 + rng.randrange(900)
            rows.append((f"M{m}" if i % 2 else f"m{m}", "prediction", f"p{m}:{i}", ms, sequence, None) if i % 3 else (f"m{m}", "pair", f"a{m}:{i}", ms // 1000 * 1000 + rng.choice([0, 0, -2000]), sequence, rng.choice([0.9, 1.0, 1.1])))
    rows += [(r[0], r[1], r[2], r[3], sequence + j, r[5]) for j, r in enumerate(rows[-8:], 1) if r[1] == "pair"]  # pairs that come again
    schema = "market_id string, kind string, id string, ms bigint, sequence bigint, cost double"
    size = len(rows) // 8 + 1
    frames = [rocks.createDataFrame(rows[i : i + size], schema) for i in range(0, len(rows), size)]
    got, sizes = streamed(rocks, frames, lambda s: typed.bind_stream(s, "30 seconds", 60_000), tmp_path)
    every = rocks.createDataFrame(list({(r[1], r[2]): r for r in reversed(rows)}.values()), schema)
    pairs = every.where("kind = 'pair'").select(F.col("id").alias("pair_id"), "market_id", F.floor(F.col("ms") / 1000).cast("bigint").alias("formed_at_epoch"), "sequence")
    made = every.where("kind = 'prediction'").select(F.col("id").alias("prediction_id"), "market_id", F.col("ms").alias("created_ms"), "sequence", F.lit(True).alias("candidate"), F.lit(False).alias("reconstructed"))
    want = {r["pair_id"]: (r["prediction_id"], r["status"]) for r in binding.bind_strictly_prior(pairs, made).collect()}
    found = got.collect()
    assert set(want) - {r["pair_id"] for r in found} == set()
    assert len(found) == len(want) and {r["pair_id"]: (r["prediction_id"], r["status"]) for r in found} == want
    assert max(sizes[2:]) < 2 * min(sizes[2:]) and sizes[-1] < 0.3 * len(rows)


def test_market_state_equals_the_batch_and_ends(rocks, tmp_path):
    rng, rows = random.Random(2), []
    for m in range(160):
        for i in range(12):
            rows.append((f"m{m}", f"t{m}:{rng.randrange(11)}", rng.choice(["UP", "DOWN"]), "SELL" if rng.random() < 0.06 else "BUY", f"0.{rng.randrange(10, 99)}", str(rng.randrange(1, 9)), 10**6 + m * 20 + i, len(rows)))
    schema = "market_id string, source_trade_id string, oside string, side string, price string, shares string, epoch bigint, arrival bigint"
    size = len(rows) // 6 + 1
    frames = [rocks.createDataFrame(rows[i : i + size], schema) for i in range(0, len(rows), size)]
    got, sizes = streamed(rocks, frames, lambda s: typed.apply_stream(s, "30 seconds", 60_000), tmp_path)
    want = states.apply_batch(rocks.createDataFrame(rows, schema))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert {r["kind"] for r in want.select("kind").distinct().collect()} >= {"applied", "pair", "duplicate", "quarantined"}
    assert max(sizes[2:]) < 2 * min(sizes[2:]) and sizes[-1] < 0.6 * len(rows)


def test_only_predictions_that_can_bind_are_kept():
    held = [(10, 1, "a"), (20, 5, "b"), (20, 3, "c"), (5, 9, "d"), (100, 7, "e")]
    for watermark in (0, 15, 50, 200):
        kept = typed.Binding.useful(held, watermark)
        for ms in (max(watermark, 1), watermark + 60, watermark + 200):
            for sequence in range(12):
                best = lambda some: max((p for p in some if p[0] < ms and p[1] < sequence), default=None)  # noqa: E731, B023
                assert best(kept) == best(held)
    assert len(typed.Binding.useful(held, 200)) == 4


def test_a_large_market_streams_through_the_batch_form(spark):
    """Duplicates before and after a quarantine as `advance` has them; output comes before the whole market is read."""
    rng = random.Random(7)
    rows = [("m", f"t{rng.randrange(900)}", rng.choice(["UP", "DOWN"]), "SELL" if i > 700 and rng.random() < 0.02 else "BUY", f"0.{rng.randrange(10, 99)}", str(rng.randrange(1, 9)), i, i) for i in range(1200)]
    schema = "market_id string, source_trade_id string, oside string, side string, price string, shares string, epoch bigint, arrival bigint"
    key = lambda r: tuple(map(str, r))
    want = states.advance(states.new_state(), [r[:-1] for r in rows])[1]
    assert {r[2] for r in want} == {"applied", "pair", "duplicate", "quarantined", "blocked_quarantined"}
    assert sorted(map(key, states.apply_batch(spark.createDataFrame(rows, schema)).collect())) == sorted(map(key, want))
    read = []

    def batches():
        for i in range(0, 1200, 100):
            read.append(i)
            yield pa.RecordBatch.from_pylist([dict(zip((*states.INPUT, "first", "again"), (*r, r[-1], False), strict=True)) for r in rows[i : i + 100]])

    next(states.folded(batches()))
    assert read == [0]
