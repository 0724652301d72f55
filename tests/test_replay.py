"""Replay audit against a plain simulation that reads the log record by record."""

import json
import random
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotline.operators import replay
from lotline.schemas import EVENT

BASE = 20_000 * 86_400 + 12 * 3600  # noon


def iso(ms):
    return datetime.fromtimestamp(ms / 1000, UTC).isoformat()


def plain_tick(records, market, tick):
    """Reason, features and provenance of a tick that may see these records."""
    meta, fills, buys, polled, stopped, candles = None, {}, [], None, False, {}
    for r in records:
        p, kind = r["payload"], r["event_type"]
        mine = str(p.get("market_id") or "").lower() == market.lower()
        if kind == "market_metadata" and mine:
            meta = p if p["eligible"] else None
        elif kind == "normalized_fill":
            fills[r["event_id"]] = p
        elif kind == "state_application" and mine:
            stopped |= bool(p.get("quarantined"))
            if p["status"] == "applied" and p["fill_event_id"] in fills and fills[p["fill_event_id"]]["side"] == "BUY":
                buys.append(fills[p["fill_event_id"]])
        elif kind == "state_quarantine" and mine:
            stopped = True
        elif kind == "source_health" and p["source"] == "target" and p["status"] == "poll_ok":
            polled = r["ms"] // 1000
        elif kind == "btc_candle":
            candles[p["open_epoch"] + 60] = {k: Decimal(p[k]) for k in ("high", "low", "close")}
    if meta is None:
        return "market_metadata_unknown_or_ineligible", None, None
    start = meta["market_start"]
    last = lambda upto: max((c for c in candles if c <= upto), default=None)
    now = last(tick)
    for bad, reason in (
        (not 0 <= tick - start < 300, "outside_market_window"), (not 12 <= tick % 86400 // 3600 < 18, "outside_evaluation_window"), (meta["active"] is False or meta["closed"] is True, "market_inactive_or_closed"), (stopped, "market_state_quarantined"),
        (polled is None, "target_source_never_healthy"), (polled is not None and tick - polled > 5, "target_source_stale"), (now is None, "btc_no_causal_candle"), (now is not None and tick - now > 120, "btc_reference_stale"),
    ):
        if bad:
            return reason, None, None
    held = {s: sum((Decimal(b["shares"]) for b in buys if b["oside"] == s), Decimal(0)) for s in ("UP", "DOWN")}
    up, down = held["UP"], held["DOWN"]
    since = lambda s: max(0, tick - max(x)) if (x := [b["epoch"] for b in buys if b["oside"] == s]) else None
    trail = {s: [b for b in buys if tick - s <= b["epoch"] <= tick] for s in (0, 15, 30, 60)}
    key = lambda b: (b["epoch"], b["source_trade_id"], b["ingest_id"])
    sides = [b["oside"] for b in sorted(trail[60], key=key)]
    f = {"elapsed_seconds": tick - start, "seconds_remaining": 300 - tick + start, "up_inventory": up, "down_inventory": down, "paired_inventory": min(up, down), "residual_inventory": abs(up - down), "inventory_imbalance": (up - down) / (up + down) if up + down else None, "seconds_since_last_up_fill": since("UP"), "seconds_since_last_down_fill": since("DOWN")}
    f |= {f"fill_count_{s}s": len(trail[s]) for s in (15, 30, 60)} | {f"fill_qty_{s}s": sum((Decimal(b["shares"]) for b in trail[s]), Decimal(0)) for s in (15, 30, 60)}
    f |= {"side_switches_60s": sum(a != b for a, b in zip(sides, sides[1:], strict=False)), "cumulative_paired_quantity": min(up, down), "same_second_fill_count": len(trail[0])}
    close = lambda upto: candles[c]["close"] if (c := last(upto)) is not None else None
    change = lambda then: float(close(tick)) / float(then) - 1 if then else None
    span = [candles[c] for c in candles if start <= c <= tick]
    r60 = change(close(tick - 60))
    f |= {"btc_return_60s": r60, "btc_return_120s": change(close(tick - 120)), "btc_absolute_return_60s": None if r60 is None else abs(r60), "btc_return_since_market_start": change(close(start)), "btc_range_since_market_start": float(max(x["high"] for x in span) - min(x["low"] for x in span)) / float(close(start)) if span and close(start) else None}
    top = max(map(key, buys), default=None)
    proof = {"btc_reference_epoch": now, "btc_reference_price": float(close(tick)), "max_source_epoch": max((b["epoch"] for b in buys), default=None), "max_receive_epoch": max((b["receive_epoch"] for b in buys), default=None), "max_fill_key": top and "|".join(map(str, top)), "applied_buy_fill_count": len(buys)}
    return None, {k: None if v is None else float(v) for k, v in f.items()}, proof


def outputs(f):
    value = lambda c: 0.0 if f[c] is None else f[c]
    return {"first": {"predicted": 1 + value("btc_return_60s") / 7, "probability": 1 / (2 + value("fill_count_60s"))}, "second": {"predicted": value("up_inventory") / 3, "probability": 0.25}}


def models():
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return {"first": lambda r: r.withColumn("predicted", 1 + zero("btc_return_60s") / 7).withColumn("probability", 1 / (2 + zero("fill_count_60s"))), "second": lambda r: r.withColumn("predicted", zero("up_inventory") / 3).withColumn("probability", F.lit(0.25))}


def simulated(seed, steps=420):
    """A log of four markets with late fills, revised candles, stale polls, quarantines and changes of metadata."""
    rng, out = random.Random(seed), []

    def put(kind, ms, **payload):
        out.append({"event_type": kind, "event_id": f"r:{len(out)}", "run_id": "r", "sequence": len(out), "ms": ms, "payload": payload})
        return out[-1]

    pending, pairs, predictions, n = [], [], [], 0
    starts = {"mA": BASE, "mB": BASE + 60, "mC": BASE - 200, "mD": BASE + 300}
    put("btc_candle", 0, open_epoch=BASE - 40_000 * 60, open="1", high="2", low="1", close="1.5")  # long before all others
    for step in range(steps):
        t = BASE - 20 + step
        ms = t * 1000 + rng.randrange(1000)
        if step % 50 == 3:
            for m, s in starts.items():
                put("market_metadata", ms, market_id=m.upper(), eligible=not (m == "mC" and 100 < step < 200), market_start=s, active=None if step < 250 else m != "mB", closed=False)
        if step % 60 == 20 or rng.random() < 0.02:
            close = Decimal(rng.randrange(100, 140))
            minute = t // 60 * 60 - 60 * rng.choice([1, 1, 1, 2, 3, -1])  # sometimes an older one is revised, or one comes before it has closed
            if not 150 < step < 330:
                put("btc_candle", ms, open_epoch=minute, open=str(close), high=str(close + 3), low=str(close - 2), close=str(close))
        if rng.random() < 0.5 or step % 97 < 5:
            put("source_health", ms, source=rng.choice(["target", "target", "other"]), status=rng.choice(["poll_ok", "poll_ok", "poll_ok", "failed"]))
        for _ in range(rng.randrange(3)):
            n += 1
            fill = put("normalized_fill", ms, market_id=rng.choice(["mA", "MA", "mB", "mC"]), source_trade_id=f"t{rng.randrange(10**6)}", ingest_id=f"i{n}", oside=rng.choice(["UP", "DOWN"]), side=rng.choice(["BUY", "BUY", "BUY", "SELL"]), price="0.5", shares=str(Decimal(rng.randrange(1, 10**9)) / 10**8), epoch=t - rng.choice([0, 0, 1, 5, 40, 90, -2]), receive_epoch=t)
            pending.append(fill)
        rng.shuffle(pending)
        while pending and rng.random() < 0.7:
            fill = pending.pop()
            put("state_application", ms, market_id=fill["payload"]["market_id"], fill_event_id=fill["event_id"], status=rng.choice(["applied", "applied", "applied", "duplicate"]), quarantined=False)
        if step == 380:
            put("state_quarantine", ms, market_id="ma")
        if step == 390:
            put("state_application", ms, market_id="mC", fill_event_id="none", status="blocked", quarantined=True)
        if rng.random() < 0.6:
            as_of = len(out) - 1 - (rng.randrange(3) if len(out) > 3 else 0)
            for m in rng.sample(["mA", "mB", "mC", "mD", "none"], 3):
                reason, f, proof = plain_tick(out[: as_of + 1], m, t)
                if reason:
                    put("unscorable_tick", ms, market_id=m, tick=t, as_of_sequence=as_of, reason=reason)
                    continue
                shot = put("feature_snapshot", ms, market_id=m, tick=t, as_of_sequence=as_of, feature_order=list(replay.FEATURES), features=f, **proof)
                predictions.append(put("prediction", ms, market_id=m, snapshot_event_id=shot["event_id"], outputs=outputs(f), candidate=rng.random() < 0.9, reconstructed=rng.random() < 0.1))
        if rng.random() < 0.3:
            m, cost, formed = rng.choice(["MA", "mB", "mC", "mD"]), rng.choice([0.9, 1.0, 1.1]), t - rng.choice([0, 0, 3, 30, -1])
            pair = put("pair_formation", ms, market_id=m, pair_cost=cost, paired_shares=1.0, formed_at_epoch=formed)
            fits = [p for p in predictions if p["payload"]["market_id"].lower() == m.lower() and p["payload"]["candidate"] and not p["payload"]["reconstructed"] and p["ms"] < formed * 1000]
            bound = max(fits, key=lambda p: (p["ms"], p["sequence"]))["event_id"] if fits else None
            put("outcome_label", ms, pair_event_id=pair["event_id"], pair_cost=cost, favorable=cost < 1)
            put("score_binding", ms, pair_event_id=pair["event_id"], prediction_event_id=bound, status="bound_strictly_prior_score" if bound else "unbound_no_strictly_prior_score")
            pairs.append(pair)
    return out


def frame(spark, records):
    rows = [("v1", r["event_type"], r["event_id"], r["run_id"], r["sequence"], iso(r["ms"]), json.dumps(r["payload"]), None) for r in records]
    return spark.createDataFrame(rows, EVENT).withColumns({"tick": F.lit("x"), "market_id": F.lit(1)}).repartition(5)


def faults(spark, records, **options):
    found = replay.replay(frame(spark, records), models(), 1e-9, **options)
    rows = found.collect()
    return {(r["event_id"], r["problem"]) for r in rows if r["problem"]}, rows


@pytest.mark.parametrize("seed,search,block", [(0, 16, 1 << 16), (1, 2, 64)])
def test_a_true_log_replays_and_planted_faults_are_found(spark, monkeypatch, seed, search, block):
    monkeypatch.setattr(replay, "SEARCH", search)
    monkeypatch.setattr(replay, "BLOCK", block)
    records = simulated(seed)
    of = lambda kind: [r for r in records if r["event_type"] == kind]
    assert len(of("feature_snapshot")) > 40 and len({r["payload"]["reason"] for r in of("unscorable_tick")}) >= 6
    found, rows = faults(spark, records)
    assert found == set()
    assert len(rows) == sum(len(of(k)) for k in ("feature_snapshot", "unscorable_tick", "prediction", "pair_formation")) + sum(r["payload"]["status"] == "applied" for r in of("state_application"))

    rng = random.Random(seed)
    shots, made, ticks, pairs = (rng.sample(of(k), 6) for k in ("feature_snapshot", "prediction", "unscorable_tick", "pair_formation"))
    named = {r["payload"]["snapshot_event_id"]: r for r in of("prediction")}
    expected, spoiled = set(), {named[s["event_id"]]["event_id"] for s in shots}
    for i, s in enumerate(shots):
        p = s["payload"]
        if i == 0:
            p["features"]["fill_count_30s"] += 1
            expected.add((s["event_id"], "feature:fill_count_30s"))
        elif i == 1:
            p["features"]["btc_return_120s"] = None if p["features"]["btc_return_120s"] is not None else 0.5
            expected.add((s["event_id"], "feature:btc_return_120s"))
        elif i == 2:
            p["feature_order"] = p["feature_order"][::-1]
            expected.add((s["event_id"], "feature_order"))
        elif i == 3:
            p["max_fill_key"] = "other"
            expected.add((s["event_id"], "provenance:max_fill_key"))
        elif i == 4:
            p["as_of_sequence"] = s["sequence"]
            expected.add((s["event_id"], "as_of_not_before_event"))
        else:
            del p["features"]["side_switches_60s"]
            expected.add((s["event_id"], "feature:side_switches_60s"))
    for i, r in enumerate(x for x in made if x["event_id"] not in spoiled):
        p = r["payload"]
        if i == 0:
            p["outputs"]["second"]["predicted"] += 1e-6
            expected.add((r["event_id"], "cost:second"))
        elif i == 1:
            p["snapshot_event_id"] = "r:none"
            expected.add((r["event_id"], "snapshot_missing"))
        elif i == 2:
            del p["outputs"]["first"]
            expected.add((r["event_id"], "output_missing:first"))
    ticks[0]["payload"]["reason"] = "market_state_quarantined" if ticks[0]["payload"]["reason"] != "market_state_quarantined" else "target_source_stale"
    expected.add((ticks[0]["event_id"], "reason"))
    said = {(r["event_type"], r["payload"].get("pair_event_id")): r for r in records}
    for i, r in enumerate(pairs):
        label, binding = said["outcome_label", r["event_id"]]["payload"], said["score_binding", r["event_id"]]["payload"]
        if i == 0:
            label["favorable"] = not label["favorable"]
            expected.add((r["event_id"], "label_favorable"))
        elif i == 1:
            binding["prediction_event_id"] = "r:x"
            expected.add((r["event_id"], "binding_prediction"))
        elif i == 2:
            binding["status"] = "?"
            expected.add((r["event_id"], "binding_status"))
        elif i == 3:
            binding["pair_event_id"] = "r:nobody"
            expected |= {(r["event_id"], "binding_missing"), ("r:nobody", "pair_missing")}
    gone = next(r for r in of("state_application") if r["payload"]["status"] == "applied" and r["payload"]["market_id"] == "mC" and r["sequence"] > of("state_quarantine")[0]["sequence"])
    gone["payload"]["fill_event_id"] = "r:lost"
    expected.add((gone["event_id"], "fill_missing"))
    found, _ = faults(spark, records)
    later = {r["event_id"] for r in of("feature_snapshot") if r["payload"]["market_id"] == "mC" and r["payload"]["as_of_sequence"] >= gone["sequence"]}
    assert {x for x in found if x[0] not in later} == {x for x in expected if x[0] not in later}


def test_an_empty_log(spark):
    found, rows = faults(spark, [])
    assert found == set() and rows == []
    with pytest.raises(ValueError):
        replay.replay(frame(spark, []), {}, -1.0)


def test_trailing_lists_the_seconds_of_ticks_not_of_fills(spark):
    """Fills are many and ticks few, so what is multiplied by the length of the window must be the ticks."""
    fills = spark.createDataFrame([("m", i, "UP" if i % 3 else "DOWN", i / 2, i, f"t{i}", f"t{i}", True, "BUY") for i in range(200)], "market_id string, sequence bigint, oside string, shares double, epoch bigint, source_trade_id string, ingest_id string, found boolean, side string")
    ticks = spark.createDataFrame([("a", "m", 100, 100), ("b", "m", 150, 130)], "event_id string, market_id string, tick bigint, as_of_sequence bigint")
    out = replay.trailing(fills, ticks)
    rows = {r["event_id"]: r for r in out.collect()}
    assert rows["a"]["fill_count_15s"] == 16 and rows["a"]["fill_count_60s"] == 61 and rows["a"]["same_second_fill_count"] == 1
    assert rows["b"]["fill_count_60s"] == 41 and rows["b"]["same_second_fill_count"] == 0
    generate = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert len(generate) == 1 and "sequence(epoch" not in generate[0]
