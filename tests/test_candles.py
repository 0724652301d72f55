"""Checks, provenance and retries of candle pages."""

import hashlib
import json
from decimal import Decimal

import pytest

from lotline.sources import raw


def pages_of(spark, pages):
    return spark.createDataFrame([(i, v) for i, v in enumerate(pages)], "page_no bigint, value string")


def test_bad_rows_are_set_aside_with_a_reason(spark):
    good = [60, 1, 4, 2, 3, 9.5]
    rows = [good, [61, 1, 4, 2, 3, 9], [120, -1, 4, 2, 3, 9], [120, 4, 1, 2, 3, 9], [120, 1, 4, 2, 3], [120, 1, "x", 2, 3, 9], [None, 1, 4, 2, 3, 9], "word", 7, {"a": 1}, [180, 1, 4, 2, 3, 1e15, "more"], [240, 0, 0, 0, 0, 0]]
    pages = pages_of(spark, [json.dumps(rows), json.dumps([[60, 1, 5, 2, 4, 9]]), "no json", "[]", None])
    got = raw.check_candle_rows(pages).collect()
    first = [r["reason"] for r in sorted((r for r in got if r["page_no"] == 0), key=lambda r: r["row_no"])]
    assert first == [None, "not_aligned", "negative_value", "high_below_low", "short_row", "not_a_number", "not_a_number", "short_row", "short_row", "short_row", None, None]
    assert [r["reason"] for r in got if r["page_no"] > 1] == ["short_row"] * 3
    kept = {r["open_epoch"]: r for r in raw.accepted_candles(raw.check_candle_rows(pages)).collect()}
    assert set(kept) == {60, 180, 240} and kept[60]["close"] == Decimal(4) and kept[60]["high"] == Decimal(5)


def test_provenance_says_what_was_asked_and_what_came(spark):
    texts = [json.dumps([[60, 1, 4, 2, 3, 9], [61, 1, 4, 2, 3, 9]]), json.dumps([[180, 1, 4, 2, 3, 9]])]
    row = raw.candle_provenance(pages_of(spark, texts), 0, 240).first()
    whole = hashlib.sha256("".join(hashlib.sha256(t.encode()).hexdigest() for t in texts).encode()).hexdigest()
    assert row.asDict() == {"start": 0, "end": 240, "pages": 2, "pages_sha256": whole, "first_epoch": 60, "last_epoch": 180, "candles": 2}
    none = raw.candle_provenance(pages_of(spark, texts).limit(0), 0, 60).first()
    assert (none["pages"], none["candles"], none["first_epoch"]) == (0, 0, None)


def test_a_busy_source_is_asked_again(spark, tmp_path):
    answers, waits = [(429, ""), (429, ""), (200, "[[60,1,4,2,3,9]]"), (200, "[]")], []
    pages = raw.collect_candles(spark, lambda p: answers.pop(0), 20_000, 25_000 + 60 * 240, str(tmp_path / "pages"), sleep=waits.append)
    assert waits == [1.0, 2.0] and sorted(r["value"] for r in pages.collect()) == ["[[60,1,4,2,3,9]]", "[]"] and not answers
    for status in (429, 500):
        with pytest.raises(OSError):
            raw.retried(lambda p, s=status: (s, ""), sleep=waits.append)({})
    assert waits == [1.0, 2.0, 1.0, 2.0, 4.0, 8.0]
