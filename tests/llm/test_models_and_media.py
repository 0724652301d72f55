"""Classifiers by held-out accuracy, audio by round trips, sharding by its rules, the pipeline end to end."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.llm import langid, media, quality, queries, sharding

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "123 !"), (5, "ß"), (6, "word " * 30000), (6, "word"), (None, "x y")]


def edges(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in EDGES], "doc_id bigint, text string, score string")


def test_quality_on_held_out_rows(spark):
    out = queries.op1_quality_classifier(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("quality", "score", "predicted").collect()
    pos, neg = ([r["score"] for r in rows if r["quality"] == c] for c in (1, 0))
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.95 and np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.9


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (6, 0), (9, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(labels, edges(spark))
    got = quality.score(edges(spark), model, ["doc_id"]).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(edges(spark).where("false"), quality.train(labels.where("false"), edges(spark)), ["doc_id"]).count() == 0


def test_language_on_held_out_rows(spark):
    out = queries.op8_language_id(spark, SF)
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95 and out.count() == 1000


def grams(text, sizes=(2, 3, 4), buckets=1 << 15):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in text.encode())
    for n in sizes:
        for i in range(len(b) - n + 1):
            h = (int.from_bytes(b[i : i + n], "little") * 0x9E3779B97F4A7C15 + n) % 2**64
            yield ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> 40) % buckets


@pytest.mark.parametrize("slice_", [200, 2])
def test_language_equals_plain_counters(spark, monkeypatch, slice_):
    """Naive Bayes by dictionaries, with more labels than a slice, ties, rare labels, short and long texts."""
    monkeypatch.setattr(langid, "SLICE", slice_)
    rng = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "efgéi", "dd": "abcde", "rare": "xyz"}
    text = lambda a, n: " ".join("".join(rng.choice(alphabets[a]) for _ in range(rng.randrange(1, 7))) for _ in range(n))
    rows = [(i, text(a, rng.randrange(1, 60)), a) for i, a in enumerate([*["aa", "bb", "cc", "dd"] * 12, "rare"])]
    rows += [(100, text("bb", 4000), "bb"), (101, None, "aa"), (102, "", "cc"), (103, "Abc", None), (104, rows[0][1], "aa"), (105, "1 2", "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(df, "text", "lang")
    used = [(t, a) for _, t, a in rows if t is not None and a is not None]
    labels = sorted({a for _, a in used})
    count = {a: np.zeros(1 << 15) for a in labels}
    for t, a in used:
        for g in grams(t):
            count[a][g] += 1
    weight = {a: np.log((c + 0.5) / (c.sum() + 0.5 * len(c))) for a, c in count.items()}
    prior = {a: np.log(sum(x == a for _, x in used) / len(used)) for a in labels}
    got = {r["doc_id"]: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        g = list(grams(t))
        own = {a: sum(weight[a][x] for x in g) for a in labels}
        best = max(labels, key=lambda a: own[a] + prior[a])
        scaled = {a: own[a] * min(1, langid.EVIDENCE / max(1, len(g))) + prior[a] for a in labels}
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(np.exp(x - scaled[best]) for x in scaled.values()), rel=1e-3)


def test_quality_scores_equal_a_plain_sum(spark):
    """The folded model against words, repeats and n-grams taken one by one."""
    import re

    import xxhash

    rng = np.random.default_rng(5)
    model = {"delta": rng.normal(size=quality.BUCKETS).astype(np.float32) * 30, "bias": 0.3}
    texts = [None, "", " ", "a a b", "é é x  yz", "ab" * 700, " ".join(["aa", "bb", "cc"][k] for k in rng.integers(0, 3, 400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("score", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0d]+", b)
        ids = [xxhash.xxh64_intdigest(w, 7) % quality.BUCKETS for w in words] + [int(k > 0 and w == words[k - 1]) for k, w in enumerate(words)]
        for n in quality.SIZES:
            for k in range(len(b) - n + 1):
                g = (int.from_bytes(b[k : k + n], "little") * 0x9E3779B97F4A7C15 + n) % 2**64
                ids.append(((g ^ (g >> 31)) * 0x94D049BB133111EB % 2**64 >> 36) % quality.BUCKETS)
        z = sum(float(model["delta"][x]) for x in ids) / max(1, len(ids)) + 0.3
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_quality_sample_takes_whole_documents_up_to_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50 + i)), "x") for i in range(40)], "doc_id bigint, text string, ids string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, shift: seen.append(rows) or {"delta": np.zeros(4, np.float32), "bias": 0.0})
    quality.train(labels, docs)
    whole = sum(len(r[1]) for r in seen[0])
    monkeypatch.setattr(quality, "SAMPLE_BUCKETS", whole // 2)
    quality.train(labels, docs)
    assert len(seen[0]) == 40 and 10 < len(seen[1]) < 40 and sum(len(r[1]) for r in seen[1]) <= whole // 2
    assert all(abs(sum(r[2]) - 1) < 1e-3 for r in seen[1])


def test_quality_sample_without_a_hot_id_keeps_the_rest(spark, monkeypatch):
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(20)]
    first = spark.range(20).orderBy(F.xxhash64("id")).first()[0]  # the id that comes first is on very many rows
    docs = spark.createDataFrame(docs + [docs[first]] * 300, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, shift: seen.append(rows) or {"delta": np.zeros(4, np.float32), "bias": 0.0})
    monkeypatch.setattr(quality, "SAMPLE_BUCKETS", 40_000)
    quality.train(labels, docs)
    assert len(seen[0]) == 19


def test_language_edges(spark):
    data = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.train(data, "text", "lang")
    assert model["labels"] == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(edges(spark), model, ["doc_id"]).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5] in ("de", "en")
    none = langid.train(data.where("false"), "text", "lang")
    assert {r["lang_pred"] for r in langid.predict(edges(spark), none, ["doc_id"]).collect()} == {"und"}


def test_telephony_tables():
    u, a = media.mulaw_table(), media.alaw_table()
    assert (u[0], u[0x7F], u[0x80], u[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    for code, table in ((media.MULAW, u), (media.ALAW, a)):
        values = np.unique(table)
        assert len(values) >= 255 and (table[np.frombuffer(media.compress(values, code), np.uint8)] == values).all()


def scalar_adpcm(data, block):
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block].ljust(block, b"\0")
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = media.STEPS[index]
                delta = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - delta if nibble & 8 else value + delta))
                index = max(0, min(88, index + media.STEP_INDEX[nibble & 7]))
                out.append(value)
    return out


def test_adpcm_equals_a_scalar_decoder_and_follows_a_wave():
    data = random.Random(0).randbytes(64 * 9 + 11)
    assert media.adpcm_decode(data, 64).tolist() == scalar_adpcm(data, 64)
    wave = (8000 * np.sin(np.arange(2000) / 15)).astype(np.int16)
    file = media.wav(media.IMA_ADPCM, media.adpcm_encode(wave, 256), block_bytes=256)
    back, rate = media.decode(file)
    assert rate == 8000 and np.abs(back[:2000].astype(int) - wave)[50:].max() < 700


def test_resampling():
    x = np.array([0, 100, -100, 32767], np.int16)
    assert media.resample(x, 2, 1).tolist() == media.double_rate(x).tolist() and media.resample(x, 1, 1).tolist() == x.tolist()
    assert len(media.resample(x[:0])) == 0 and media.resample(x, 1, 2).tolist() == [0, -100]


@pytest.mark.parametrize("up, down", [(1, 2), (2, 3), (1, 5)])
def test_decimation_equals_a_plain_filter_and_damps_what_would_alias(up, down):
    rng = np.random.default_rng(up)
    x = rng.integers(-20000, 20000, 150).astype(np.int16)
    taps = media.low_pass(up, down)
    filled = np.zeros(len(x) * up, np.int64)
    filled[::up] = x
    half = len(taps) // 2
    plain = [sum(int(taps[k]) * int(filled[i + half - k]) for k in range(len(taps)) if 0 <= i + half - k < len(filled)) >> 15 for i in range(0, len(x) * up, down)]
    got = media.decimate(x, up, down)
    assert got.tolist() == [max(-32768, min(32767, v)) for v in plain[: len(got)]] and len(got) == len(x) * up // down
    t = np.arange(4000)
    low = (10000 * np.sin(t * 0.2 * np.pi * up / down)).astype(np.int16)
    high = (10000 * np.sin(t * min(0.98, 1.6 * up / down) * np.pi)).astype(np.int16)
    middle = slice(len(t) * up // down // 4, len(t) * up // down // 2)
    assert np.abs(media.decimate(low, up, down)[middle].astype(int)).max() > 9500 and np.abs(media.decimate(high, up, down)[middle].astype(int)).max() < 300
    assert len(media.decimate(x[:0], up, down)) == 0


def test_audio_digest_reads_back_what_it_stored(spark):
    for r in media.audio_digest(edges(spark)).collect():
        texts = [(t or "").encode() for i, t in EDGES if i == r["doc_id"]]
        raw = next(t for t in texts if len(t) == r["n_bytes"])
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        file = media.store_payload(payload)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    files = media.media_column(edges(spark)).collect()
    assert len(files) == len(EDGES) and all(media.parse_wav(bytes(r["pcm"]))[0] == media.PCM for r in files)


def slow_fill(names, slots):
    table, order, step = {}, sorted(range(len(names)), key=lambda i: names[i]), [0] * len(names)
    while len(table) < slots:
        for i in order:
            a, b = sharding.preference(names[i], slots)
            while len(table) < slots:
                s = (a + step[i] * b) % slots
                step[i] += 1
                if s not in table:
                    table[s] = i
                    break
    return [table[s] for s in range(slots)]


def test_sharding(spark, tmp_path):
    names = sharding.shard_names(7)
    table = sharding.fill(names, 211)
    assert table.tolist() == slow_fill(names, 211)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    less = sharding.fill(names[:-1], 211)
    kept = table < 6
    assert (table[kept] != less[kept]).mean() < 0.25
    heavy = np.bincount(sharding.fill(names[:2], 211, (3, 1)))
    assert 2.8 < heavy[0] / heavy[1] < 3.2
    with pytest.raises(ValueError):
        sharding.fill(names, 210)
    placed = sharding.place(edges(spark).withColumn("slot", F.lit("old")))
    assert placed.count() == len(EDGES) and dict(placed.dtypes)["slot"] == "int"
    assert placed.where("doc_id = 6").select("shard").distinct().count() == 1
    sharding.write_shards(edges(spark), str(tmp_path / "s"), names=names, slots=211, files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(EDGES)


def test_pipeline_stages_on_edges_and_without_rows(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.where("doc_id = 0").first()["text"]
    rows = [(None, None, None, None, None), (None, long, "en", None, 1), (5, "", "en", "s", 0), (5, " \n", None, "s", 0), (6, long, "en", "s", 9), (6, long, "en", "s", 9), (7, (long + " ") * 40, "en", "s", 9)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit("clash") for c in ("score", "node", "fp", "k", "kept", "__text")})
    for df in (odd, odd.where("false")):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == docs.columns and 0 <= out.count() <= df.count(), name
        packed = p.STAGES[-1][1](spark, df, SF)
        assert packed.agg(F.countDistinct(F.struct("doc_id"))).first()[0] == df.agg(F.countDistinct(F.struct("doc_id"))).first()[0]


def test_language_ties_go_to_the_first_label(spark):
    data = spark.createDataFrame([("abc abc", "bb"), ("abc abc", "aa")], "text string, lang string")
    got = langid.predict(data.withColumn("lang_pred", F.lit(1)), langid.train(data, "text", "lang"), ["lang"]).collect()
    assert {r["lang_pred"] for r in got} == {"aa"} and all(abs(r["score"] - 0.5) < 1e-6 for r in got)
    scores = quality.score(data, quality.train(spark.createDataFrame([("bb", 0), ("aa", 1)], "lang string, quality int"), data, id_col="lang"), ["lang"]).collect()
    assert len({r["score"] for r in scores}) == 1


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    extra = spark.createDataFrame([(10**6, "123 456", "en", "src1", 7), (10**6 + 1, before[0]["text"], None, None, None)], docs.schema)
    now = docs.unionByName(extra)
    for name, stage in p.STAGES[:-1]:
        new = p.materialise(stage(spark, now, SF), name)
        assert new.columns == docs.columns
        was, now = {r["doc_id"]: r["text"] for r in now.collect()}, new
        left = {r["doc_id"]: r["text"] for r in new.collect()}
        gone = set(was) - set(left)
        if name == "language_id":
            assert gone == {10**6}
        elif name == "quality_classifier":
            bad = [i for i in was if labels.get(i) == 0]
            assert sum(i in gone for i in bad) > 0.9 * len(bad) and sum(labels.get(i) == 1 for i in gone) <= 2
        elif name == "simhash_near_dedup":
            assert 10**6 + 1 in gone
        else:
            size, seen = p.PASSAGE_BYTES, set()
            for i in sorted(left):
                b = left[i].encode()
                own = {b[k : k + size] for k in range(len(b) - size + 1)}
                assert len(left[i]) <= len(was[i])
                seen |= own
            assert not gone
    packed = p.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()
