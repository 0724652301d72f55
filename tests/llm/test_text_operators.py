"""SimHash, suffix arrays, language model, BPE and packing against brute force, with edge cases in every table."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lotline.llm import bpe, common, lm, packing, simhash, suffix, topk
from lotline.llm.queries import crc_rest, oracle_sql

WORD = r"[^\x20\x09-\x0d]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def word(rng, letters="abcdeé"):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))


def corpus(spark, seed=0, n=150, words=60):
    """Documents with nulls, blanks, copies, near copies, runs, long texts, repeated rows and a clashing extra column."""
    rng = random.Random(seed)
    passage = [" ".join(word(rng) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(n):
        k = rng.random()
        if k < 0.05:
            t = None
        elif k < 0.1:
            t = rng.choice(["", " \t\n", "!?", "A"])
        elif k < 0.18:
            t = "ab" * rng.randrange(1, 300)
        elif k < 0.28 and rows:
            t = rng.choice(rows)[1]
        elif k < 0.45 and rows:
            t = rng.choice(rows)[1] or ""
            j = rng.randrange(len(t) + 1)
            t = t[:j] + word(rng) + t[j:]
        else:
            t = " ".join(word(rng) for _ in range(rng.randrange(words)))
            for _ in range(rng.randrange(3)):
                t += " " + rng.choice(passage)[rng.randrange(30) :] + "\n" + word(rng)
        rows.append((i, t, "x"))
    rows.append((n, " ".join(word(rng) for _ in range(9000)), "x"))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, fp string")


def test_xxh64_of_slices():
    rng = np.random.default_rng(0)
    data = np.concatenate((rng.integers(0, 256, 5000, dtype=np.uint8), np.zeros(common.PAD, np.uint8)))
    starts, sizes = rng.integers(0, 4000, 800), rng.integers(0, 900, 800)
    sizes[:300] %= 40
    got = common.xxh64(data, starts, sizes)
    assert all(int(h) == xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for h, a, n in zip(got, starts, sizes))


# ---------------------------------------------------------------- simhash


def brute_print(t, k=4):
    w = re.findall(WORD, lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(ids, prints, bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = collections.defaultdict(lambda: 10**9)
    for i, d in enumerate(ids):
        low[find(i)] = min(low[find(i)], d)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_components_equal_brute_force(spark):
    rows, df = corpus(spark, 1, 120, 25)
    prints = [brute_print(t) for _, t, _ in rows]
    want = sorted(zip([r[0] for r in rows], prints, brute_components([r[0] for r in rows], prints, 4)))
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == want


def test_no_link_is_lost_in_dense_and_sparse_buckets(spark, monkeypatch):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(40)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centre for _ in range(15)}
    # a chain whose ends are far apart
    x = rng.getrandbits(64)
    for b in range(0, 60, 4):
        prints.add(x := x ^ (0xF << b))
    prints = sorted(prints)
    want = brute_components(list(range(len(prints))), prints, 4)
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp bigint")
    for sweep in (256, 2):
        monkeypatch.setattr(simhash, "SWEEP", sweep)
        fp = np.array(prints, np.uint64)[:, None]
        key = np.zeros(len(fp), np.int64)
        a, b = simhash.linked_pairs(key, fp, simhash.reference_fingerprints(), 4)
        assert (simhash.hamming(fp[a], fp[b]) <= 4).all()
        left = list(range(len(prints)))
        for i, j in zip(a.tolist(), b.tolist()):
            lo, hi = sorted((left[i], left[j]))
            left = [lo if v == hi else v for v in left]
        assert left == want
    edges = simhash.components(simhash.links(nodes))
    low = {r["u"] % 2**64: r["v"] % 2**64 for r in edges.collect()}
    got = collections.defaultdict(set)
    for i, p in enumerate(prints):
        got[low.get(p, p)].add(i)
    assert sorted(map(min, got.values())) == sorted(set(want)) and sorted(map(len, got.values())) == sorted(collections.Counter(want).values())


def test_buckets_handed_on_in_chunks_give_the_same_components(spark, monkeypatch):
    """Both radii: buckets beyond what a task holds, in batches smaller than a bucket, lose no link."""
    rng = random.Random(5)
    flip = lambda x, bits, most: x ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(most)))
    narrow = sorted({flip(c, 64, 6) for c in [rng.getrandbits(64) for _ in range(6)] for _ in range(25)})
    wide = sorted({flip(c, 256, 45) for c in [rng.getrandbits(256) for _ in range(4)] for _ in range(15)})
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in narrow], "fp bigint")
    wide_nodes = spark.createDataFrame([(k, bytearray(p.to_bytes(32, "little"))) for k, p in enumerate(wide)], "node bigint, fp binary")
    named = lambda edges: sorted(map(tuple, simhash.components(edges).collect()))
    whole = named(simhash.links(nodes)), named(simhash.wide_links(wide_nodes))
    assert len(whole[0]) > 20 and len(whole[1]) > 20
    low = dict((u % 2**64, v % 2**64) for u, v in whole[0])
    want = brute_components(list(range(len(narrow))), narrow, 4)
    assert len({low.get(p, p) for p in narrow}) == len(set(want))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    search, limits = simhash._search, []
    monkeypatch.setattr(simhash, "_search", lambda *a: limits.append(a[-1]) or search(*a))
    try:
        got = named(simhash.links(nodes, crowd=4)), named(simhash.wide_links(wide_nodes, crowd=4))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == whole and limits == [4, None, 4, None]


def test_simhash_without_rows_and_with_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.simhash_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (7, "other words in here now"), (7, "other words in here now")], "doc_id bigint, text string")
    kept = simhash.keep_one_per_component(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 7]


@pytest.mark.parametrize("find", [simhash.simhash_components, simhash.similar_components])
def test_one_row_stays_of_each_component_whatever_its_ids(spark, find):
    texts = [" ".join(word(random.Random(k), "abcdefghijklm") + str(j) for j in range(80)) for k in range(5)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[2]), (3, texts[3]), (9, texts[3]), (None, texts[4]), (9, texts[4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.keep_one_per_component(df, find=find)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (9, texts[4])], df.schema).collect()))


def test_pairs_at_the_radius_meet_by_bands_of_one_plan(spark):
    """The links of nodes depend on the nodes only, and pairs WIDE_BITS apart are found with the stated probability."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        one = rng.integers(0, 2, 256, dtype=np.uint8)
        two = one.copy()
        two[rng.choice(256, simhash.WIDE_BITS, replace=False)] ^= 1
        rows += [(2 * k, bytearray(np.packbits(one).tobytes())), (2 * k + 1, bytearray(np.packbits(two).tobytes()))]
    met = {(r["u"], r["v"]) for r in simhash.wide_links(spark.createDataFrame(rows, "node bigint, fp binary")).collect()}
    assert met <= {(2 * k + 1, 2 * k) for k in range(400)} and len(met) >= 0.94 * 400


def test_copies_with_a_similarity_of_0_8_meet(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        w = [word(rng, "abcdefghijklm") for _ in range(rng.randrange(120, 400))]
        near = list(w)
        for j in rng.sample(range(len(w)), max(1, len(w) // 80)):
            near[j] = word(rng, "xyz")
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(word(rng, "abcdefghijklm") for _ in range(200)))]
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")

    def shingles(t):
        w = re.findall(WORD, lower(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df).collect()}
    alike = [k for k in range(60) if len(shingles(rows[3 * k][1]) & shingles(rows[3 * k + 1][1])) / len(shingles(rows[3 * k][1]) | shingles(rows[3 * k + 1][1])) >= 0.8]
    assert len(alike) > 40 and sum(got[3 * k + 1] == 3 * k for k in alike) >= 0.95 * len(alike)
    assert all(got[3 * k + 2] == 3 * k + 2 for k in range(60)) and got[1002] == 0 and got[1001] == 1000 and got[None] == 0
    assert simhash.similar_components(df.where("false")).count() == 0


def test_links_of_similar_texts_equal_brute_force(spark, monkeypatch):
    """Near copies on both sides of 0.8, in groups, chains and crowded buckets; nothing below 0.8 links, next to nothing above is lost."""
    rng = random.Random(12)
    texts = []
    for k in range(60):
        w = [word(rng, "abcdefghijklm") for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(w))
            for j in rng.sample(range(len(w)), max(1, len(w) // rng.choice([25, 40, 60, 100]))):
                w[j] = word(rng, "xyz")
    texts += ["a b", "a b", "A  b", "a c", None, "", texts[0] + " end", " ".join(["same line of words here now"] * 50)]

    def shingles(t):
        w = re.findall(WORD, lower(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = [find(i) for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("node", F.lit("clash"))
    for sweep in (256, 2):
        monkeypatch.setattr(simhash, "SWEEP", sweep)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df).collect()}
        apart = sum(got[i] != want[i] for i in range(len(texts)))
        assert all(want[i] == want[got[i]] for i in range(len(texts))), "a link below 0.8"
        assert 60 < len(set(want)) < len(texts) - 60 and apart <= 0.02 * len(texts)


# ---------------------------------------------------------------- repeated passages


def brute_repeats(rows, size, keep_first):
    seen = collections.defaultdict(list)
    for d, (_, t, *_) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]].append((d, p))
    out = []
    for d, (i, t, *_) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            where = seen[b[p : p + size]]
            if where[0] != (d, p) if keep_first else len(where) > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd,keep_first", [(600, False), (2, True), (2, False)])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, crowd, keep_first):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rows, df = corpus(spark, crowd)
    got = sorted(tuple(r) for r in suffix.find_repeats(df, ["doc_id"], "doc_id", length=64, keep_first=keep_first).collect())
    assert got == brute_repeats(rows, 64, keep_first) and sum(r[2] for r in got)


def test_a_crowded_anchor_is_cut_in_several_tasks(spark, monkeypatch):
    """All texts share one passage with its anchor and differ beside it: their segments are banded where they lie, not in the anchor's task."""
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh") for _ in range(80))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(20)) + shared + "".join(rng.choice("ijklmnop") for _ in range(20)), "x") for i in range(400)]
    tasks, real = [], suffix.materialise

    def spy(df, name):
        out = real(df.withColumn("task", F.spark_partition_id()) if name == "bands" else df, name)
        if name == "bands":
            k = out.groupBy("h").agg(F.min("task").alias("task"))
            tasks.append(k.select("task").distinct().count())
            out = out.drop("task")
        return out

    monkeypatch.setattr(suffix, "materialise", spy)
    monkeypatch.setattr(suffix, "CROWD", 50)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as on tables that are not small
    for name, value in large.items():
        spark.conf.set(name, value)
    try:
        got = sorted(tuple(r) for r in suffix.find_repeats(df, ["doc_id"], "doc_id", length=64).collect())
    finally:
        for name in large:
            spark.conf.unset(name)
    assert got == brute_repeats(rows, 64, False) and all(r[2] >= 80 for r in got)
    assert tasks and tasks[0] > 1


def test_kept_text_is_what_the_digest_says(spark):
    rows, df = corpus(spark, 4)
    out = suffix.find_repeats(df, ["doc_id"], "doc_id", length=64, want_text=True).collect()
    whole = [r for r in out if "\ufffd" not in r["kept"]]
    assert len(out) == len(rows) and len(whole) > 0.7 * len(rows)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in whole)
    assert all(r["kept"] == (dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "") for r in out if not r["n_removed"])


def test_periodic_long_texts(spark):
    """One long period, two texts that share it, and a very long text without repeats."""
    rng = random.Random(2)
    rows = [(0, "ab" * 40_000, "x"), (1, "x" + "ab" * 300 + "y", "x"), (2, "".join(rng.choice("cdefgh") for _ in range(60_000)), "x"), (3, "abc" * 21, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.find_repeats(df, ["doc_id"], "doc_id", length=64).collect()}
    assert got == {0: (80_000, 80_000, 1), 1: (602, 600, 1), 2: (60_000, 0, 0), 3: (63, 0, 0)}


def test_kept_text_is_whole_characters(spark):
    a, b = "é" * 90, "x" + "é" * 90
    df = spark.createDataFrame([(1, a, "k"), (2, b, "k"), (3, None, "k")], "doc_id bigint, text string, n_bytes string")
    out = {r["doc_id"]: r for r in suffix.find_repeats(df, ["doc_id"], "doc_id", length=65, keep_first=True, want_text=True, whole_characters=True).collect()}
    assert "�" not in "".join(r["kept"] for r in out.values()) and out[3]["kept"] == ""
    assert set(out[2]["kept"]) <= {"x", "é"} and len(out[2]["kept"]) < 10
    assert suffix.find_repeats(df.where("false"), ["doc_id"], "doc_id").count() == 0


def test_longest_previous_factors():
    rng = random.Random(5)
    text = "".join(rng.choice("ab") for _ in range(300)).encode()
    data = np.zeros(len(text) + 64, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    starts = np.arange(len(text) - 16 + 1)
    earlier, later = suffix.previous_factors(data, len(text), starts, np.zeros(len(starts), np.int64), 16)
    for i in starts:
        assert (earlier[i] >= 16) == any(text[j : j + 16] == text[i : i + 16] for j in range(i))
        assert (later[i] >= 16) == any(text[j : j + 16] == text[i : i + 16] for j in range(i + 1, len(starts)))
        best = max((next(k for k in range(17) if k == 16 or text[i + k] != text[j + k]) for j in range(i)), default=0)
        assert earlier[i] <= best < earlier[i] + 8 or best == earlier[i]


# ---------------------------------------------------------------- language model


def test_base_score_is_exact_and_the_tree_is_a_distribution(spark):
    rows, df = corpus(spark, 7, 200)
    out = {r["doc_id"]: r for r in lm.lm_scores(df, crc_rest(7) != 2).collect()}
    tokens = {i: re.findall(WORD, lower(t)) + [None] for i, t, _ in rows}
    c = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for i, w in tokens.items():
        r = out[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[k] + 1) / (n + v + 1)) for k in w), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[k] > 0 for k in w), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0
    assert sum(r["score"] for r in out.values()) > sum(r["base_score"] for r in out.values())


def test_probabilities_of_a_state_sum_to_one(spark):
    """Over all words of a tiny corpus and one unknown word, after any retained context."""
    text = "a b a b a b a c . " * 40
    vocabulary = ["a", "b", "c", "."]
    docs = spark.createDataFrame([(0, text), *((i + 1, f"{x} {y}") for i, (x, y) in enumerate((x, y) for x in vocabulary for y in [*vocabulary, "zz"]))], "doc_id bigint, text string")
    out = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, F.col("doc_id") == 0, depth=1).collect()}
    ends = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs.unionByName(spark.createDataFrame([(100 + i, x) for i, x in enumerate(vocabulary)], "doc_id bigint, text string")), F.col("doc_id") == 0, depth=1).collect()}
    assert all(math.isfinite(x) for x in [*out.values(), *ends.values()])
    assert ends[100] < 0 and out[2] > out[5]  # after "a", "b" is likelier than an unknown word


def test_language_model_without_training_rows_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert [(r["n_tokens"], r["base_score"], r["score"]) for r in lm.lm_scores(df, F.lit(False)).orderBy("doc_id").collect()] == [(3, 0.0, 0.0), (1, 0.0, 0.0)]
    assert lm.lm_scores(df.where("false"), F.lit(True)).count() == 0


def test_language_model_on_clashing_columns_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 20_000)
    rng = random.Random(6)
    long = " ".join(word(rng) for _ in range(30_000))
    rows = [(1, long), (2, "a b a b"), (2, "a b a b"), (None, "a b"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("block", "score", "ids", "part", "__train")})
    want = brute_scores([t for _, t in rows], [i is None or i != 4 for i, _ in rows], 4)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.lm_scores(df, F.col("doc_id").isNull() | (F.col("doc_id") != 4)).collect())
    expect = sorted((str(i), len(re.findall(WORD, t)) + 1, s) for (i, t), s in zip(rows, want, strict=True))
    assert [g[:2] for g in got] == [e[:2] for e in expect] and all(a[2] == pytest.approx(b[2], rel=1e-9) for a, b in zip(got, expect, strict=True))


def brute_scores(texts, train, depth, least=2, discount=0.5, divergence=3.0):
    """log10 probabilities by plain counters over all contexts of up to `depth` words."""
    tokens = [re.findall(WORD, lower(t)) + [None] for t in texts]
    grams = [collections.Counter(tuple(w[i - k : i + 1]) for w, t in zip(tokens, train) if t for i in range(k, len(w))) for k in range(depth + 1)]
    n, v = sum(grams[0].values()), len(grams[0])
    factor = {}

    def log_p(past, w):
        if not past:
            return math.log10((grams[0][(w,)] + 1) / (n + v + 1))
        if past not in factor:
            return log_p(past[1:], w)
        c = grams[len(past)][(*past, w)]
        return math.log10((c - discount) / grams[len(past) - 1][past]) if c >= least else log_p(past[1:], w) + factor[past]

    for k in range(1, depth + 1):
        after = collections.defaultdict(list)
        for g, c in grams[k].items():
            if c >= least:
                after[g[:-1]].append((g[-1], c))
        new = {}
        for past, followers in after.items():
            total = grams[k - 1][past]
            p = [((c - discount) / total, 10 ** log_p(past[1:], w), c) for w, c in followers]
            f = max(1e-9, 1 - sum(x for x, _, _ in p)) / max(1e-9, 1 - min(sum(y for _, y, _ in p), 1 - 1e-9))
            if sum(c * math.log(x / y) for x, y, c in p) + (total - sum(c for _, _, c in p)) * math.log(f) >= divergence:
                new[past] = math.log10(f)
        factor |= new
    return [sum(log_p(tuple(w[max(0, i - depth) : i]), w[i]) for i in range(len(w))) for w in tokens]


@pytest.mark.parametrize("depth, hot", [(2, 500_000), (4, 500_000), (1, 7), (4, 7), (5, 60)])
def test_tree_of_the_whole_corpus_equals_plain_counters(spark, monkeypatch, depth, hot):
    """Sequences seen twice are learned however large the corpus is, in many blocks and shards, and with split contexts."""
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "BLOCK", 60_000)
    monkeypatch.setattr(lm, "SHARD", 30_000)
    monkeypatch.setattr(lm, "CHUNK", 900)
    rows, df = corpus(spark, 11, 120)
    rng = random.Random(5)
    rare = " ".join(word(rng, "qrstuv") for _ in range(60))
    rows += [(1000, rare, "x"), (1001, rare, "x"), *((2000 + i, " ".join(word(rng, "fghijk") for _ in range(2000)), "x") for i in range(60))]
    df = spark.createDataFrame(rows, df.schema)
    want = brute_scores([t for _, t, _ in rows], [i % 5 != 2 for i, _, _ in rows], depth)
    out = {r["doc_id"]: r for r in lm.lm_scores(df, F.col("doc_id") % 5 != 2, depth=depth).collect()}
    assert len(out) == len(rows) and all(out[i]["score"] == pytest.approx(x, rel=1e-9) for (i, _, _), x in zip(rows, want, strict=True))
    assert out[1000]["score"] > 0.5 * out[1000]["base_score"]  # 61 tokens in a corpus of over 100,000


# ---------------------------------------------------------------- tokens


NASTY = ["", " ", "a" * 3000, "ab" * 700 + " " * 50 + "\n\n\t x", "é" * 300, "<|endoftext|> hi", "日本語テキスト 12345678901234567890 " * 20, "it's we'll I'd", "🙂🙂 ​ x", "%%%###" * 40]


@pytest.fixture(scope="module")
def paths():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, paths):
    tiktoken = pytest.importorskip("tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=paths[1], mergeable_ranks=bpe.read_ranks(paths[0]), special_tokens={})
    rng = random.Random(0)
    texts = [*NASTY, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 3000)])) for _ in range(400)) for _ in range(20))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (0, texts[2])], "doc_id bigint, text string")
    rows = bpe.encode_table(df, paths[0], paths[1]).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        own = [texts[2]] if r["doc_id"] == 0 and r["ids"] else [texts[r["doc_id"]] if r["doc_id"] != 99 else ""]
        assert r["ids"] == encoding.encode_ordinary(own[0]) and bytes(r["decoded"]).decode() == own[0]
    for r in bpe.encode_digest(df.where("doc_id = 3"), paths[0], paths[1]).collect():
        ids = encoding.encode_ordinary(texts[3])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[3].encode()).hexdigest())


def test_packing_places_every_token_once(spark, paths):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(paths[2])
    rng = random.Random(1)
    texts = [*NASTY, "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", " <|endoftext", None, *(" ".join(word(rng) for _ in range(rng.randrange(900))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a"), (None, "a")], "doc_id bigint, text string")
    rows = packing.pack(df, paths[2]).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1]) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    assert t.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    assert len(by[None]) == 2
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, size in sorted(content):
            assert offset == at
            at += size
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 1
    assert packing.pack(df.where("false"), paths[2]).count() == 0


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1025, 3000), rng.integers(200, 500, 3000), rng.choice([341, 342, 171, 512, 513], 3000), np.array([1024] * 5), np.array([700] * 3)):
        h = collections.Counter(lengths.tolist())
        runs = packing.plan(dict(h))
        used = collections.Counter()
        for content, n in runs:
            assert sum(s * k for s, k in content) <= 1024
            for s, k in content:
                used[s] += n * k
        plain = packing.Bins(1024)
        for s in sorted(h, reverse=True):
            plain.best_fit(s, h[s])
        assert used == h and sum(n for _, n in runs) <= 1.02 * sum(n for _, n in plain.runs()) + 1
    assert packing.plan({}) == []


# ---------------------------------------------------------------- search


@pytest.mark.parametrize("wild", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, wild):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(int(wild))
    x = rng.normal(size=(400, 12)) * rng.lognormal(0, 1.5, (400, 1)) * (2e3 if wild else 1)
    x[50:60] = x[40]
    rows = [(i, [float(v) for v in np.float32(r)], "q") for i, r in enumerate(x)]
    bad = [(1000, None, "q"), (1001, [float("nan")] * 12, "q"), (1010, [None] * 12, "q"), (1020, [float("inf")] * 12, "q"), (None, None, "q")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, score string")
    v = {i: [math.floor(1024 * y) for y in e] for i, e, _ in rows}
    want = []
    for q in v:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 10 == 0).collect())
    assert got == sorted(want)


def test_top_k_with_repeated_and_null_ids(spark, monkeypatch):
    """Every row but the query's own is a candidate, and each row with a query's id is a query; by loops and by the registered SQL."""
    monkeypatch.setattr(topk, "CANDIDATES", 30)
    monkeypatch.setattr(topk, "RUN", 7)
    rng = np.random.default_rng(8)
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 60)), [float(v) for v in np.float32(rng.normal(size=6))]) for _ in range(200)]
    rows += rows[:40]
    rows = [(None if i is None else i * 10, e) for i, e in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    v = [(i, [math.floor(1024 * y) for y in e]) for i, e in rows]
    want = []
    for at, (q, e) in enumerate(v):
        if q is not None and q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f)), c is None, c or 0) for n, (c, f) in enumerate(v) if n != at)[:10]
            want += [(q, k + 1, None if none else c, -s) for k, (s, none, c) in enumerate(best)]
    assert any(r[2] is None for r in want)
    assert sorted(map(tuple, topk.top_k(df, lambda i: i % 100 == 0).collect()), key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    assert sorted(con.execute(oracle_sql()["op4_exact_topk"]).fetchall(), key=str) == sorted(want, key=str)


def test_top_k_with_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (10, [-1.0]), (3, [0.0])], "vec_id bigint, embedding array<float>")
    assert len(topk.top_k(df, lambda i: i % 10 == 0).collect()) == 4
    assert topk.top_k(df.where("false"), lambda i: i % 10 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 3"), lambda i: i % 10 == 0).count() == 0


def test_anchors_of_a_very_long_text_are_found_in_steps(monkeypatch):
    rng = np.random.default_rng(7)
    text = rng.integers(97, 101, 9000).astype(np.uint8)
    offsets = np.array([0, 50, 9000])
    data = np.concatenate((text, np.zeros(64, np.uint8)))
    whole = suffix.segments(data, offsets, 400)
    monkeypatch.setattr(suffix, "STEP", 1300)
    own, first, last, anchor, key, _ = suffix.segments(data, offsets, 400)
    assert (own == 1).all() and len(first) > len(whole[1])
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert (covered == np.arange(50, 9000 - 399)).all()
    by_start = {p: (c, k) for a, b, c, k in zip(*(x.tolist() for x in whole[1:5]), strict=True) for p in range(a, b + 1)}
    assert all(by_start[a] == (c, k) == by_start[b] for a, b, c, k in zip(first.tolist(), last.tolist(), anchor.tolist(), key.tolist(), strict=True))


def test_slices_of_the_tree_stay_large_at_six_gigabytes():
    """Each block sends a slice to each shard; small slices cost more than their windows do."""
    tokens = 6 * (1 << 30) // 4
    assert lm.BLOCK // 4 * lm.SHARD // tokens >= 1000 and lm.HOT <= lm.SHARD
