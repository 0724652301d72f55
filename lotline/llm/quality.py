"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams;
a softmax layer reads the average; both are trained by numpy stochastic gradient descent
on a bounded, documented sample of labelled rows. As the output is linear in the average,
scoring folds vectors and output layer into one number per bucket and class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, drop_materialised, map_texts, materialise, texts_of, unique_counts, words8, xxh64

#: Hash buckets for words and n-grams together.
BUCKETS = 1 << 17
#: Byte lengths of the character n-grams (UTF-8, word ends included).
SIZES = (3, 4, 5)
#: Width of the vectors, passes, rate and batch of the descent.
DIM, EPOCHS, RATE, BATCH = 10, 8, 0.5, 16
#: At most so many labelled rows of each class are learned from, by the order of a hash of their id.
SAMPLE_PER_CLASS = 700
#: Distinct buckets of all sampled documents together, whole documents in the order of the hash of their id; bounds the driver's memory.
SAMPLE_BUCKETS = 20_000_000


def features(texts: Texts, buckets: int = BUCKETS):
    """Yields (bucket, bounds): words, repeats of the word before, and character n-grams of each text."""
    starts, ends, first = texts.words()
    h = xxh64(texts.data, starts, ends - starts, seed=7)
    yield (h % np.uint64(buckets)).astype(np.int64), first
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    inner = first[1:-1]
    same[inner[inner < len(h)]] = 0
    yield same, first  # buckets 0 and 1: a new word, a repeated word
    lengths = np.diff(texts.offsets)
    word = words8(texts.data)[: texts.size] if texts.size else np.zeros(0, np.uint64)
    for n in SIZES:
        with np.errstate(over="ignore"):
            g = (word & np.uint64((1 << (8 * n)) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            bucket = (((g ^ (g >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(36)).astype(np.int64) % buckets
        inside = np.ones(texts.size, bool)
        for k in range(1, n):
            cut = texts.offsets[1:] - k
            inside[cut[cut >= texts.offsets[:-1]]] = False
        yield bucket[inside], np.concatenate(([0], np.cumsum(np.maximum(0, lengths - n + 1))))


def bags(df: DataFrame, label_col: str, text_col: str, hash_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(label, h, ids, counts, n, total): each row's distinct buckets and their counts as packed arrays, and how many these are."""

    def run(batches):
        for batch in batches:
            for texts in texts_of(batch.column(1), 1 << 20):
                parts = list(features(texts, buckets))
                ids, counts, totals = [], [], []
                for i in range(texts.n):
                    own, n = unique_counts(np.concatenate([b[c[i] : c[i + 1]] for b, c in parts]))
                    totals.append(int(n.sum()))
                    ids.append(own.astype(np.int32).tobytes())
                    counts.append(n.astype(np.float32).tobytes())
                head = [batch.column(i).slice(texts.first, texts.n) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(totals, pa.int64())], ["label", "h", "ids", "counts", "n", "total"])

    return df.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text"), F.col(hash_col).alias("h")).mapInArrow(run, "label int, h bigint, ids binary, counts binary, n bigint, total bigint")


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], log_odds_shift: float, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> dict:
    """Trains vectors and softmax layer on (label, bucket ids, weights that sum to 1); returns a folded model.

    log_odds_shift is added to the log odds of class 1: it undoes the balance of the sample.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    if len({r[0] for r in rows}) < 2:
        only = rows[0][0] if rows else None
        return {"delta": np.zeros(buckets, np.float32), "bias": 0.0 if only is None else (4.0 if only else -4.0)}
    steps, done = max(1, epochs * len(rows) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            lr = np.float32(rate * (1 - done / steps) + 1e-4)
            done += 1
            sizes = np.array([len(r[1]) for r in part])
            ids, weights = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            cuts = np.cumsum(sizes) - sizes
            full = sizes > 0
            mean = np.zeros((len(part), dim), np.float32)
            if full.any():
                mean[full] = np.add.reduceat(vectors[ids] * weights[:, None], cuts[full], axis=0)
            z = mean @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [r[0] for r in part]] -= 1  # gradient of the loss by the outputs
            back = p @ out.T
            out -= lr * (mean.T @ p)
            bias -= lr * p.sum(axis=0)
            # each document's pull on its vectors; rates are scaled as a bucket's share of a document is tiny
            pull = np.minimum(1, weights * 200) * lr
            for i, (_, own, _) in enumerate(part):  # a bucket is once in a document, so plain indexing adds up
                vectors[own] -= pull[cuts[i] : cuts[i] + sizes[i], None] * back[i]
    delta = vectors @ (out[:, 1] - out[:, 0])
    return {"delta": delta.astype(np.float32), "bias": float(bias[1] - bias[0] + log_odds_shift)}


def train(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Learns from `labelled` (id, label 0/1) joined with `docs`; labels null or other than 0/1 and ids null are skipped.

    The sample: for each class the sample_per_class ids with the smallest hash, without those whose documents
    have more distinct buckets than are left of SAMPLE_BUCKETS (a much repeated id shuts out none after it); whole documents, so at most 2 * sample_per_class rows and that many buckets reach the driver.
    Class shares are counted over all labels. An id that repeats in docs gives a row each; labels that repeat or
    contradict each other count each; null and empty texts have no buckets; empty tables give a model that scores 0.5.
    """
    labels = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    n = {r["__label"]: r["count"] for r in labels.groupBy("__label").count().collect()}
    hashed = labels.withColumn("__h", F.xxhash64("__id"))
    picked = [hashed.where(F.col("__label") == c).orderBy("__h", "__id").limit(sample_per_class) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1]).collect()  # at most 2 * sample_per_class ids
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked], hashed.schema)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    found = materialise(bags(sample, "__label", "__text", "__h"), "bags")
    sizes = sorted(tuple(r) for r in found.groupBy("h").agg(F.sum("n")).collect())  # a row for each id of the bounded sample
    taken_in, room = [], SAMPLE_BUCKETS
    for h, n_buckets in sizes:
        if n_buckets <= room:
            taken_in.append(h)
            room -= n_buckets
    rows, kept = [], found.where(F.col("h").isin(taken_in))
    for r in kept.toLocalIterator():
        counts = np.frombuffer(bytes(r["counts"]), np.float32)
        rows.append((r["label"], np.frombuffer(bytes(r["ids"]), np.int32), counts / max(1, r["total"])))
    drop_materialised(found)
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the order of tasks plays no part
    taken = [sum(r[0] == c for r in rows) for c in (0, 1)]
    shift = np.log(n[1] / n[0]) - np.log(taken[1] / taken[0]) if all(taken) and len(n) == 2 else 0.0
    return fit(rows, float(shift))


def scores(texts: Texts, model: dict) -> np.ndarray:
    """Probability of class 1 for each text; without features the model's bias alone."""
    total, n = np.zeros(texts.n), np.zeros(texts.n, np.int64)
    for bucket, bounds in features(texts, len(model["delta"])):
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            total[full] += np.add.reduceat(model["delta"][bucket], bounds[full], dtype=np.float64)
        n += np.diff(bounds)
    z = total / np.maximum(1, n) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score(df: DataFrame, model: dict, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns + score (double): a row for each row of df; null and empty texts get the model's bias alone, repeated rows and
    equal texts equal scores; an empty table gives no rows. Columns not named are neither read nor kept, whatever their names."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets
    types = dict(df.dtypes)

    def run(rows, texts):
        return *(rows.column(i) for i in range(len(columns))), scores(texts, shared.value)

    return map_texts(df, columns, text_col, run, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", score double", 1 << 20)
