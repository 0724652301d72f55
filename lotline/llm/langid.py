"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is a distributed count: each task adds up its documents' n-grams as a dense
buckets x languages matrix, so the shuffle carries fixed-size rows per task, and the
log-probability matrix is broadcast. Languages are taken SLICE at a time in training and
in scoring, so a task's matrix has a fixed size however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, map_texts, materialise, texts_of, words8

#: Hash buckets of the model.
BUCKETS = 1 << 15
#: Lengths in bytes of the n-grams (UTF-8; within and across words).
SIZES = (2, 3, 4)
#: Evidence of at most so many n-grams counts in a score (not in the choice of the language); without it every long text scores 1.
EVIDENCE = 200
#: Languages whose matrix a task holds at a time.
SLICE = 200
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def ngram_buckets(texts: Texts, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES):
    """For each n-gram size: the buckets of all n-grams that lie in one text, and the bounds of each text's."""
    data = LOWER[texts.data]
    word = words8(data)[: texts.size] if texts.size else np.zeros(0, np.uint64)
    lengths = np.diff(texts.offsets)
    for n in sizes:
        with np.errstate(over="ignore"):
            h = (word & np.uint64((1 << (8 * n)) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets
        inside = np.ones(texts.size, bool)
        for k in range(1, n):
            cut = texts.offsets[1:] - k
            inside[cut[cut >= texts.offsets[:-1]]] = False
        count = np.maximum(0, lengths - n + 1)
        yield bucket[inside], np.concatenate(([0], np.cumsum(count)))


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter in the sense of Unicode."""
    some = np.concatenate(([0], np.cumsum(_ASCII_LETTER[texts.data[: texts.size]])))[texts.offsets]
    out = some[1:] > some[:-1]
    for i in np.flatnonzero(~out & (np.diff(texts.offsets) > 0)):
        out[i] = _LETTER.search(bytes(texts.bytes_of(i)).decode("utf-8", "replace")) is not None
    return out


def train(df: DataFrame, text_col: str, label_col: str, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> dict:
    """The model {labels, weights[buckets, SLICE labels] of each slice, prior[labels]}, learned from all rows with a text and a label.

    Every label is learned, repeated rows count each, and empty texts count in the prior only. No usable row, as in
    an empty table, gives a model without labels. What reaches the driver is the labels and one matrix row for each.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("__label"), F.col(text_col).cast("string").alias("__text"))
    docs = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    labels = sorted(docs)
    parts = [labels[i : i + SLICE] for i in range(0, len(labels), SLICE)]
    weights = [_weights(rows if len(parts) == 1 else rows.where(F.col("__label").between(x[0], x[-1])), x, buckets, sizes) for x in parts]
    n = np.array([docs[x] for x in labels], float)
    return {"labels": labels, "weights": weights, "prior": np.log(n / n.sum()) if labels else n, "buckets": buckets, "sizes": sizes}


def _weights(rows: DataFrame, labels: list[str], buckets: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Log probabilities of the buckets under each of the labels, smoothed by half a count."""
    index = {x: i for i, x in enumerate(labels)}

    def count(batches):
        total = np.zeros((len(labels), buckets), np.int64)
        for batch in batches:
            owner = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()])
            for texts in texts_of(batch.column(1)):
                own = owner[texts.first : texts.first + texts.n]
                for bucket, bounds in ngram_buckets(texts, buckets, sizes):
                    each = np.repeat(own, np.diff(bounds))
                    ok = each >= 0
                    total += np.bincount(each[ok] * buckets + bucket[ok], minlength=total.size).reshape(total.shape)
        # a row for each label and slice of buckets: the sums then run in parallel
        step = 1 << 12
        for i in range(len(labels)):
            for at in range(0, buckets, step):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int32()), pa.array([total[i, at : at + step].tobytes()], pa.binary())], ["label", "at", "counts"])

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, at, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                new = np.frombuffer(counts, np.int64)
                sums[i, at] = sums[i, at] + new if (i, at) in sums else new
        for (i, at), counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["label", "at", "counts"])

    schema = "label int, at int, counts binary"
    total = np.zeros((len(labels), buckets))
    for r in rows.mapInArrow(count, schema).repartition("label", "at").mapInArrow(add, schema).collect():
        new = np.frombuffer(bytes(r["counts"]), np.int64)
        total[r["label"], r["at"] : r["at"] + len(new)] += new
    return np.ascontiguousarray(np.log((total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * buckets)).T, np.float32)


def log_likelihoods(texts: Texts, weights: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each text's n-gram log probabilities under each label, and its number of n-grams."""
    out, n = np.zeros((texts.n, weights.shape[1])), np.zeros(texts.n, np.int64)
    for bucket, bounds in ngram_buckets(texts, buckets, sizes):
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            out[full] += np.add.reduceat(weights[bucket], bounds[full], axis=0, dtype=np.float64)
        n += np.diff(bounds)
    return out, n


def predict(df: DataFrame, model: dict, columns: list[str], text_col: str = "text", evidence: int = EVIDENCE) -> DataFrame:
    """columns + (lang_pred, score): the language of the highest posterior, and its probability.

    The score is the posterior with the evidence of all n-grams scaled down to that of `evidence` of them; the choice is not.
    Null texts, texts without a letter and any text under a model without labels get `und` with score 0; very short texts
    lean on the prior; ties go to the label that sorts first; repeated rows stay; an empty table gives no rows.
    Columns not named are neither read nor kept, whatever their names.
    """
    types = dict(df.dtypes)
    passed = ", ".join(f"`{c}` {types[c]}" for c in columns)
    if not model["labels"]:
        return df.select(*[F.col(f"`{c}`") for c in columns], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    # the best label so far, its posterior, its scaled posterior, and the logarithm of the sum of all scaled ones
    state = ["__label", "__best", "__own", "__all"]
    kinds = "`__label` string, `__best` double, `__own` double, `__all` double"
    now = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias("__t"), F.lit(None).cast("string").alias("__label"), *[F.lit(float("-inf")).alias(x) for x in state[1:]])

    def scored(k: int, last: bool):
        labels, prior = np.array(model["labels"][k * SLICE : (k + 1) * SLICE], object), model["prior"][k * SLICE : (k + 1) * SLICE]
        shared = df.sparkSession.sparkContext.broadcast(model["weights"][k])

        def run(rows, texts):
            label, best, own, whole = (np.array(rows.column(len(columns) + j).to_pylist(), object if j == 0 else float) for j in range(4))
            ok = np.flatnonzero(has_letter(texts))
            if len(ok):
                found, n = log_likelihoods(texts, shared.value, model_buckets, model_sizes)
                found, n = found[ok], n[ok]
                logits, scaled = found + prior, found * np.minimum(1, evidence / np.maximum(1, n))[:, None] + prior
                at = logits.argmax(axis=1)
                top = logits[np.arange(len(ok)), at]
                better = top > best[ok]
                whole[ok] = np.logaddexp(whole[ok], np.logaddexp.reduce(scaled, axis=1))
                to = ok[better]
                label[to], best[to], own[to] = labels[at[better]], top[better], scaled[np.arange(len(ok)), at][better]
            out = [rows.column(i) for i in range(len(columns))]
            if not last:
                return [*out, pa.array([bytes(texts.bytes_of(i)).decode("utf-8", "replace") for i in range(texts.n)]), list(label), best, own, whole]
            none = label == None  # noqa: E711
            label[none] = "und"
            return [*out, list(label), np.where(none, 0.0, np.exp(np.minimum(0, own - np.where(none, 0, whole))))]

        return run

    model_buckets, model_sizes = model["buckets"], model["sizes"]
    slices = len(model["weights"])
    for k in range(slices):
        last = k == slices - 1
        now = map_texts(now, [*columns, *state], "__t", scored(k, last), f"{passed}, lang_pred string, score double" if last else f"{passed}, `__t` string, {kinds}", 1 << 20)
        if not last:
            now = materialise(now, "languages")
    return now
