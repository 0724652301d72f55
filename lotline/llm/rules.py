"""Quality rules with risk-controlled thresholds.

Each text is measured once: counts of words, lines, symbols and repeats, and from them one integer statistic
in 0..1000 for each rule (the higher, the worse). Fixed base rules reject at once. For the other rules labelled documents
that pass the base are parted in two folds. In the shape fold each stratum proposes a sequence of levels: at a level a rule's cutoff
is the smallest that rejects at most a given share of the fold's good documents, and it is used if it rejects a larger share of
the bad ones. In the holdout fold the levels are tested in order, each as a whole (all its rules together): a level is certified
if so few good documents are rejected that, were the true share of false rejections above `alpha`, this would have a probability of at most
`delta` / strata (the exact binomial tail, equal to a Clopper-Pearson upper bound of at most alpha). The first level that fails ends the
sequence, so the levels of a stratum need no further correction; the division by the number of strata (Bonferroni) covers
the rest. With confidence 1 - delta no stratum loses more than alpha of its good documents. Of the certified levels the one that
separates the shape fold best is taken; a stratum without any rejects nothing beyond the base.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, Texts, drop_materialised, map_texts, materialise, mix, segment_sums, xxh64

#: Most false rejections of a stratum, and the chance that any stratum has more.
ALPHA, DELTA = 0.05, 0.05
#: Levels: the share of the shape fold's good documents, in thousandths, that one rule may reject.
LEVELS = (0, 1, 2, 5, 10, 20, 30, 50)
#: The rules in the order of their statistics.
RULES = ("symbols", "capitals", "digits", "marks", "dup_lines", "repeats", "long_words", "short_words")
#: Strata whose cutoffs are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST = 100_000
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, bool)
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each (group, hash) comes more than once."""
    key = mix(h + group.astype(np.uint64) * _ODD)
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    out = np.empty(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def line_counts(texts: Texts, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line of the text. first_word: where words start, ascending."""
    cuts = np.flatnonzero(texts.data[: texts.size] == 10)
    starts = np.unique(np.concatenate((texts.offsets[:-1], cuts + 1)))
    starts = starts[starts < texts.size] if texts.size else starts[:0]
    ends = np.append(starts[1:], texts.size)
    ends = ends - (texts.data[ends - 1] == 10) if len(ends) else ends
    full = np.searchsorted(first_word, starts) < np.searchsorted(first_word, ends)
    starts, ends = starts[full], ends[full]
    own = np.searchsorted(texts.offsets, starts, "right") - 1
    key = mix(xxh64(texts.data, starts, ends - starts) + own.astype(np.uint64) * _ODD)
    once = own[np.unique(key, return_index=True)[1]]
    n = np.bincount(own, minlength=texts.n)
    return n, n - np.bincount(once, minlength=texts.n)


def repeat_counts(texts: Texts, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Words inside windows of WINDOW words that come twice or more in their text."""
    if len(starts) < WINDOW:
        return np.zeros(texts.n, np.int64)
    word = xxh64(texts.data, starts, ends - starts)
    own = np.repeat(np.arange(texts.n), np.diff(before))
    n = len(word) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = mix(h * _ODD + word[j : j + n])
    whole = np.flatnonzero(own[:n] == own[WINDOW - 1 :])
    at = whole[repeated(own[whole], h[whole])]
    step = np.zeros(len(word) + 1, np.int64)
    step[at] += 1
    step[at + WINDOW] -= 1
    return segment_sums((np.cumsum(step)[:-1] > 0).astype(np.int64), before)


def measures(texts: Texts) -> tuple[list[np.ndarray], np.ndarray]:
    """The COUNTS of each text, and its statistics (texts x RULES)."""
    data = texts.data[: texts.size]
    starts, ends, before = texts.words()
    count = lambda mask: segment_sums(mask.astype(np.int64), texts.offsets)
    words = np.diff(before)
    chars = count(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols, upper, digits, marks = count(SYMBOL[data]), count((data >= 65) & (data <= 90)), count((data >= 48) & (data <= 57)), count(MARK[data])
    lines, dup_lines = line_counts(texts, starts)
    repeats = repeat_counts(texts, starts, ends, before)
    share = lambda a, b, k=1000: np.minimum(1000, k * a // np.maximum(1, b))
    length = share(chars, words, 50)
    stats = [share(symbols, chars), share(upper, chars), share(digits, chars), share(marks, chars), share(dup_lines, lines), share(repeats, words), length, 1000 - length]
    return [words, chars, symbols, dup_lines, repeats], np.stack(stats, axis=1).astype(np.int32)


def measure(docs: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """(id, stratum, COUNTS, stats, base_failed): a row for each row of docs."""

    def run(rows, texts):
        counts, stats = measures(texts)
        return rows.column(0), rows.column(1), *counts, [x for x in stats]

    kind = dict(docs.dtypes)[id_col]
    named = docs.select(F.col(id_col).alias("id"), stratum.cast("string").alias("stratum"), F.col(text_col).alias("text"))
    out = map_texts(named, ["id", "stratum"], "text", run, f"id {kind}, stratum string, {', '.join(f'{c} bigint' for c in COUNTS)}, stats array<int>")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def labelled(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, holdout: Column) -> DataFrame:
    """(stratum, stats, good, holdout): one row for each id with one label, of those that pass the base."""
    agreed = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    agreed = agreed.where((F.col("low") == F.col("high")) & F.col("low").isin(0, 1)).select("id", (F.col("low") == 1).alias("good"))
    passed = measured.where(~F.col("base_failed")).groupBy("id").agg(F.min(F.struct("stratum", "stats")).alias("x"))
    return passed.join(agreed, "id").withColumn(id_col, F.col("id")).select("x.stratum", "x.stats", "good", holdout.alias("holdout"))


def proposed(shape: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(stratum, level, rule, cutoff): the cutoffs of each level in use, from counts of each statistic's values."""
    values = shape.select("stratum", "good", F.posexplode("stats").alias("rule", "value"))
    counts = values.groupBy("stratum", "rule", "value").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    own = Window.partitionBy("stratum", "rule")
    above = own.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tails = counts.select("stratum", "rule", "value", "good", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("good", "bad")], *[F.sum(c).over(own).alias(f"{c}_all") for c in ("good", "bad")])
    # a cutoff just above a value rejects what lies above the value
    offered = tails.where(F.col("good") > 0).withColumn("level", F.explode(F.lit(list(range(len(levels))))))
    offered = offered.where(1000 * F.col("good_above") <= F.element_at(F.lit(list(levels)), F.col("level") + 1) * F.col("good_all"))
    least = offered.groupBy("stratum", "rule", "level").agg(F.min(F.struct("value", "good_above", "bad_above", "good_all", "bad_all")).alias("x"))
    useful = F.col("x.bad_above") * F.col("x.good_all") > F.col("x.good_above") * F.col("x.bad_all")
    return least.where(useful).select("stratum", "level", "rule", (F.col("x.value") + 1).alias("cutoff"))


def log_tail(k: int, n: int, p: float) -> float:
    """log of the probability of at most k of n, each with probability p."""
    if k >= n:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(x - top) for x in terms)))


def upper_bound(k: int, n: int, risk: float) -> float:
    """The Clopper-Pearson upper bound of a share of which k of n were seen, with confidence 1 - risk."""
    lo, hi = k / n if n else 1.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid < 1 and log_tail(k, n, mid) > math.log(risk) else (lo, mid)
    return hi


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def rejected(cutoffs: str) -> Column:
    """Whether any of a text's statistics reaches its rule's cutoff (a list of rule and cutoff; null: none)."""
    return F.coalesce(F.exists(cutoffs, lambda x: F.get("stats", x["rule"]) >= x["cutoff"]), F.lit(False))


def thresholds(rows: DataFrame, alpha: float = ALPHA, delta: float = DELTA, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(stratum, level, cutoffs, n, k, bound): the certified cutoffs of each stratum that has any.

    rows: (stratum, stats, good, holdout). n, k: good documents of the holdout and those rejected; bound: the upper bound of the share
    rejected. Strata without good documents in both folds, or with too few to certify anything, have no row; null is a stratum. Empty tables give no rows.
    """
    cuts = materialise(proposed(rows.where(~F.col("holdout")), levels).groupBy("stratum", "level").agg(F.sort_array(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "cutoffs")
    plan = cuts.groupBy(F.col("stratum").alias("__s")).agg(F.sort_array(F.collect_list(F.struct("level", "cutoffs"))).alias("plan"))
    tried = rows.join(broadcast_if_small(plan), F.col("stratum").eqNullSafe(F.col("__s")), "left")
    # levels without any rule in use reject nothing
    tried = tried.select("stratum", "stats", "good", "holdout", "plan", F.explode(F.lit(list(range(len(levels))))).alias("level"))
    tried = tried.withColumn("own", F.get(F.filter("plan", lambda x: x["level"] == F.col("level")), F.lit(0))["cutoffs"])
    is_good, hit = F.col("good"), rejected("own")
    sums = tried.groupBy("stratum", "level").agg(
        F.count_if(is_good & F.col("holdout")).alias("n"),
        F.count_if(is_good & F.col("holdout") & hit).alias("k"),
        F.count_if(is_good & ~F.col("holdout")).alias("g"),
        F.count_if(is_good & ~F.col("holdout") & hit).alias("g_hit"),
        F.count_if(~is_good & ~F.col("holdout")).alias("b"),
        F.count_if(~is_good & ~F.col("holdout") & hit).alias("b_hit"),
    )
    sums = materialise(sums.where("n > 0"), "levels")
    strata = max(1, sums.select("stratum").distinct().count())

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        risk = delta / strata
        for f in frames:
            pairs = list(zip(f["k"].tolist(), f["n"].tolist(), strict=True))
            f["passes"] = [k <= alpha * n and log_tail(k, n, alpha) <= math.log(risk) for k, n in pairs]
            f["bound"] = [upper_bound(k, n, risk) if ok else 1.0 for (k, n), ok in zip(pairs, f["passes"], strict=True)]
            yield f[["stratum", "level", "n", "k", "passes", "bound", "gain"]]

    tested = sums.select("stratum", "level", "n", "k", (F.col("b_hit") * F.col("g") - F.col("g_hit") * F.col("b")).alias("gain"))
    tested = tested.mapInPandas(test, "stratum string, level int, n bigint, k bigint, passes boolean, bound double, gain bigint")
    own = Window.partitionBy("stratum")
    so_far = F.min("passes").over(own.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    best = tested.withColumn("passes", so_far).where("passes and gain > 0").withColumn("r", F.row_number().over(own.orderBy(F.col("gain").desc(), "level"))).where("r = 1")
    cuts_of = cuts.select(F.col("stratum").alias("__s"), F.col("level").alias("__l"), "cutoffs")
    found = best.join(cuts_of, F.col("stratum").eqNullSafe(F.col("__s")) & (F.col("level") == F.col("__l")))
    out = materialise(found.select("stratum", "level", "cutoffs", "n", "k", "bound"), "thresholds")
    drop_materialised(cuts)
    drop_materialised(sums)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, holdout: Column, stratum: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """id, COUNTS, base_failed, kept: a row for each row of docs; kept: passes the base and its stratum's certified cutoffs.

    holdout: an expression of the id that parts labelled documents. stratum: an expression of the columns of docs, null is a stratum of its own.
    Null and empty texts have no words and fail the base. Labels that are null, other than 0 and 1, without id or contradictory aren't used; of
    documents that share an id one counts as evidence (the smallest by stratum and statistics), all are judged. Empty tables: no rows, or, without labels,
    the base alone. Very long texts are measured whole; lines, words and windows are told apart by 64 bits of hash. Other columns aren't read.
    """
    measured = materialise(measure(docs, id_col, text_col, stratum), "measures")
    evidence = materialise(labelled(measured, labels, id_col, label_col, holdout), "evidence")
    found = thresholds(evidence, alpha, delta).select(F.col("stratum").alias("__s"), F.col("cutoffs").alias("__cutoffs"))
    drop_materialised(evidence)
    judged = measured.join(broadcast_if_small(found), F.col("stratum").eqNullSafe(F.col("__s")), "left")
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected("__cutoffs")).alias("kept"))
