"""Exact removal of repeated passages with longest-previous-factor arrays.

A passage is a string of `length` bytes. Two equal passages hold the same 32-byte string with the
smallest hash at the same place, their anchor, so passages are dealt out by their anchor:

1. each text is cut into segments, runs of passages with one anchor; only hashes of anchor and
   segment are shuffled (one pair for some 190 bytes of text);
2. a segment that is met twice repeats as a whole and needs no bytes;
3. of anchors with different segments one copy of each segment's bytes is gathered, and in each
   group the suffix order gives, by previous and next smaller positions, the longest previous
   factor of every position; passages with a factor of `length` or more are repeats. A group with
   very many segments is first dealt again by what all passages of a narrow band have in common;
4. the marks go back to their texts.

Segments are told apart by 128 bits of hash (64 of the anchor, 64 of the segment).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialised, map_texts, materialise, mix, rotl, texts_of, words8

ANCHOR = 32
#: Bits of a position within a chunk; the other 40 bits of a word hold the hash.
_POSITION = 24
#: Anchors with more distinct segments than this are dealt again, by bands of so many passages.
CROWD, BANDS = 600, (48, 6, 1)
#: Bytes of text for which anchors are found at a time, and bytes of segments whose suffixes are sorted at a time.
CHUNK, SORTED = 1 << 20, 3 << 17
#: Passages whose anchors are found at once, so that a very long text takes no more memory than a chunk; within _POSITION bits.
STEP = 1 << 20


# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each of the first n positions of a padded chunk."""
    with np.errstate(over="ignore"):
        x = words8(data)[: n + 24].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x = x[: n + 16] + rotl(x[8 : n + 24], 23) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x = x[:n] + rotl(x[16 : n + 16], 41) * np.uint64(0x165667B19E3779F9)
        return mix(x)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i + w] for each i; the end is padded with the largest value."""
    n = len(x)
    padded = np.full(-(-n // w) * w + w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, anchor, key, seg): runs of passage starts with one anchor, positions within the chunk."""
    total = int(offsets[-1])
    sizes = np.diff(offsets)
    fit = np.flatnonzero(sizes >= length)
    if not len(fit):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    step = min(STEP, (1 << _POSITION) - 2 * length)
    out_first, out_last, out_anchor, out_key = [], [], [], []
    for base in range(0, total, step):  # more than one step only for a very long text
        span = min(total, base + step + length - 1) - base
        part = np.zeros(span + 64, np.uint8)
        part[:span] = data[base : base + span]
        h = gram_hashes(part, span)
        word = (h >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(span, dtype=np.uint64)
        anchor = (sliding_min(word, length - ANCHOR + 1) & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        valid = np.zeros(span, bool)
        begin = np.zeros(span, bool)
        for i in fit[(offsets[fit + 1] > base) & (offsets[fit] < base + span)]:
            a, b = max(0, offsets[i] - base), offsets[i + 1] - length + 1 - base
            b = min(b, step, span)
            if b > a:
                valid[a:b] = True
                begin[a] = True
        begin[1:] |= anchor[1:] != anchor[:-1]
        begin &= valid
        first = np.flatnonzero(begin)
        end = valid.copy()
        end[:-1] &= begin[1:] | ~valid[1:]
        out_first.append(first + base)
        out_last.append(np.flatnonzero(end) + base)
        out_anchor.append(anchor[first] + base)
        out_key.append(h[anchor[first]])
    first, last, anchor, key = (np.concatenate(x) for x in (out_first, out_last, out_anchor, out_key))
    view = memoryview(data)
    digest = xxhash.xxh3_64_intdigest
    seg = np.fromiter((digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    return np.searchsorted(offsets, first, "right") - 1, first, last, anchor, key, seg


# ---------------------------------------------------------------- longest previous factors


def suffix_ranks(data: np.ndarray, n: int, length: int) -> list[tuple[int, np.ndarray]]:
    """(m, rank of the m bytes from each position) for m = 8, 16, ... and length, by prefix doubling."""
    word = words8(data)[:n].astype(np.uint64).byteswap()
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    levels, m = [(8, rank.astype(np.int32))], 8
    while m < length:
        step = min(m, length - m)
        pair = rank << 32
        pair[: n - step] |= rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        m += step
        levels.append((m, rank.astype(np.int32)))
    return levels


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of the strings at a and b in steps of 8 bytes, at most `length`; b < 0 gives 0."""
    out = np.where((b >= 0) & (levels[-1][1][a] == levels[-1][1][np.maximum(b, 0)]), length, 0)
    x, y = a.copy(), np.maximum(b, 0)
    on = (b >= 0) & (out == 0)
    for m, rank in reversed(levels[:-1]):
        inside = on & (np.maximum(x, y) < len(rank))
        same = np.zeros(len(a), bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        out[same] += m
        x[same] += m
        y[same] += m
    return np.minimum(out, length)


def smaller_before(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry of the same group with a smaller value, else -1; all entries jump together."""
    n = len(value)
    at = np.arange(n) - 1
    at[np.flatnonzero(group[np.maximum(at, 0)] != group)] = -1
    open_ = np.flatnonzero((at >= 0) & (value[np.maximum(at, 0)] > value))
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
        open_ = open_[value[at[open_]] > value[open_]]
    return at


def previous_factors(data: np.ndarray, n: int, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending within its group) the longest factor that also begins at an earlier start of the
    group, and at a later one; in steps of 8 bytes and up to `length`, whose value is exact."""
    levels = suffix_ranks(data, n, length)
    order = np.lexsort((starts, levels[-1][1][starts], group))
    at, own = starts[order], group[order]

    def longest(value):
        before = smaller_before(value, own)
        after = smaller_before(value[::-1], own[::-1])[::-1]
        after = np.where(after >= 0, len(value) - 1 - after, -1)
        best = np.zeros(len(value), np.int64)
        for x in (before, after):
            best = np.maximum(best, common_prefix(levels, at, np.where(x >= 0, at[np.maximum(x, 0)], -1), length))
        out = np.empty(len(value), np.int64)
        out[order] = best
        return out

    return longest(at), longest(-at)


def repeated_passages(groups: list[list[bytes]], length: int, keep_first: bool) -> list[list[np.ndarray]]:
    """For each group of segments, in order, which passages of each segment repeat (or, keeping the first, were met before)."""
    bodies = [x for g in groups for x in g]
    sizes = np.array([len(x) for x in bodies], np.int64)
    n = int(sizes.sum())
    data = np.zeros(n + 64, np.uint8)
    data[:n] = np.frombuffer(b"".join(bodies), np.uint8)
    at = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    cuts = np.concatenate(([0], np.cumsum(count)))
    starts = np.arange(cuts[-1]) + np.repeat(at - cuts[:-1], count)
    owner = np.repeat(np.repeat(np.arange(len(groups)), [len(g) for g in groups]), count)
    earlier, later = previous_factors(data, n, starts, owner, length)
    hit = earlier >= length if keep_first else (earlier >= length) | (later >= length)
    parts = iter(np.split(hit, cuts[1:-1]))
    return [[next(parts) for _ in g] for g in groups]


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


# ---------------------------------------------------------------- texts


def cover(spans: list[tuple[int, int]] | np.ndarray, text: memoryview, whole_characters: bool) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by the spans; with whole_characters runs shrink to character borders."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    if whole_characters:
        n, tight = len(text), []
        for a, b in out:
            while a < n and text[a] & 0xC0 == 0x80:
                a += 1
            while b < n and b > a and text[b] & 0xC0 == 0x80:
                b -= 1
            if b > a:
                tight.append((a, b))
        out = tight
    return out


def without(text: memoryview, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts)


def text_hash(text_col: str):
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def find_repeats(df: DataFrame, columns: list[str], order_col: str, text_col: str = "text", length: int = 400, keep_first: bool = False, want_text: bool = False, whole_characters: bool = False) -> DataFrame:
    """columns + (n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of df.

    Without keep_first every byte is removed that is covered by a passage that also starts anywhere else.
    With keep_first passages stay where they are met first, in the order of order_col, then of a hash of the text,
    then of position; of equal texts the row with the smallest order_col stays.
    Null texts count as empty; texts shorter than `length` stay whole; repeated rows count as separate texts;
    an empty table gives no rows. Columns not named are neither read nor kept, whatever their names. kept is what remains as text:
    with whole_characters cuts are moved to character borders (a character cut by a border stays), else what is left of
    a character that a cut goes through becomes U+FFFD there; kept_sha256 is always of the bytes.
    """
    types = dict(df.dtypes)
    order_type = types[order_col]
    base = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{order_col}`").alias("__order"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), text_hash(f"`{text_col}`").alias("__hash"))

    def cut(rows, texts):
        text, _, _, _, key, seg = segments(texts.data, texts.offsets, length)
        if not len(text):
            return None
        order = np.lexsort((seg, key, text))
        t, k, s = text[order], key[order], seg[order]
        new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1]))))
        n = np.diff(np.append(new, len(t)))
        own = pa.array(t[new])
        return rows.column(0).take(own), rows.column(1).take(own), k[new].view(np.int64), s[new].view(np.int64), n

    found = materialise(map_texts(base, ["__order", "__hash"], "__text", cut, f"o {order_type}, h binary, k bigint, s bigint, n bigint", CHUNK), "segments")
    each = materialise(found.groupBy("k", "s").agg(F.sum("n").alias("n"), F.min(F.struct("o", "h")).alias("rep")), "distinct")
    crowds = each.groupBy("k").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1")
    # bytes are needed of all segments of an anchor that has several, unless every one of them is a repeat already
    crowds = crowds.select("k") if keep_first else crowds.where("least = 1").select("k")
    flagged = each.where("n > 1").select("k", "s", "n", "rep", F.lit(False).alias("need")).unionByName(each.join(crowds, "k").select("k", "s", "n", "rep", F.lit(True).alias("need")))
    flagged = flagged.groupBy("k", "s").agg(F.first("n").alias("n"), F.first("rep").alias("rep"), F.max("need").alias("need"))
    known = found.drop("n").join(flagged, ["k", "s"]).select("h", "o", F.struct("k", "s", (F.col("n") > 1).alias("full"), F.col("rep.h").alias("rep_h"), "need").alias("x"))
    known = known.select("h", "o", F.struct("x.k", "x.s", ((F.col("x.full").cast("int")) + 2 * (F.col("x.rep_h") == F.col("h")).cast("int") + 4 * F.col("x.need").cast("int")).alias("f")).alias("x"))
    known = known.groupBy("h").agg(F.min("o").alias("__first"), F.array_sort(F.collect_set("x")).alias("__known"))
    joined = base.join(known.withColumnRenamed("h", "__hash"), "__hash", "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], "__hash", F.col("__order").eqNullSafe(F.col("__first")).alias("__is_first"), "__known.k", "__known.s", "__known.f", "__text", F.col("__first").alias("o"))
    n_columns = len(columns)
    passed = ", ".join(f"`{c}` {types[c]}" for c in columns)
    digest = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if want_text else "")

    def result(text: memoryview, spans) -> tuple:
        runs = cover(spans, text, whole_characters)
        kept = without(text, runs)
        return (len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), *((kept.decode("utf-8", "replace"),) if want_text else ()))

    out_names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if want_text else [])]
    out_types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if want_text else [])]
    piece = pa.struct([("k", pa.int64()), ("s", pa.int64()), ("at", pa.int64()), ("rel", pa.int32()), ("full", pa.bool_()), ("body", pa.binary())])

    def mark(batches):
        for batch in batches:
            for texts in texts_of(batch.column(n_columns + 5), CHUNK):
                rows = batch.slice(texts.first, texts.n)
                is_first = rows.column(n_columns + 1).to_pylist()
                known = [rows.column(n_columns + 2 + i) for i in range(3)]
                has = np.flatnonzero(known[0].is_valid().to_numpy(zero_copy_only=False))
                spans: list[list] = [[] for _ in range(texts.n)]
                todo: list[list] = [[] for _ in range(texts.n)]
                if len(has):
                    text, first, last, anchor, key, seg = segments(texts.data, texts.offsets, length)
                    cuts = np.searchsorted(text, np.arange(texts.n + 1))
                for i in has:
                    base_at = int(texts.offsets[i])
                    if keep_first and not is_first[i]:
                        spans[i].append((0, int(texts.offsets[i + 1]) - base_at))
                        continue
                    flags = dict(zip(zip(known[0][i].as_py(), known[1][i].as_py(), strict=True), known[2][i].as_py(), strict=True))
                    seen = set()
                    here = slice(cuts[i], cuts[i + 1])
                    for a, b, c, k, s in zip(first[here].tolist(), last[here].tolist(), anchor[here].tolist(), key[here].view(np.int64).tolist(), seg[here].view(np.int64).tolist(), strict=True):
                        flag = flags.get((k, s))
                        if flag is None:
                            continue
                        again = (k, s) in seen
                        seen.add((k, s))
                        repeat = bool(flag & 1) and not (keep_first and flag & 2 and not again)
                        if repeat:
                            spans[i].append((a - base_at, b + length - base_at))
                        if flag & 4 and flag & 2 and not again:
                            todo[i].append({"k": k, "s": s, "at": a - base_at, "rel": c - a, "full": bool(flag & 1), "body": bytes(texts.data[a : b + length])})
                done, raw = [], []
                for i in range(texts.n):
                    raw.append(np.array(spans[i], np.int64).tobytes())
                    done.append(result(texts.bytes_of(i), spans[i]) if not todo[i] else (None,) * len(out_names))
                wait = pa.array([bool(x) for x in todo])
                keep_text = pa.array([bytes(texts.bytes_of(i)).decode("utf-8", "replace") if todo[i] else None for i in range(texts.n)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in range(n_columns + 1)), *(pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), out_types, strict=True)), wait, keep_text, pa.array(raw, pa.binary()), pa.array(todo, pa.list_(piece)), rows.column(n_columns + 6)],
                    [*columns, "h", *out_names, "wait", "text", "spans", "todo", "o"],
                )

    schema = f"{passed}, h binary, {digest}, wait boolean, text string, spans binary, todo array<struct<k bigint, s bigint, at bigint, rel int, full boolean, body binary>>, o {order_type}"
    marked = materialise(joined.mapInArrow(mark, schema), "marked")
    drop_materialised(found)
    drop_materialised(each)
    done = marked.where(~F.col("wait")).select(*[F.col(f"`{c}`") for c in columns], *out_names)
    bodies = marked.where("wait").select("h", "o", F.explode("todo").alias("x")).select("h", "o", "x.*")
    bodies = materialise(bodies.dropDuplicates(["k", "s"]), "bodies")  # equal texts wait with the same bodies
    hits = resolve(bodies, length, keep_first)
    hits = hits.groupBy("h").agg(F.collect_list(F.struct("a", "b")).alias("more"))
    left = marked.where("wait").select(*[F.col(f"`{c}`") for c in columns], "h", "text", "spans").join(hits, "h", "left")

    def finish(batches):
        for batch in batches:
            out = []
            spans, more = batch.column(n_columns + 1), batch.column(n_columns + 2)
            for texts in texts_of(batch.column(n_columns), CHUNK):
                for i in range(texts.n):
                    own = np.frombuffer(spans[texts.first + i].as_py(), np.int64).reshape(-1, 2).tolist()
                    own += [(x["a"], x["b"] + length) for x in more[texts.first + i].as_py() or ()]
                    out.append(result(texts.bytes_of(i), own))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n_columns)), *(pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), out_types, strict=True))], [*columns, *out_names])

    late = left.select(*[F.col(f"`{c}`") for c in columns], "text", "spans", "more").mapInArrow(finish, f"{passed}, {digest}")
    return done.unionByName(late)


def resolve(bodies: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(h, a, b): first and last start of runs of repeated passages, for each text hash, among segments of one anchor.

    bodies: (k, s, h, o, at, rel, body, full), one row for each anchor and distinct segment.
    """
    found = None
    now = bodies.select("k", "s", "h", "o", "at", "rel", "body", "full")
    for band in (*BANDS, None):
        many = now.groupBy("k").agg(F.count("*").alias("m"))
        crowded = F.broadcast(many.where(F.col("m") > CROWD).select("k"))
        last = band is None or crowded.limit(1).count() == 0
        # crowded anchors are left out, and cut, where their segments lie, so that these never meet in one task; at most one key for CROWD segments is broadcast
        calm = (now if last else now.join(crowded, "k", "left_anti")).join(many.where("m > 1"), "k")
        part = _sorted_groups(calm, length, keep_first)
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        hot = materialise(now.join(crowded, "k").mapInArrow(_banded(band, length), "k bigint, s bigint, " + ", ".join(f"{c} {t}" for c, t in now.dtypes if c in ("h", "o", "at", "rel", "body", "full"))), "bands")
        distinct = hot.groupBy("k", "s").agg(F.min(F.struct("o", "h", "at")).alias("rep"), F.count("*").alias("n"), F.max("full").alias("full"))
        same = hot.join(distinct.where("n > 1").select("k", "s", "rep"), ["k", "s"])
        if keep_first:
            same = same.where(~F.struct("o", "h", "at").eqNullSafe(F.col("rep")))
        found = found.unionByName(same.select("h", F.col("at").alias("a"), (F.col("at") + F.octet_length("body") - length).cast("bigint").alias("b")))
        firsts = hot.join(distinct.select("k", "s", "rep", "n", F.col("full").alias("any_full")), ["k", "s"]).where(F.struct("o", "h", "at").eqNullSafe(F.col("rep")))
        now = materialise(firsts.select("k", "s", "h", "o", "at", "rel", "body", ((F.col("n") > 1) | F.col("any_full")).alias("full")), "banded")


def _banded(band: int, length: int):
    """Cuts segments into bands of passages; the new key is the hash of the bytes that all passages of the band share."""

    def run(batches):
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            out: list[list] = [[] for _ in range(8)]
            for r in batch.to_pylist():
                body, rel = r["body"], r["rel"]
                first, last = -rel, len(body) - length - rel  # starts relative to the anchor
                for number in range(first // band, last // band + 1):
                    a, b = max(first, number * band), min(last, number * band + band - 1)
                    # every passage of the band covers these bytes, and a segment with one of them holds them
                    shared = body[number * band + band - 1 + rel : number * band + length + rel]
                    sub = body[a + rel : b + length + rel]
                    key = xxhash.xxh3_64_intdigest(shared, (r["k"] + number * 0x9E3779B97F4A7C15) & (2**64 - 1))
                    for column, x in zip(out, (key, xxhash.xxh3_64_intdigest(sub, (a - number * band) & (2**64 - 1)), r["h"], r["o"], r["at"] + a - first, -a, sub, r["full"]), strict=True):
                        column.append(x)
            fields = batch.schema
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(np.array(out[1], np.uint64).view(np.int64)), *(pa.array(x, fields.field(c).type) for x, c in zip(out[2:], ("h", "o", "at", "rel", "body", "full"), strict=True))],
                ["k", "s", "h", "o", "at", "rel", "body", "full"],
            )

    return run


def _sorted_groups(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Repeated passages within each key, several small keys at a time."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("k", "o", "h", "at", "body", "full").repartition(n, "k").sortWithinPartitions("k", "o", "h", "at")

    def run(batches):
        held: list[tuple[int, bytes, int, bytes, bool]] = []
        size = 0

        def out():
            groups: list[list] = []
            for i, row in enumerate(held):
                if i and row[0] == held[i - 1][0]:
                    groups[-1].append(row)
                else:
                    groups.append([row])
            h, a, b = [], [], []
            for rows_of, hits in zip(groups, repeated_passages([[r[3] for r in g] for g in groups], length, keep_first), strict=True):
                for (_, text, at, _, full), hit in zip(rows_of, hits, strict=True):
                    if full and not keep_first:
                        continue  # it repeats as a whole, which is known
                    for x, y in zip(*runs_of(hit), strict=True):
                        h.append(text)
                        a.append(at + int(x))
                        b.append(at + int(y))
            return pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["h", "a", "b"])

        for batch in batches:
            for k, h, at, body, full in zip(*(batch.column(c).to_pylist() for c in ("k", "h", "at", "body", "full")), strict=True):
                if size > SORTED and held[-1][0] != k:
                    yield out()
                    held, size = [], 0
                held.append((k, h, at, body, full))
                size += len(body)
        if held:
            yield out()

    return rows.mapInArrow(run, "h binary, a bigint, b bigint")
