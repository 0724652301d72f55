"""Best-fit packing of token sequences by linear grouping.

Lengths are at most `capacity`, so the whole table is described by a histogram of that many counts.
The driver plans on the histogram alone, in runs of equal bins, so the plan's size does not grow with
the number of documents:

1. large lengths, longest first, are cut into groups of equal cardinality and rounded up to the
   longest of their group;
2. with so few sizes, a linear programme over bin configurations (column generation with a knapsack)
   says how often each configuration is used, rounded down;
3. actual documents take the rounded places, longest first;
4. what is left, and then the small lengths, go to the fullest bin that still takes them.

Each piece then finds its place from its rank among the pieces of its length, with ranks counted
in buckets of bounded size, so no task holds all pieces of a frequent length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialise

CAPACITY = 1024
#: Plans tried: the groups of large lengths (the sizes of the linear programme), and up to which share of
#: the capacity a length is small. The plan with the fewest bins is taken; all are made from the histogram.
TRIES = ((40, 1 / 8), (40, 2 / 5), (40, 3 / 5), (40, 19 / 20))
#: Pieces of one length in a bucket, on average.
BUCKET = 20_000


# ---------------------------------------------------------------- planning


def best_knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable configuration: how many of each size (sorted, largest first) fit together."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int32)
    size = np.array(sizes)
    first = np.searchsorted(-size, -np.arange(capacity + 1), "left")  # the first size that fits each room
    for room in range(sizes[-1], capacity + 1):
        found = best[room - size[first[room] :]] + values[first[room] :]
        k = int(found.argmax())
        if found[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = found[k], first[room] + k
        else:
            best[room] = best[room - 1]
    counts, room = [0] * len(sizes), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 200) -> list[tuple[list[int], float]]:
    """(how many of each size, how often) of an optimal basis of the bin configuration programme."""
    m = len(sizes)
    basis = np.zeros((m, m))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    need = np.array(counts, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = inverse @ need
        value, column = best_knapsack(sizes, np.ones(m) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ np.array(column, float)
        ok = np.flatnonzero(step > 1e-9)
        leave = ok[np.argmin(np.maximum(use[ok], 0) / step[ok])]
        basis[:, leave] = column
    use = np.linalg.inv(basis) @ need
    return [(basis[:, j].astype(int).tolist(), float(use[j])) for j in range(m) if use[j] > 1e-9]


class Bins:
    """Runs of equal bins, found by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms = capacity, []
        self.by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)

    def add(self, content: tuple[tuple[int, int], ...], room: int, n: int) -> None:
        """n bins of this content: pairs of a length and how many of it."""
        if n:
            if not self.by_room[room]:
                insort(self.rooms, room)
            self.by_room[room].append((content, n))

    def best_fit(self, length: int, count: int) -> None:
        """Puts `count` pieces one by one into the fullest bin that takes them."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                content, n, room = (), -(-count // (self.capacity // length)), self.capacity
            else:
                room = self.rooms[at]
                content, n = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.rooms.pop(at)
            each = room // length
            full, rest = min(n, count // each), 0
            self.add((*content, (length, each)), room - each * length, full)
            count -= full * each
            if full < n and count:
                rest = min(count, each)
                self.add((*content, (length, rest)), room - rest * length, 1)
                count -= rest
            self.add(content, room, n - full - bool(rest))

    def runs(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        return [x for room in sorted(self.by_room) for x in self.by_room[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tries: tuple[tuple[int, float], ...] = TRIES) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The best of the tried plans. It uses up the histogram exactly."""
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    best, fewest = None, 0
    for groups, small in tries:
        runs = plan_with(histogram, capacity, groups, small)
        bins = sum(n for _, n in runs)
        if best is None or bins < fewest:
            best, fewest = runs, bins
        if fewest <= least:
            break
    return best or []


def plan_with(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Runs (content, bins): the content is pairs of a length and how many of it."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("lengths lie between 1 and the capacity")
    left = {s: n for s, n in histogram.items() if n}
    bins = Bins(capacity)
    bins.add(((capacity, 1),), 0, left.pop(capacity, 0))
    large = sorted((s for s in left if s > small * capacity), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        cap = -(-total // groups)
        members: list[list[list[int]]] = []  # for each group: [length, count] from the longest
        free = 0
        for s in large:
            n = left[s]
            while n:
                if not free:
                    members.append([])
                    free = cap
                take = min(n, free)
                members[-1].append([s, take])
                n, free = n - take, free - take
        merged: list[list[list[int]]] = []
        for g in members:  # groups with the same rounded length are one size
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        sizes = [g[0][0] for g in merged]
        chosen = configurations(sizes, [sum(n for _, n in g) for g in merged], capacity)
        for counts, often in sorted(chosen, key=lambda x: -x[1]):
            todo = int(often + 1e-9)
            while todo:
                content, run = [], todo
                for g, k in enumerate(counts):
                    taken = 0
                    for s, n in merged[g]:
                        if taken < k and n:
                            use = min(k - taken, n)
                            content.append((s, use))
                            run = min(run, n // use)
                            taken += use
                run = max(1, run)
                for g, k in enumerate(counts):
                    taken = 0
                    for pair in merged[g]:
                        if taken < k and pair[1]:
                            use = min(k - taken, pair[1])
                            pair[1] -= use * run
                            taken += use
                bins.add(tuple(content), capacity - sum(s * k for s, k in content), run)
                todo -= run
        for s in large:
            del left[s]
        for g in merged:
            for s, n in g:
                left[s] = left.get(s, 0) + n
    for s in sorted(left, reverse=True):
        bins.best_fit(s, left[s])
    return bins.runs()


def places(runs: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: (first rank, how many of it in a bin, first bin, offset) of the runs that hold it."""
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for content, n in runs:
        at = 0
        for s, k in content:
            found[s].append((used[s], k, base, at))
            used[s] += n * k
            at += s * k
        base += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in found.items()}


# ---------------------------------------------------------------- tables


def assign(pieces: DataFrame, length_col: str = "length", order_cols: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """pieces + (sequence_id, offset). `pieces` must be a written table, as it is read twice.

    Lengths lie between 1 and capacity. Rows that agree in order_cols and length may swap places; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = max(1, n // BUCKET)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order_cols), F.lit(buckets)).cast("int"))
    counts = materialise(dealt.groupBy(length_col, "__bucket").count(), "packcounts")
    before = Window.partitionBy(length_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(length_col, "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    histogram = {r[0]: r[1] for r in counts.groupBy(length_col).agg(F.sum("count")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    rank = F.row_number().over(Window.partitionBy(length_col, "__bucket").orderBy(*order_cols)) - 1
    ranked = dealt.withColumn("__rank", rank.cast("bigint")).join(bases, [length_col, "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__base")).drop("__base", "__bucket")
    columns = [c for c in pieces.columns]
    types = dict(pieces.dtypes)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("__length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                i = np.flatnonzero(length == s)
                first, each, base, at = table.value[int(s)]
                k = np.searchsorted(first, rank[i], "right") - 1
                inner = rank[i] - first[k]
                sequence[i] = base[k] + inner // each[k]
                offset[i] = at[k] + inner % each[k] * int(s)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(columns))), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", sequence_id bigint, offset bigint"
    return ranked.select(*[F.col(f"`{c}`") for c in columns], F.col(length_col).cast("bigint").alias("__length"), "__rank").mapInArrow(run, schema)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """Byte-level BPE with the vocabulary and the added tokens of a tokenizers file. One for each worker process.

    tiktoken's encoder runs the same merges over the same ids several times faster than the library
    that wrote the file; tests hold the two against each other. Like there, the string of an added token is that token.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    added = whole["added_tokens"]
    if whole["normalizer"] or any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("normalizers and added tokens that take in what is around them aren't supported")
    added = {x["content"]: x["id"] for x in added}
    # the file spells bytes as printable characters: the printable ones as they are, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(spelled[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in added and all(c in spelled for c in token)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces_of(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of each row's ids with end_id appended. Null texts count as empty."""
    id_type = dict(df.dtypes)[id_col]

    def run(rows, texts):
        encode = tokenizer(path)
        row, out = [], []
        for i in range(texts.n):
            ids = np.append(encode.encode_to_numpy(bytes(texts.bytes_of(i)).decode("utf-8", "replace"), allowed_special="all").astype("<u4"), np.uint32(end_id)).astype("<u4")
            for k, (start, n) in enumerate(cut(len(ids), capacity)):
                row.append(i)
                out.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
        return rows.column(0).take(pa.array(row)), *zip(*out, strict=True)

    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null and empty texts are the end id alone; repeated rows and null ids are packed like any other.
    Columns other than the two named are neither read nor kept.
    """
    pieces = materialise(pieces_of(df, path, id_col, text_col, end_id, capacity), "pieces")
    return assign(pieces, "length", (id_col, "piece", "start", "ids_crc32"), capacity)
