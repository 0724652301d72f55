"""SimHash near-duplicate detection with pivot distance tables.

1. One pass over the texts gives each document a 64-bit fingerprint (no shuffle of texts).
2. Equal fingerprints collapse to one node, so exact copies never meet as pairs.
3. Nodes are dealt by the agreement of two of six bit blocks: two fingerprints that differ
   in at most four bits agree in at least two blocks, so every link is met somewhere.
   (Distances to random pivots concentrate around 32, so they cannot deal out the work.)
4. In each bucket a pivot distance table holds every node's Hamming distance to many reference
   fingerprints. By the triangle inequality linked nodes differ by at most four in each column:
   nodes are swept in order of one column, pairs with a larger maximum coordinate difference
   are discarded, and survivors are verified by their exact distance.
5. Each task keeps a spanning forest of its links only; components are then found by
   alternating large-star and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, PAD, Texts, drop_materialised, map_texts, materialise, mix, segment_sums, xxh64

#: Widths of the six bit blocks of a fingerprint.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Columns of the pivot distance table.
PIVOTS = 24
#: Buckets up to this size are swept pair by pair; larger ones are searched breadth first.
SWEEP = 256
#: Rows of a bucket that one task holds; of larger ones it holds any two chunks of that size at a time.
CROWD = 50_000
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(texts: Texts, words_per_shingle: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all word shingles, and how many there are before each text."""
    starts, ends, first = texts.words()
    n_words = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts.n + 1, np.int64)
    data = texts.data[: texts.size]
    space = IS_SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first separator after a word stays, as one space
    flat = np.zeros(int(keep.sum()) + PAD, np.uint8)
    flat[:-PAD] = np.where(space, np.uint8(0x20), LOWER[data])[keep]
    place = np.cumsum(keep) - 1
    starts, ends = place[starts], place[ends - 1] + 1
    n_shingles = np.where(n_words == 0, 0, np.maximum(1, n_words - words_per_shingle + 1))
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    begin = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], n_shingles)
    last = np.minimum(begin + words_per_shingle - 1, np.repeat(first[1:] - 1, n_shingles))
    return xxh64(flat, starts[begin], ends[last] - starts[begin]), bounds


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bit k of each result is 1 if set in over half the text's hashes; no hashes give 0."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)  # eight one-byte counters share a word, so at most 255 are added at once
    owner = np.repeat(np.arange(len(full)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = bounds[full][owner] + 255 * piece
    owner_cuts = np.cumsum(pieces) - pieces
    for byte in range(8):
        lanes = _LANES[(hashes >> np.uint64(8 * byte)).astype(np.uint8)]
        counts = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, owner_cuts, axis=0)
        bits = (2 * counts > n[full][:, None]).astype(np.uint64) << np.arange(8 * byte, 8 * byte + 8, dtype=np.uint64)
        out[full] |= bits.sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each row's whole text; null or blank texts have 0."""
    id_type = dict(df.dtypes)[id_col]

    def run(rows, texts):
        return rows.column(0), majority_bits(*shingle_hashes(texts, words_per_shingle)).view(np.int64)

    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {id_type}, fp bigint")


def bucket_keys(fp: Column) -> Column:
    """Fifteen keys: a pair of blocks and their content."""
    at = np.cumsum((0, *BLOCKS[:-1]))
    part = [F.shiftrightunsigned(fp, int(s)).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")) for s, w in zip(at, BLOCKS, strict=True)]
    keys = [F.shiftleft(F.lit(k).cast("bigint"), 40).bitwiseOR(F.shiftleft(part[a], 11)).bitwiseOR(part[b]) for k, (a, b) in enumerate(combinations(range(6), 2))]
    return F.array(*keys)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of paired fingerprints, each a row of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.stack([hamming(fp, p) for p in pivots], axis=1)


def reference_fingerprints(n: int = PIVOTS, words: int = 1) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, (n, words), dtype=np.uint64)


def linked_pairs(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join exactly what the links between rows of one key join; rows must be sorted by key.

    fp: a row of 64-bit words for each fingerprint.
    """
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(cuts, len(key)))
    small = np.repeat((sizes > 1) & (sizes <= SWEEP), sizes)
    at = np.flatnonzero(small)
    if len(at):
        column = pivot_table(fp[at], pivots[:1])[:, 0]
        order = np.lexsort((column, key[at]))
        at, column = at[order], column[order]
        k, f = key[at], fp[at]
        table = pivot_table(f, pivots)
        alive, lag = np.arange(len(at) - 1), 1
        while len(alive):
            alive = alive[alive + lag < len(at)]
            near = (k[alive + lag] == k[alive]) & (column[alive + lag] - column[alive] <= max_bits)
            alive = alive[near]
            a, b = alive, alive + lag
            for p in range(1, table.shape[1]):
                if not len(a):
                    break
                ok = np.abs(table[a, p] - table[b, p]) <= max_bits
                a, b = a[ok], b[ok]
            ok = hamming(f[a], f[b]) <= max_bits
            left.append(at[a[ok]])
            right.append(at[b[ok]])
            lag += 1
    for g in np.flatnonzero(sizes > SWEEP):
        open_ = np.arange(cuts[g], cuts[g] + sizes[g])
        table = pivot_table(fp[open_], pivots)
        while len(open_):  # each round empties one component of the bucket
            todo, open_, table = [(open_[0], table[0])], open_[1:], table[1:]
            while todo and len(open_):
                x, row = todo.pop()
                ok = np.arange(len(open_))
                for p in range(0, len(pivots), 4):
                    ok = ok[(np.abs(table[ok, p : p + 4] - row[p : p + 4]) <= max_bits).all(axis=1)]
                ok = ok[hamming(fp[open_[ok]], fp[x]) <= max_bits]
                if len(ok):
                    left.append(np.full(len(ok), x))
                    right.append(open_[ok])
                    todo += list(zip(open_[ok], table[ok], strict=True))
                    rest = np.ones(len(open_), bool)
                    rest[ok] = False
                    open_, table = open_[rest], table[rest]
    return np.concatenate(left), np.concatenate(right)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these links but the smallest of its component, with that smallest."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def nearest_forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a forest of smallest distances that joins what all of them join."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    weight = distance.astype(np.int64) * len(a) + np.arange(len(a))
    root, live, chosen = np.arange(len(nodes)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(live := live[root[x[live]] != root[y[live]]]):
        best = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(best, root[x[live]], weight[live])
        np.minimum.at(best, root[y[live]], weight[live])
        pick = np.unique(best[best < np.iinfo(np.int64).max]) % len(a)
        chosen.append(pick)
        while (root[x[pick]] != root[y[pick]]).any():
            low = np.minimum(root[x[pick]], root[y[pick]])
            np.minimum.at(root, root[x[pick]], low)
            np.minimum.at(root, root[y[pick]], low)
            while (root != root[root]).any():
                root = root[root]
    return np.concatenate(chosen)


def nearest_links(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within max_bits bits of one key that make a forest of smallest distances; rows must be sorted by key.

    Buckets over SWEEP are searched with a radius that grows, so that near pairs are met before far ones.
    """
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(cuts, len(key)))
    large = np.repeat(sizes > SWEEP, sizes)
    left, right = [], []
    for some, radii in ((np.flatnonzero(~large), [max_bits]), (np.flatnonzero(large), range(max_bits % 10, max_bits + 1, 10))):
        for radius in radii if len(some) else ():
            a, b = linked_pairs(key[some], fp[some], pivots, radius)
            left.append(some[a])
            right.append(some[b])
    a, b = np.concatenate(left), np.concatenate(right)
    forest = nearest_forest(a, b, hamming(fp[a], fp[b]))
    return a[forest], b[forest]


def links(nodes: DataFrame, max_bits: int = 4, pivots: int = PIVOTS, crowd: int = CROWD) -> DataFrame:
    """(u, v), u > v: links that join exactly the components of all fingerprints within max_bits <= 4 bits."""
    if max_bits > 4:
        raise ValueError("two of six blocks are sure to agree only up to four differing bits")
    dealt = nodes.select(F.explode(bucket_keys(F.col("fp"))).alias("key"), F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    return _links(dealt, ">u8", reference_fingerprints(pivots), max_bits, crowd=crowd)


def _links(dealt: DataFrame, words: str, pivots: np.ndarray, max_bits: int, real: bool = False, crowd: int = CROWD) -> DataFrame:
    """(u, v), u > v, of rows (key, node, fp binary, of words in that byte order): each task searches its buckets, a few whole ones at a time.

    With `real` each row is a pair within max_bits bits, and near pairs go before far ones; else it names a node and its bucket's root.
    A task holds no bucket of more than `crowd` rows: it hands such a bucket on in chunks, and any two chunks of it meet in a task of their own.
    """
    found = materialise(_search(dealt, words, pivots, max_bits, real, crowd).distinct(), "links")
    chunks = found.where("key IS NOT NULL").groupBy("key").agg((F.max("chunk") + 1).alias("chunks"))
    near = found.where("key IS NULL").select("u", "v")
    if not chunks.limit(1).count():
        return near
    other = F.explode(F.expr("filter(sequence(0, chunks - 1), x -> x <> chunk)")).alias("other")
    cells = found.join(chunks, "key").select("key", "chunk", F.col("u").alias("node"), "fp", other)
    cells = cells.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "node", "fp")
    return near.unionByName(_search(cells, words, pivots, max_bits, real, None).select("u", "v"))


def _search(dealt: DataFrame, words: str, pivots: np.ndarray, max_bits: int, real: bool, crowd: int | None) -> DataFrame:
    """(u, v, key, chunk, fp): links (u, v), or the rows (key, u, fp) of buckets of more than `crowd` rows, in chunks of that many."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("key", "node", "fp").repartition(n, "key").sortWithinPartitions("key", "node")  # by node too, so that a task that runs again numbers chunks alike
    width = pivots.shape[1]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("fp", pa.binary())])

    def search(held):
        key, node = held.column(0).to_numpy(), held.column(1).to_numpy()
        fp = np.frombuffer(b"".join(held.column(2).to_pylist()), words).astype(np.uint64).reshape(-1, width)
        if real:
            a, b = nearest_links(key, fp, pivots, max_bits)
            u, v = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
        else:
            a, b = linked_pairs(key, fp, pivots, max_bits)
            u, v = spanning_forest(node[a], node[b])
        return [pa.array(u, pa.int64()), pa.array(v, pa.int64()), *(pa.nulls(len(u), t) for t in schema.types[2:])]

    def hand_on(held, passed):
        chunk = (passed + np.arange(held.num_rows)) // crowd
        return [held.column(1), pa.nulls(held.num_rows, pa.int64()), held.column(0), pa.array(chunk.astype(np.int32)), held.column(2).cast(pa.binary())]

    def run(batches):
        held, crowded, passed = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if crowded is not None:  # the rest of a bucket that is handed on
                to = int(np.searchsorted(batch.column(0).to_numpy(), crowded, "right"))
                if to:
                    yield pa.RecordBatch.from_arrays(hand_on(batch.slice(0, to), passed), schema=schema)
                    passed, batch = passed + to, batch.slice(to)
                if not batch.num_rows:
                    continue
                crowded = None
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = held.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            full = crowd is not None and held.num_rows - cut > crowd
            if cut and (full or held.num_rows >= 100_000):
                yield pa.RecordBatch.from_arrays(search(held.slice(0, cut)), schema=schema)
                held = held.slice(cut)
            if full:
                yield pa.RecordBatch.from_arrays(hand_on(held, 0), schema=schema)
                held, crowded, passed = None, key[-1], held.num_rows
        if held is not None:
            yield pa.RecordBatch.from_arrays(search(held), schema=schema)

    return dealt.mapInArrow(run, "u bigint, v bigint, key bigint, chunk int, fp binary")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(u, v): each node of the links but the smallest of its component, with that smallest (star contraction)."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop_materialised(before)
    raise RuntimeError("components did not settle")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row.

    component_id is the smallest id reachable through links of at most max_bits bits, itself included.
    Null and blank texts have fingerprint 0 and link like any other; repeated rows stay, each with
    its row; a null id never names a component unless no other id is in it; an empty table gives no rows.
    Columns other than the two named are neither read nor kept.
    """
    prints = materialise(fingerprints(df, id_col, text_col, words_per_shingle), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "nodes")
    between = links(nodes, max_bits)
    roots = components(between).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    drop_materialised(between)
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


# ---------------------------------------------------------------- similarity of 0.8 or more

#: Words of a wide fingerprint, the differing bits up to which bands are laid out, and those up to which shingle sets are
#: compared. Sets with a similarity of 0.8 differ in 15 % of the bits, 39 of 256 with a deviation of 6.
WIDE, WIDE_BITS, RADIUS = 4, 44, 60
#: Bits of a band and number of bands, the same at every size: pairs that differ in WIDE_BITS bits
#: agree in some band with a probability of 0.96. Buckets that get crowded are searched exactly.
BAND_BITS, BANDS = 16, 71


def wide_fingerprints(df: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(id, node, fp binary, n, shingles): a hash of the set of a text's shingles, four SimHashes of independent hashes of
    them (256 bits), how many they are, and 32 bits of each."""
    id_type = dict(df.dtypes)[id_col]

    def run(rows, texts):
        h, bounds = shingle_hashes(texts, words_per_shingle)
        owner = np.repeat(np.arange(texts.n), np.diff(bounds))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, n = h[new], np.bincount(owner[new], minlength=texts.n)
        bounds = np.concatenate(([0], np.cumsum(n)))
        with np.errstate(over="ignore"):
            node = mix(segment_sums(mix(h ^ np.uint64(0x5851F42D4C957F2D)), bounds) + n.astype(np.uint64))
            words = [majority_bits(mix(h + np.uint64(k)) if k else h, bounds) for k in range(WIDE)]
        shingles = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.astype(np.uint32).view(np.int32)))
        return rows.column(0), node.view(np.int64), [x.tobytes() for x in np.stack(words, axis=1).astype("<u8")], n, shingles

    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {id_type}, node bigint, fp binary, n bigint, shingles array<int>")


def _wide_words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WIDE)


def wide_links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) between nodes (node bigint, fp binary) whose wide fingerprints differ in at most RADIUS bits and agree in a band.

    Of each bucket a forest of smallest distances is given, not all pairs.
    """
    rng = np.random.default_rng(256)
    chosen = [np.sort(rng.choice(64 * WIDE, BAND_BITS, replace=False)) for _ in range(BANDS)]

    def deal(batches):
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            flat = np.unpackbits(_wide_words(batch.column(1)).copy().view(np.uint8).reshape(-1, 8 * WIDE), axis=1)
            for k, own in enumerate(chosen):
                key = (np.int64(k) << 40) | (flat[:, own].astype(np.int64) << np.arange(BAND_BITS)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1)], ["key", "node", "fp"])

    dealt = nodes.select("node", "fp").mapInArrow(deal, "key bigint, node bigint, fp binary")
    return _links(dealt, "<u8", reference_fingerprints(2, WIDE), RADIUS, real=True, crowd=crowd)


def alike(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (u, v) between sets (node, n, shingles) with a similarity of 0.8 or more: common / all >= 4 / 5."""
    one, two = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "uv")
    both = edges.join(two.hint("merge"), "v").join(one.hint("merge"), "u")
    return both.where(9 * F.size(F.array_intersect("s_u", "s_v")) >= 4 * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """(id, component_id): components of documents whose sets of shingles have a similarity of 0.8 or more.

    Candidates are pairs of near wide fingerprints, and each is compared by its sets before it links (by 32 bits of each shingle).
    The same rules for nulls, repeated rows and empty tables as simhash_components. Nodes are distinct sets of shingles, named by 64 bits.
    """
    prints = materialise(wide_fingerprints(df, id_col, text_col, words_per_shingle), "wide")
    nodes = materialise(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min(id_col).alias("low")), "widenodes")
    near = wide_links(nodes)
    edges = materialise(near.distinct(), "candidates")
    drop_materialised(near)
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # copies of a set collapse before the shuffle, so none is met more than once a task
    sets = materialise(prints.select("node", "n", "shingles").dropDuplicates(["node"]).join(ends, "node", "left_semi"), "sets")
    named = materialise(prints.select(id_col, "node"), "named")
    drop_materialised(prints)
    roots = components(alike(edges, sets)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    drop_materialised(edges)
    drop_materialised(sets)
    rooted = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(rooted.select("node", "root").join(names, "root").select("node", "component_id"), "node").select(id_col, "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=None, **options) -> DataFrame:
    """One row of df for each component, with all its columns: one with the smallest id there, or without id where no row has one.

    Rows are told apart by id and text (its MD5), so an id that repeats, or is missing, in several components stays in each.
    """
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("text"))
    df = df.withColumn("__row", row)
    found = materialise((find or simhash_components)(df, "__row", text_col, **options), "components")
    kept = found.where(F.col("__row").eqNullSafe(F.col("component_id"))).select(F.col("__row").alias("__kept"))
    # a shuffle at every size: what is kept grows with the table, so it is never broadcast
    out = df.join(kept.hint("merge"), df["__row"].eqNullSafe(kept["__kept"]), "left_semi")
    repeated = kept.groupBy("__kept").count().where("count > 1").limit(1).count() > 0
    return (out.dropDuplicates(["__row"]) if repeated else out).drop("__row")
