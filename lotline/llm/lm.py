"""Language-model scoring with a probabilistic suffix tree.

1. One pass turns runs of texts into blocks: the sorted hashes of a block's distinct words with their
   training counts, and its documents as indices into them. Blocks are written to the shared folder.
2. Counts of all words are added up in shards of the hash space and sent back to the blocks that hold
   the words, so no task and not the driver holds the vocabulary, which grows with the corpus. Words
   seen at least `min_count` times get a number, small for frequent words.
3. The tree is dealt out by subtrees: a block sends its distinct windows (context words from the last one
   back, then the word itself) to the shard of the last context word. There all contexts that end with
   this word meet, whatever their length, so one shuffle gives all their counts; the shard decides level
   by level which contexts are retained (those whose next-word distribution diverges enough from that of
   their longest retained proper suffix) and sends back counts and back-off factors of each window.
4. A context seen more than `hot` times is too much for one shard. Before step 3 its followers are dealt to
   several shards and added up (one row of sums a context and shard meets at the driver, at most 2 / hot of the
   tokens), and so are the words before it; its longer contexts then are subtrees of their own, or hot again.
5. The scores of a block's documents are added up.

A sequence seen at least `min_count` times in training is a context or a follower, whatever the size of the corpus.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop_materialised, lookup, map_texts, materialise, mix, unique_counts, xxh64

#: Times a word sequence must be seen in training to be a context or a follower, whatever the size of the corpus.
MIN_COUNT = 2
#: Longest context in words.
DEPTH = 4
#: A context is retained if count * KL divergence from its suffix (nats) is at least this.
DIVERGENCE = 3.0
#: Taken off each follower's count.
DISCOUNT = 0.5
#: Bytes of text in a block; windows that one shard handles. Each block sends a slice to each shard, so the slices grow with the square of the
#: text over the product of both: the larger they are, the later the work on slices outgrows the work on windows.
BLOCK, SHARD = 8 << 20, 2_400_000
#: Windows of one context above which its subtree is split, and windows of whole contexts that are worked on at a time.
HOT, CHUNK = 600_000, 250_000
#: Tokens whose documents one task adds up at the end.
SUMMED = 6_000_000
#: Answers of a shard to blocks in one batch.
ANSWERS = 256
#: Changes of scores travel as whole multiples of this.
GRAIN = 2.0**-34
#: The shards are asked in so many turns, which bounds the disk that questions take.
WAVES = 2
#: Hash of the end of a text, which counts as a token.
END = np.uint64(0x5BF0_3635_DEC0_DE01)

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Made once for each worker: making one takes longer than a small slice itself.
_SHRINK, _GROW = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: first bytes, second bytes, ...; whole numbers take no more bytes than the largest needs."""
    kind = 0 if x.dtype.kind == "f" else 1
    if kind:
        if x.dtype.kind == "i":
            kind = 2 if len(x) and x.min() < 0 else 1
            x = (x << 1 ^ x >> 63).view(np.uint64) if kind == 2 else x
        bits = int(x.max(initial=0)).bit_length()
        x = x.astype(np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64)
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return bytes((kind, x.itemsize)) + _SHRINK.compress(planes.tobytes())


def _unpack(x: bytes, dtype) -> np.ndarray:
    kind, size = x[:2]
    planes = np.frombuffer(_GROW.decompress(x[2:]), np.uint8).reshape(size, -1)
    out = np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{size}" if kind else f"<f{size}")
    if kind == 2:
        out = (out.astype(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(out & 1).astype(np.int64)
    return out.astype(dtype, copy=False)


def _join(parts: list[bytes], dtype) -> np.ndarray:
    return np.concatenate([_unpack(x, dtype) for x in parts]) if parts else np.zeros(0, dtype)


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and the bounds of each text's."""
    starts, ends, first = texts.words()
    h = xxh64(LOWER[texts.data], starts, ends - starts)
    bounds = first + np.arange(texts.n + 1)
    out = np.full(bounds[-1], END, np.uint64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    out[inner] = h
    return out, bounds


def blocks(df: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    """(block, words, counts, n_words, n_train, n_tokens, ids, held, sizes, tokens): see the module's text."""
    id_type = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col), F.coalesce(training, F.lit(False)).alias("__train"), F.col(text_col))

    def run(rows, texts):
        tokens, bounds = token_hashes(texts)
        train = np.array(rows.column(1).to_pylist(), bool)
        words, index = np.unique(tokens, return_inverse=True)
        counts = np.bincount(index[np.repeat(train, np.diff(bounds))], minlength=len(words))
        block = uuid.uuid4().bytes  # equal blocks stay apart; the name is fixed once the table is written
        one = lambda x, t: pa.array([x], t)
        return one(block, pa.binary()), one(_pack(words), pa.binary()), one(_pack(counts.astype(np.uint32)), pa.binary()), one(len(words), pa.int64()), one(int(counts.sum()), pa.int64()), one(len(tokens), pa.int64()), pa.array([rows.column(0).to_pylist()], pa.list_(rows.column(0).type)), one(np.packbits(~train).tobytes(), pa.binary()), one(np.diff(bounds).astype("<i8").tobytes(), pa.binary()), one(_pack(index.astype(np.uint32)), pa.binary())

    return map_texts(rows, [id_col, "__train"], text_col, run, f"block binary, words binary, counts binary, n_words bigint, n_train bigint, n_tokens bigint, ids array<{id_type}>, held binary, sizes binary, tokens binary", BLOCK)


# ---------------------------------------------------------------- words


def by_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the slices of sorted hashes that go to each of `parts` equal ranges of the hash space."""
    edges = [min((1 << 64) - 1, (i << 64) // parts) for i in range(parts)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def each_part(batches) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one part after the other, of batches sorted by part."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield held[0]["part"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["part"], held


def dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part")


def word_counts(table: DataFrame, parts: int, least: int) -> DataFrame:
    """(part, block, n, id, v): training counts and numbers of each block's words; v: distinct training words of the part, once."""

    def deal(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True):
                words, counts = _unpack(words, np.uint64), _unpack(counts, np.uint32)
                cuts = by_part(words, parts)
                some = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.binary()), pa.array([_pack(words[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()), pa.array([_pack(counts[cuts[p] : cuts[p + 1]]) for p in some], pa.binary())], ["part", "block", "words", "counts"])

    def count(batches):
        for part, rows in each_part(batches):
            words = [_unpack(r["words"], np.uint64) for r in rows]
            counts = [_unpack(r["counts"], np.uint32).astype(np.int64) for r in rows]
            keys, sums = unique_counts(np.concatenate(words), np.concatenate(counts))
            rank = np.empty(len(keys), np.int64)
            rank[np.lexsort((keys, -sums))] = np.arange(len(keys))  # frequent words get small numbers, which pack well
            number = np.where(sums >= least, rank * parts + part + 1, 0).astype(np.uint64)
            v = int((sums > 0).sum())
            for i, (row, w) in enumerate(zip(rows, words, strict=True)):
                at = np.searchsorted(keys, w)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row["block"]], pa.binary()), pa.array([_pack(sums[at])], pa.binary()), pa.array([_pack(number[at])], pa.binary()), pa.array([v if not i else 0], pa.int64())], ["part", "block", "n", "id", "v"])

    slices = table.select("block", "words", "counts").mapInArrow(deal, "part int, block binary, words binary, counts binary")
    return dealt(slices, parts).mapInArrow(count, "part int, block binary, n binary, id binary, v bigint")


# ---------------------------------------------------------------- what a block asks


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class Rows:
    """The distinct rows of some columns, grouped by part and first column, and the row of each token in `at`.

    Rows are in the order of a 64-bit key of part, first column and a hash of all, and of the columns where that is equal.
    """

    def __init__(self, at: np.ndarray, part: np.ndarray, parts: int, columns: list[np.ndarray]):
        wide = np.uint64((parts - 1).bit_length())
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for x in columns:
                h = (h ^ x) * _ODD
                h ^= h >> np.uint64(29)
            h = mix(h)
        # part in the top bits, 24 bits of the first column, and what is left of the hash
        key = h >> (wide + np.uint64(24)) | (columns[0] & np.uint64((1 << 24) - 1)) << (np.uint64(40) - wide)
        if wide:
            key |= part << (np.uint64(64) - wide)
        order = np.argsort(key)
        key, sorted_ = key[order], [x[order] for x in columns]
        new = runs(key, *sorted_)
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        if (clash := same & new).any():  # equal keys of different rows
            group = np.cumsum(~same) - 1
            bad = np.zeros(group[-1] + 1, bool)
            bad[group[clash]] = True
            here = bad[group]
            order[here] = order[here][np.lexsort((*(x[here] for x in sorted_[::-1]), key[here]))]
            new = runs(key, *(x[order] for x in columns))
        self.at, self.order, self.pick = at, order, order[new]
        self.row = np.empty(len(at), np.int64)
        self.row[order] = np.cumsum(new) - 1
        self.columns = [x[self.pick] for x in columns]
        self.parts, cuts = np.unique(part[self.pick], return_index=True)
        self.cuts = np.append(cuts, len(self.pick))

    def slices(self, x: np.ndarray) -> list[bytes]:
        return [_pack(x[a:b]) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Training tokens of each row."""
        return np.bincount(self.row[train[self.at]], minlength=len(self.pick)).astype(np.uint32)


class Block:
    """The tokens of a block: their words, log10 probabilities so far, and the context that is looked at next (level 0: none)."""

    def __init__(self, batch, i: int, scale: float):
        get = lambda name: batch.column(name)[i].as_py()
        self.sizes, index = np.frombuffer(get("sizes"), "<i8"), _unpack(get("tokens"), np.uint32)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        c = _join([x["n"] for x in get("back0")], np.int64)
        self.count, self.word = c[index], _join([x["id"] for x in get("back0")], np.uint64)[index]
        self.base = (np.log10(c + 1) - scale)[index]
        self.own = self.base.copy()
        self.context, self.total = self.before(self.word, 1), self.before(self.count, 1)
        self.level = (self.context > 0).astype(np.int8)
        self.train = np.repeat(~np.unpackbits(np.frombuffer(get("held"), np.uint8), count=len(self.sizes)).astype(bool), self.sizes)

    def before(self, x: np.ndarray, k: int) -> np.ndarray:
        """The value k tokens before each token, 0 before the start of its text."""
        out = np.zeros_like(x)
        out[k:] = x[:-k]
        for j in range(k):
            at = self.bounds[:-1] + j
            out[at[at < self.bounds[1:]]] = 0
        return out

    def hot(self, r: int, often: float, parts: int, depth: int) -> tuple[Rows, Rows]:
        """What is asked of contexts of r words that are seen too often for one shard: their followers, and the words before them."""
        at = np.flatnonzero((self.level == r) & (self.total > often))
        context, word = self.context[at], self.word[at]
        left = self.before(self.word, r + 1)[at] if r < depth else np.zeros(len(at), np.uint64)
        some = left > 0
        with np.errstate(over="ignore"):
            split = mix(word) % (1 + self.total[at] / max(often, 1)).astype(np.uint64)
            follow = Rows(at, mix(context * _ODD + split) % np.uint64(parts), parts, [context, word])
            extend = Rows(at[some], mix(context[some] * _ODD ^ mix(left[some])) % np.uint64(parts), parts, [context[some], left[some]])
        return follow, extend

    def after_hot(self, r: int, often: float, parts: int, depth: int, back: list, hot: np.ndarray, factors: np.ndarray) -> None:
        follow, extend = self.hot(r, often, parts, depth)
        if not len(follow.at):
            return
        n = _join([x["n"] for x in back if x["kind"] == 0], np.int64)[follow.row]
        at, there = lookup(hot, self.context[follow.at])
        f = np.where(there, factors[at] if len(factors) else np.nan, np.nan)
        p = np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / self.total[follow.at])
        self.own[follow.at] = np.where(np.isnan(f), self.own[follow.at], np.where(n > 0, p, self.own[follow.at] + f))
        self.level[follow.at] = 0
        if len(extend.at):
            self.total[extend.at] = _join([x["n"] for x in back if x["kind"] == 1], np.int64)[extend.row]
            self.context[extend.at] = _join([x["id"] for x in back if x["kind"] == 1], np.uint64)[extend.row]
            self.level[extend.at] = np.where(self.context[extend.at] > 0, r + 1, 0)

    def subtrees(self, parts: int, depth: int, wave: int | None = None) -> Iterator[tuple[int, Rows]]:
        """For each length of the contexts looked at next, the windows (of one wave's parts): context, the words before it, the word itself."""
        for r in range(1, depth + 1):
            at = np.flatnonzero(self.level == r)
            with np.errstate(over="ignore"):
                part = mix(self.context[at] * _ODD + np.uint64(r)) % np.uint64(parts)
            if wave is not None:
                mine = part % np.uint64(WAVES) == wave
                at, part = at[mine], part[mine]
            if not len(at):
                continue
            columns, alive = [self.context[at]], np.ones(len(at), bool)
            for k in range(r + 1, depth + 1):
                x = np.where(alive, self.before(self.word, k)[at], np.uint64(0))
                alive = x > 0
                columns.append(x)
            yield r, Rows(at, part, parts, [*columns, self.word[at]])


def replay(batch, i: int, scale: float, levels: list, parts: int, depth: int) -> Block:
    """A block after the hot levels that are known: the count from which a context is hot, the hot contexts and their factors of each."""
    block = Block(batch, i, scale)
    for k, (often, hot, factors) in enumerate(levels):
        block.after_hot(k + 1, often, parts, depth, batch.column(f"back{k + 1}")[i].as_py() or [], hot, factors)
    return block


# ---------------------------------------------------------------- what shards answer


def factors_of(total, seen, kept, kept_parent, gain, divergence: float) -> np.ndarray:
    """log10 of the factor on the probability under the suffix's state, NaN for contexts that aren't retained."""
    factor = np.maximum(1e-9, 1 - kept) / np.maximum(1e-9, 1 - np.minimum(kept_parent, 1 - 1e-9))
    return np.where((seen > 0) & (gain + (total - seen) * np.log(factor) >= divergence), np.log10(factor), np.nan)


def follower_sums(context: np.ndarray, n: np.ndarray, total: np.ndarray, parent: np.ndarray, often: np.ndarray, size: int) -> tuple:
    """(seen, kept, kept_parent, gain) of each of `size` contexts over pairs of context and follower; `often`: those that count."""
    q = np.where(often, (n - DISCOUNT) / np.maximum(total, 1), 0.0)
    gain = np.where(often, n * np.log(np.maximum(q, 1e-300) / parent), 0.0)
    return q, tuple(np.bincount(context, weights=x, minlength=size) for x in (np.where(often, n, 0), q, np.where(often, parent, 0.0), gain))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, an index of each, and which of them each key is."""
    order = np.argsort(keys)
    new = runs(keys[order])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = order[new]
    return keys[first], first, inverse


def subtree(context: np.ndarray, deeper: list[np.ndarray], word: np.ndarray, count: np.ndarray, parent: np.ndarray, least: int, divergence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, total, f) of each window: its log10 probability is log10((n - DISCOUNT) / total) + f, with `parent` in place of the quotient where n is 0.

    deeper: the words before `context`, 0 where there is none; word: 0 if it can't be a frequent follower; count: training tokens;
    parent: the probability without contexts that begin with `context`.
    """
    wide = int(max([word.max(initial=0), *(x.max(initial=0) for x in deeper)])) + 1
    word, p = word.astype(np.int64), parent.astype(np.float64)
    found_n, found_total, found_f = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), np.zeros(len(word))
    live = np.arange(len(word))
    ids = grouped(context)[2]
    for k in range(len(deeper) + 1):
        n_contexts = int(ids.max(initial=-1)) + 1
        total = np.bincount(ids, weights=count[live], minlength=n_contexts)
        pairs, first, inverse = grouped(ids * wide + word[live])
        n = np.bincount(inverse, weights=count[live], minlength=len(pairs))
        own = pairs // wide
        often = (n >= least) & (pairs % wide > 0)
        q, sums = follower_sums(own, n, total[own], p[live[first]], often, n_contexts)
        f = factors_of(total, *sums, divergence)[ids]
        kept = ~np.isnan(f)
        hit, miss = kept & often[inverse], kept & ~often[inverse]
        at = live[hit]
        found_n[at], found_total[at], found_f[at], p[at] = n[inverse[hit]], total[ids[hit]], 0, q[inverse[hit]]
        found_f[live[miss]] += f[miss]
        p[live[miss]] *= 10 ** f[miss]
        if k < len(deeper):
            following = deeper[k][live].astype(np.int64)
            ok = (following > 0) & (total[ids] >= least)
            live = live[ok]
            if not len(live):
                break
            ids = grouped(ids[ok] * wide + following[ok])[2]
    return found_n, found_total, found_f


ASKED = "part int, block binary, kind int, columns array<binary>, counts binary, parents binary"


def _rows_of(part, block, kind, columns, counts, parents):
    n = len(part)
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([block] * n, pa.binary()), pa.array([kind] * n, pa.int32()), pa.array([list(x) for x in zip(*columns, strict=True)], pa.list_(pa.binary())), pa.array(counts, pa.binary()), pa.array(parents, pa.binary())], [x.split()[0] for x in ASKED.split(", ")])


def _hot_answers(table: DataFrame, r: int, scale: float, levels: list, often: float, parts: int, depth: int, least: int) -> DataFrame:
    """(part, block, kind, n, id, top, sums) of contexts of r words above `often`; kind 0: counts of followers, 1: counts and numbers of words before."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, name = replay(batch, i, scale, levels, parts, depth), batch.column("block")[i].as_py()
                for kind, rows in enumerate(block.hot(r, often, parts, depth)):
                    if len(rows.at):
                        extra = (block.total, block.own) if kind == 0 else ()
                        columns = [rows.slices(x) for x in (*rows.columns, *(x[rows.at][rows.pick] for x in extra))]
                        yield _rows_of(rows.parts, name, kind, columns, rows.slices(rows.counts(block.train)), [b""] * len(rows.parts))

    def answer(batches):
        for part, rows in each_part(batches):
            for kind in (0, 1):
                mine = [x for x in rows if x["kind"] == kind]
                if not mine:
                    continue
                context, other = (_join([x["columns"][j] for x in mine], np.uint64) for j in (0, 1))
                count = _join([x["counts"] for x in mine], np.uint32)
                head, where = grouped(grouped(context)[2] * (int(other.max()) + 1) + other.astype(np.int64))[1:]
                n = np.bincount(where, weights=count).astype(np.int64)
                sums, number = b"", np.zeros(len(n), np.uint64)
                if kind == 0:
                    total, parent = _join([x["columns"][2] for x in mine], np.int64)[head], 10.0 ** _join([x["columns"][3] for x in mine], np.float64)[head]
                    n = np.where((n >= least) & (other[head] > 0), n, 0)
                    names, at = np.unique(context[head], return_inverse=True)
                    by_name = np.zeros(len(names))
                    by_name[at] = total
                    stats = np.stack([by_name, *follower_sums(at, n, total, parent, n > 0, len(names))[1]])
                    sums = names.astype("<u8").tobytes() + stats.astype("<f8").tobytes()
                else:
                    number = np.where(n >= least, np.arange(len(n)) * parts + part + 1, 0).astype(np.uint64)
                cuts = np.cumsum([0, *(len(_unpack(x["counts"], np.uint32)) for x in mine)])
                for i, x in enumerate(mine):
                    here = where[cuts[i] : cuts[i + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x["block"]], pa.binary()), pa.array([kind], pa.int32()), pa.array([_pack(n[here])], pa.binary()), pa.array([_pack(number[here])], pa.binary()), pa.array([int(n.max(initial=0)) if kind and not i else 0], pa.int64()), pa.array([b"" if i else sums], pa.binary())], ["part", "block", "kind", "n", "id", "top", "sums"])

    asked = table.drop("ids").mapInArrow(ask, ASKED)
    return dealt(asked, parts).mapInArrow(answer, "part int, block binary, kind int, n binary, id binary, top bigint, sums binary")


def hot_factors(answers: DataFrame, divergence: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hot contexts and their factors, from the sums of the shards that hold them."""
    names, sums = [np.zeros(0, np.uint64)], [np.zeros((5, 0))]
    for row in answers.where(F.octet_length("sums") > 0).select("sums").toLocalIterator():
        hot = bytes(row["sums"])
        n = len(hot) // 48
        names.append(np.frombuffer(hot[: 8 * n], "<u8"))
        sums.append(np.frombuffer(hot[8 * n :], "<f8").reshape(5, n))
    names, sums = np.concatenate(names), np.concatenate(sums, axis=1)
    keys = unique_counts(names)[0]
    total = np.zeros(len(keys))
    total[np.searchsorted(keys, names)] = sums[0]  # the same in every shard
    return keys, factors_of(total, *(unique_counts(names, x)[1] for x in sums[1:]), divergence)


def _changes(table: DataFrame, scale: float, levels: list, parts: int, wave: int, depth: int, least: int, divergence: float) -> DataFrame:
    """(block, docs, changes): by what the windows of a shard change the log10 probability of each of a block's documents."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = replay(batch, i, scale, levels, parts, depth)
                doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
                for r, rows in block.subtrees(parts, depth, wave):
                    pick = rows.at[rows.pick]
                    # a probability is the word's count at the first level, which packs better
                    parents = block.count[pick].astype(np.uint64) if r == 1 else block.own[pick]
                    contexts = np.diff(rows.columns[0].astype(np.int64), prepend=0)
                    contexts[rows.cuts[:-1]] = rows.columns[0][rows.cuts[:-1]].astype(np.int64)
                    times = np.bincount(rows.row, minlength=len(rows.pick))
                    owners, ends = doc[rows.at[rows.order]], np.concatenate(([0], np.cumsum(times)))[rows.cuts]
                    owners = [_pack(owners[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield _rows_of(rows.parts, batch.column("block")[i].as_py(), r, [rows.slices(x) for x in (contexts, *rows.columns[1:], times)] + [owners], rows.slices(rows.counts(block.train)), rows.slices(parents))

    def answer(batches):
        for _, rows in each_part(batches):
            for r in sorted({x["kind"] for x in rows}):
                mine = [x for x in rows if x["kind"] == r]
                contexts = [np.cumsum(_unpack(x["columns"][0], np.int64)) for x in mine]
                *deeper, word = (_join([x["columns"][j] for x in mine], np.uint64) for j in range(1, len(mine[0]["columns"]) - 2))
                parents = _join([x["parents"] for x in mine], np.uint64 if r == 1 else np.float64)
                parents = np.log10(parents + 1) - scale if r == 1 else parents
                at = np.cumsum([0, *map(len, contexts)])
                contexts, counts = np.concatenate(contexts), _join([x["counts"] for x in mine], np.uint32)
                order, change = np.argsort(contexts), np.empty(len(contexts))
                head = np.flatnonzero(runs(contexts[order]))
                cuts = head[np.unique(np.searchsorted(head, np.arange(0, len(order), CHUNK)).clip(max=len(head) - 1))]
                for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                    here = order[a:b]
                    n, total, f = subtree(contexts[here], [x[here] for x in deeper], word[here], counts[here], 10.0 ** parents[here], least, divergence)
                    change[here] = np.where(n > 0, np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(total, 1)) - parents[here], 0.0) + f
                answers = []
                for i, x in enumerate(mine):
                    docs = _unpack(x["columns"][-1], np.int64)
                    each = np.repeat(change[at[i] : at[i + 1]], _unpack(x["columns"][-2], np.int64))
                    own, _, inverse = grouped(docs)
                    sums = np.round(np.bincount(inverse, weights=each) / GRAIN).astype(np.int64)
                    some = np.flatnonzero(sums)
                    answers.append((x["block"], _pack(own[some]), _pack(sums[some])))
                for a in range(0, len(answers), ANSWERS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*answers[a : a + ANSWERS], strict=True)], ["block", "docs", "changes"])

    asked = table.drop("ids").mapInArrow(ask, ASKED)
    return dealt(asked, parts).mapInArrow(answer, "block binary, docs binary, changes binary")


# ---------------------------------------------------------------- the operator


def lm_scores(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, divergence: float = DIVERGENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; `training` says which rows are learned from.

    base_score: sum over tokens of log10((c + 1) / (N + V + 1)); score: log10 probability under the tree.
    Null texts count as empty, their one token is the end; a null condition counts as not training; repeated
    rows are learned from and scored each; without training rows every token has probability 1; an empty table
    gives no rows; very long texts are blocks of their own. Columns other than the two named are neither read nor kept.
    """
    if depth < 1 or min_count < 1:
        raise ValueError("contexts have a word at least, and sequences are seen")
    spark = df.sparkSession
    id_type = dict(df.dtypes)[id_col]
    table = materialise(blocks(df, id_col, text_col, training), "blocks")
    total = table.agg(F.sum("n_train"), F.sum("n_words"), F.sum("n_tokens")).first()
    n_train, entries, n_tokens = (x or 0 for x in total)
    counted = materialise(word_counts(table, max(1, -(-entries // SHARD)), min_count), "counts")
    scale = np.log10(n_train + (counted.agg(F.sum("v")).first()[0] or 0) + 1)

    def joined(table, answers, k, *names):
        back = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*names))).alias(f"back{k}"))
        return table.join(back.hint("merge"), "block", "left")

    def moved(new, *old):
        out = materialise(new, "level")
        for x in old:
            drop_materialised(x)
        return out

    table = moved(joined(table.select("block", "ids", "held", "sizes", "tokens"), counted, 0, "part", "n", "id"), table, counted)
    levels: list = []
    often, parts = HOT * n_train / max(1, n_tokens), max(1, -(-n_tokens // SHARD))  # windows of rows that aren't learned from meet as well
    for r in range(1, depth + 1 if n_train else 1):
        answers = materialise(_hot_answers(table, r, scale, levels, often, parts, depth, min_count), "hot")
        top = answers.agg(F.max("top")).first()[0]
        if top is None:  # no hot context is left
            drop_materialised(answers)
            break
        levels = [*levels, (often, *hot_factors(answers, divergence))]
        table = moved(joined(table, answers, r, "kind", "part", "n", "id"), table, answers)
        if top <= often:
            break
    known = spark.sparkContext.broadcast(levels)

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = replay(batch, i, scale, known.value, parts, depth)
                sums = lambda x: np.add.reduceat(x, block.bounds[:-1])  # noqa: B023, E731  every text has its end
                columns = (~block.train[block.bounds[:-1]], block.sizes, sums((block.count > 0).astype(np.int64)), sums(block.base), sums(block.own))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), batch.column("ids").slice(i, 1), *(pa.array([x]) for x in columns)], ["block", "ids", "held_out", "n_tokens", "n_known", "base_score", "own"])

    names, types = ["ids", "held_out", "n_tokens", "n_known", "base_score", "own"], f"ids array<{id_type}>, held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base_score array<double>, own array<double>"
    docs = materialise(table.mapInArrow(documents, f"block binary, {types}"), "scored").select("*", *[F.lit(None).cast("binary").alias(x) for x in ("docs", "changes")])
    if n_train:
        waves = [materialise(_changes(table, scale, levels, parts, w, depth, min_count, divergence), "changes") for w in range(WAVES)]
        empty = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in types.split(", "))]
        docs = reduce(DataFrame.unionByName, [docs, *(x.select("block", *empty, "docs", "changes") for x in waves)])
    drop_materialised(table)
    # a block's documents come first, then their changes, row by row
    together = docs.repartition(max(1, -(-n_tokens // SUMMED)), "block").sortWithinPartitions("block", F.col("ids").isNull())

    def score(batches):
        block = None

        def out():
            ids, held, sizes, n_known, base = (batch.column(x).slice(i, 1).flatten() for x in names[:-1])
            return [ids, held, sizes, n_known, pa.array(np.full(len(ids), n_train)), base]

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("ids")[i].is_valid:
                    if block:
                        yield pa.RecordBatch.from_arrays([*block, pa.array(own)], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    block, own = out(), batch.column("own").slice(i, 1).flatten().to_numpy().copy()
                else:
                    own[_unpack(batch.column("docs")[i].as_py(), np.int64)] += _unpack(batch.column("changes")[i].as_py(), np.int64) * GRAIN
        if block:
            yield pa.RecordBatch.from_arrays([*block, pa.array(own)], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return together.mapInArrow(score, f"`{id_col}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
