"""Byte-level BPE encoding and decoding with padded numpy matrices.

The distinct pre-tokens of a run of texts are laid out as matrices of ids, one matrix for each
band of lengths. In each round every row merges its leftmost pair of minimum rank: pair ranks come
from an open-addressing hash table, merged rows close up, and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import map_texts

NONE = np.int32(2**31 - 1)
#: Pre-tokens over this many bytes are merged one by one with a heap; rounds over matrices would be quadratic.
LONG = 256
_SLOT_BITS = 21


class Vocabulary:
    """Ranks of byte strings, and for every two tokens that join to a token the rank of the result."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = dict(zip(keys, values, strict=True))
        self._fill(np.array(keys, np.int64), np.array(values, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.slot_keys = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.slot_values = np.full(1 << _SLOT_BITS, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_keys[at[left]] == -1]
            self.slot_keys[at[free]] = keys[free]
            won = free[self.slot_keys[at[free]] == keys[free]]
            self.slot_values[at[won]] = values[won]
            left = left[self.slot_keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << _SLOT_BITS) - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's join, NONE where it is no token; ids below zero are padding."""
        shape = a.shape
        keys = ((a.astype(np.int64) << 32) | b.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        live = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._slot(keys[live])
        while len(live):
            held = self.slot_keys[at]
            hit = held == keys[live]
            out[live[hit]] = self.slot_values[at[hit]]
            on = ~hit & (held != -1)
            live, at = live[on], (at[on] + 1) & ((1 << _SLOT_BITS) - 1)
        return out.reshape(shape)

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long pre-token, with a heap of pairs and a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (s := pair(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := pair(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Merges every row of a matrix of ids (padded with -1) until none of its pairs is a token."""
        out = np.full(ids.shape, -1, np.int32)
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 0), NONE, np.int32)
        while len(rows):
            width = ids.shape[1]
            col = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), col] if width > 1 else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                out[rows[done], :width] = ids[done]
                going = ~done
                rows, ids, ranks, col, best = rows[going], ids[going], ranks[going], col[going], best[going]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            take = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, take + (take > col[:, None]), axis=1)
            ids[every, col] = best
            take = take[:, :-1]
            ranks = np.take_along_axis(ranks, take + (take >= col[:, None]), axis=1)
            left = np.flatnonzero(col > 0)
            if len(left):
                ranks[left, col[left] - 1] = self.pair_ranks(ids[left, col[left] - 1], best[left])
            right = np.flatnonzero(col < width - 2)
            if len(right):
                ranks[right, col[right]] = self.pair_ranks(best[right], ids[right, col[right] + 1])
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces end to end, and the bounds of each piece's."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        counts, parts = np.zeros(len(pieces), np.int64), []
        width = 1
        while width <= LONG:
            low = width // 2 if width > 16 else width - 1
            band = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(band), max(1, (1 << 19) // width)):
                part = band[at : at + max(1, (1 << 19) // width)]
                column = np.arange(width)[None, :]
                inside = column < sizes[part][:, None]
                ids = np.where(inside, flat[np.minimum(starts[part][:, None] + column, len(flat) - 1)], -1).astype(np.int32)
                ids = self.merge_matrix(ids)
                counts[part] = (ids >= 0).sum(axis=1)
                parts.append((part, ids))
            width = width + 1 if width < 16 else width * 2
        long = {int(i): self.merge_long(pieces[i]) for i in np.flatnonzero(sizes > LONG)}
        for i, ids in long.items():
            counts[i] = len(ids)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(bounds[-1], np.int32)
        for part, ids in parts:
            row, column = np.nonzero(ids >= 0)
            out[bounds[part][row] + column] = ids[row, column]
        for i, ids in long.items():
            out[bounds[i] : bounds[i + 1]] = ids
        return out, bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts end to end, the bounds of each text's, and each text's ids as decimal text."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            pieces += self.pattern.findall(text)
            ends.append(len(pieces))
        codes, distinct = pd.factorize(np.array(pieces, object)) if pieces else (np.zeros(0, np.int64), [])
        ids, bounds = self.encode_pieces([x.encode("utf-8", "surrogatepass") for x in distinct])
        names = list(map(str, ids.tolist()))
        said = np.array([" ".join(names[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] or [""], object)
        size = np.diff(bounds)[codes]
        cuts = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.arange(cuts[-1]) + np.repeat(bounds[:-1][codes] - cuts[:-1], size)] if len(codes) else np.zeros(0, np.int32)
        return flat, cuts[ends], [" ".join(said[codes[a:b]].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        size = (self.token_bounds[1:] - self.token_bounds[:-1])[ids]
        cuts = np.concatenate(([0], np.cumsum(size)))
        flat = self.token_bytes[np.arange(cuts[-1]) + np.repeat(self.token_bounds[:-1][ids] - cuts[:-1], size)] if len(ids) else np.zeros(0, np.uint8)
        at = cuts[bounds]
        return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for each worker process; the file lies on every machine."""
    return Vocabulary(read_ranks(path), pattern)


def encode_table(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) for each row. Null texts count as empty, which has no ids; repeated rows stay;
    an empty table gives no rows; very long texts are encoded whole; other columns go, whatever their names."""
    id_type = dict(df.dtypes)[id_col]

    def run(rows, texts):
        v = vocabulary(path, pattern)
        ids, bounds, _ = v.encode([bytes(texts.bytes_of(i)).decode("utf-8", "replace") for i in range(texts.n)])
        return rows.column(0), [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], v.decode(ids, bounds)

    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {id_type}, ids array<int>, decoded binary", 1 << 20)


def encode_digest(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, by the same encoding and decoding as encode_table and with
    its rules for nulls, repeated rows, empty tables and other columns; no ids have the hash of the empty string."""
    id_type = dict(df.dtypes)[id_col]

    def run(rows, texts):
        v = vocabulary(path, pattern)
        ids, bounds, said = v.encode([bytes(texts.bytes_of(i)).decode("utf-8", "replace") for i in range(texts.n)])
        return rows.column(0), np.diff(bounds), [hashlib.sha256(x.encode()).hexdigest() for x in said], [hashlib.sha256(x).hexdigest() for x in v.decode(ids, bounds)]

    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", 2 << 20)
