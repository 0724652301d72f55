"""Shared pieces of the training-data operators.

Texts reach Python as Arrow batches; the helpers here view their UTF-8 bytes as
numpy arrays, so that work per byte, word or shingle is vectorised and a task
never holds more than a few megabytes of text at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at a time.
CHUNK_BYTES = 4 << 20
#: Zero bytes after each chunk, so that 8-byte loads never leave it.
PAD = 64

_U64 = np.uint64
# Fixed values of the public XXH64 definition.
_P1 = _U64(0x9E3779B185EBCA87)
_P2 = _U64(0xC2B2AE3D27D4EB4F)
_P3 = _U64(0x165667B19E3779F9)
_P4 = _U64(0x85EBCA77C2B2AE63)
_P5 = _U64(0x27D4EB2F165667C5)

#: True for the bytes that separate words: space, tab, line feed, VT, FF, CR.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- shared tables


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset, in local mode only, a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lotline-")
        sc.setCheckpointDir(root)
    return root


#: Makes Spark delete the shuffle files of a query when it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back: cuts lineage and survives lost executors.

    Nothing reads the query's shuffle files once the table is written, so they go at once.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lotline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Deletes the files behind a frame that materialise() returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/lotline/" in str(folder.toString()):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# ---------------------------------------------------------------- texts as bytes


class Texts:
    """Some whole texts: their bytes end to end (zero-padded), the offsets of each, and which rows they are.

    Null texts count as empty.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def bytes_of(self, i: int) -> memoryview:
        return memoryview(self.data[self.offsets[i] : self.offsets[i + 1]])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of words before each text (length n + 1)."""
        data = self.data[: self.size]
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        solid = ~IS_SPACE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        cuts = np.unique(self.offsets[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begin[cuts] |= solid[cuts]
        end[cuts - 1] |= solid[cuts - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def texts_of(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The whole texts of an Arrow string column, in runs of at most chunk_bytes (a longer text is a run of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1)
        to = min(to, len(column))
        lo, hi = offsets[at], offsets[to]
        part = np.zeros(hi - lo + PAD, np.uint8)
        part[: hi - lo] = data[lo:hi]
        yield Texts(part, offsets[at : to + 1] - lo, at)
        at = to


def map_texts(df: DataFrame, columns: list[str], text_col: str, fn: Callable, schema: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """fn(rows, texts) for each run of texts; rows: an Arrow batch of `columns`; it returns arrays in the schema's order."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    n = len(columns)

    def run(batches):
        for batch in batches:
            for texts in texts_of(batch.column(n), chunk_bytes):
                out = fn(batch.slice(texts.first, texts.n), texts)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type, from_pandas=False) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(out, fields, strict=True)], schema=fields)

    return df.select(*[F.col(c) for c in columns], F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- hashing


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U64(r)) | (x >> _U64(64 - r))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def words8(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word at every position of a padded chunk."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of a padded chunk at once.

    Slices are ordered by length so that those still being read are a prefix;
    slices over 512 bytes, which are rare, go to the xxhash library one by one.
    """
    n = len(starts)
    out = np.empty(n, np.uint64)
    if not n:
        return out
    lengths = np.asarray(lengths, np.int64)
    if lengths.max() > 512:
        long = np.flatnonzero(lengths > 512)
        for i in long:
            out[i] = xxhash.xxh64_intdigest(memoryview(data[starts[i] : starts[i] + lengths[i]]), seed)
        short = np.flatnonzero(lengths <= 512)
        out[short] = xxh64(data, starts[short], lengths[short], seed)
        return out
    order = np.argsort((512 - lengths).astype(np.uint16), kind="stable")
    p, size = np.asarray(starts, np.int64)[order], lengths[order]
    word, falling = words8(data), -size
    seed_u = _U64(seed)
    with np.errstate(over="ignore"):
        h = np.full(n, seed_u + _P5, np.uint64)
        big = int(np.searchsorted(falling, -32, "right"))
        if big:
            v = [np.full(big, s, np.uint64) for s in (seed_u + _P1 + _P2, seed_u + _P2, seed_u, seed_u - _P1)]
            for j in range(int(size[0]) // 32):
                k = int(np.searchsorted(falling, -32 * (j + 1), "right"))
                for lane in range(4):
                    v[lane][:k] = _round(v[lane][:k], word[p[:k] + (32 * j + 8 * lane)])
            acc = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
            for lane in range(4):
                acc = (acc ^ _round(np.zeros(big, np.uint64), v[lane])) * _P1 + _P4
            h[:big] = acc
            p = p + (size // 32) * 32
        h += size.astype(np.uint64)
        rest = size % 32
        for j in range(3):
            i = np.flatnonzero(rest >= 8 * (j + 1))
            if not len(i):
                break
            h[i] = rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), word[p[i] + 8 * j]), 27) * _P1 + _P4
        p = p + (rest // 8) * 8
        i = np.flatnonzero(rest % 8 >= 4)
        if len(i):
            h[i] = rotl(h[i] ^ ((word[p[i]] & _U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            p[i] += 4
        tail = rest % 4
        for j in range(3):
            i = np.flatnonzero(tail > j)
            if not len(i):
                break
            h[i] = rotl(h[i] ^ (data[p[i] + j].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> _U64(33)
        h *= _P2
        h ^= h >> _U64(29)
        h *= _P3
        h ^= h >> _U64(32)
    out[order] = h
    return out


def unique_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their weights (or their number)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key among the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty segments give 0."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])[: len(full)] if bounds[-1] == len(values) else np.add.reduceat(values[: bounds[-1]], bounds[full])
    return out
