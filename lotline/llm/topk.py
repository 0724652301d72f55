"""Exact top-k inner products over norm-sorted vectors.

Vectors are processed by descending length in blocks. A query's k-th best score within the block of
longest vectors is a bound that all later candidates must reach. A later block is read for a block of
queries only if its longest vector can reach that bound; inside, vectors are rotated by an SVD basis
that puts most of the energy into the leading coordinates, and a partial sum plus the
Cauchy-Schwarz bound of the residuals discards candidates before exact products are taken. The bound
rises with every run of candidates, longest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 512
#: Candidates of a block that are compared at once.
RUN = 1024
#: The rotation is fitted to at most so many vectors, those with the smallest hash of their id.
SVD_SAMPLE = 2000
#: Leading coordinates of the partial sums, as a share of all.
LEAD = 0.25
#: Relative slack of the floating-point bounds.
SLACK = 1e-9


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v binary, norm, row): floor(scale * x) as packed doubles. Vectors that are null or hold null or non-finite components are left out.

    Rows that repeat an id and rows without one all stay; `row` tells rows apart, once the table is written.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            keep, out, norm = [], [], []
            for i, x in enumerate(column.to_numpy(zero_copy_only=False)):
                if x is None:
                    continue
                x = np.asarray(x, float)  # null components arrive as NaN
                if np.isfinite(x).all():
                    x = np.floor(scale * x) + 0.0
                    keep.append(i)
                    out.append(x.astype("<f8").tobytes())
                    norm.append(float(np.sqrt((x * x).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary()), pa.array(norm, pa.float64())], ["id", "v", "norm"])

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>")).mapInArrow(run, f"id {id_type}, v binary, norm double").withColumn("row", F.monotonically_increasing_id())


def unpack(values: list[bytes], width: int) -> np.ndarray:
    """A row for each packed vector; shorter ones are padded with zeros."""
    out = np.zeros((len(values), width))
    for i, x in enumerate(values):
        x = np.frombuffer(x, "<f8")[:width]
        out[i, : len(x)] = x
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows with all rows, held to the range of a long."""
    if not len(q) or not len(c) or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return (q @ c.T).astype(np.int64)  # every partial sum is a whole number that a double holds exactly
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(high, max(low, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for v in c] for u in q], np.int64).reshape(len(q), len(c))


def places(ids: list, rows: np.ndarray) -> np.ndarray:
    """The place of each candidate of a block by id and row, those without an id last."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], rows[i]))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


def best_of(query: np.ndarray, place: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to smaller places."""
    order = np.lexsort((place, -scores, query))
    query = query[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return order[rank < k]


def match(q_rows, q, bound, c_rows, place, c, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of each query's best k of this block that reach its bound."""
    lead = max(1, int(round(LEAD * q.shape[1])))
    q_norm, c_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    slack = SLACK * (q_norm.max(initial=0) * c_norm.max(initial=0) + 1)
    a, b = q @ rotation, c @ rotation
    rest_a, rest_b = (np.sqrt(np.maximum(0, (x[:, lead:] ** 2).sum(axis=1))) for x in (a, b))
    bound = np.array(bound, float)
    i, j, scores = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(c), RUN):
        run = slice(at, at + RUN)
        live = np.flatnonzero(q_norm * c_norm[run].max() + slack >= bound)
        if not len(live):
            continue
        may = a[live, :lead] @ b[run, :lead].T + rest_a[live, None] * rest_b[None, run] + slack >= bound[live, None]
        rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        found = products(q[live[rows]], c[run][columns])
        other = q_rows[live[rows], None] != c_rows[run][None, columns]
        # what is below the k-th of a query's row here can't be among its best
        least = np.maximum(bound[live[rows]], np.partition(np.where(other, found, np.iinfo(np.int64).min), -k, axis=1)[:, -k]) if len(columns) >= k and len(rows) else bound[live[rows]]
        x, y = np.nonzero(other & (found >= least[:, None]))
        i, j, scores = np.append(i, live[rows[x]]), np.append(j, columns[y] + at), np.append(scores, found[x, y])
        top = best_of(i, place[j], scores, k)
        i, j, scores = i[top], j[top], scores[top]
        full = np.flatnonzero(np.bincount(i, minlength=len(q)) >= k)
        kth = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(kth, i, scores)
        bound[full] = np.maximum(bound[full], kth[full])
    return i, j, scores


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(block, top, ids, vs, rows): vectors in descending order of length, `size` to a block; top: the longest length in it.

    Vectors are range-partitioned by length and cut within each partition, so no task holds more than its share.
    """
    n = max(1, -(-vectors.count() // (4 * size)))
    id_type = dict(vectors.dtypes)["id"]

    def run(batches):
        id_arrow = None
        rows: list[list] = [[], [], [], []]

        def out(m):
            part = [x[:m] for x in rows]
            for x in rows:
                del x[:m]
            return pa.RecordBatch.from_arrays([pa.array([max(part[2])], pa.float64()), pa.array([part[0]], pa.list_(id_arrow)), pa.array([part[1]], pa.list_(pa.binary())), pa.array([part[3]], pa.list_(pa.int64()))], ["top", "ids", "vs", "rows"])

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for held, column in zip(rows, batch.columns, strict=True):
                held += column.to_pylist()
            while len(rows[0]) >= size:
                yield out(size)
        if rows[0]:
            yield out(len(rows[0]))

    ordered = vectors.repartitionByRange(n, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    return ordered.mapInArrow(run, f"top double, ids array<{id_type}>, vs array<binary>, rows array<bigint>").withColumn("block", F.monotonically_increasing_id())


def rotation_of(vectors: DataFrame, width: int) -> np.ndarray:
    """An orthogonal basis, strongest direction first, of a bounded sample."""
    sample = [bytes(r["v"]) for r in vectors.orderBy(F.xxhash64("id"), "id", "row").limit(SVD_SAMPLE).select("v").collect()]
    x = unpack(sample, width)
    top = np.abs(x).max(initial=0)
    return np.linalg.svd(x / top if top else x, full_matrices=True)[2].T if len(x) else np.eye(width)


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, id, score): for each row where is_query holds its k best other rows, exactly.

    The score is the integer inner product of floor(scale * x). Ties go to the smaller id. A query with
    fewer other rows than k gets them all; without queries or candidates (as in an empty table) there are no rows.
    Every row but the query's own is a candidate, one that repeats its id or has none too (among ties, last); rows that repeat
    a query's id are queries each, with ranks of their own. A null id is no query. Vectors that are null or hold null or
    non-finite components take no part. Vectors of different lengths are padded with zeros;
    very long ones are like any other. Columns other than the two named are neither read nor kept.
    """
    spark = df.sparkSession
    vectors = materialise(scaled(df, id_col, vector_col, scale), "vectors")
    id_type = dict(vectors.dtypes)["id"]
    width = vectors.agg(F.max(F.octet_length("v"))).first()[0]
    if not width:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, `{id_col}` {id_type}, score bigint")
    width //= 8
    shared = spark.sparkContext.broadcast(rotation_of(vectors, width))
    c_blocks = materialise(blocks(vectors, CANDIDATES), "candidates")
    q_blocks = materialise(blocks(vectors.where(is_query(F.col("id"))), QUERIES), "queries")
    # the block of the longest vectors, at most CANDIDATES of them, goes to every task
    head = c_blocks.orderBy(F.desc("top"), "block").select("block", "ids", "vs", "rows").first()
    head_shared = spark.sparkContext.broadcast(head.asDict())

    def scored(with_bound):
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    c = r if with_bound else head_shared.value
                    q_rows, c_rows = np.array(r["q_rows"]), np.array(c["rows"])
                    bound = np.array(r["bound"], float) if with_bound else np.full(len(q_rows), -np.inf)
                    i, j, s = match(q_rows, unpack(r["q_vs"], width), bound, c_rows, places(c["ids"], c_rows), unpack(c["vs"], width), k, shared.value)
                    kind = batch.schema.field("q_ids").type.value_type
                    q_ids, c_ids = pa.array(r["q_ids"], kind), pa.array(c["ids"], kind)
                    yield pa.RecordBatch.from_arrays([pa.array(q_rows[i]), q_ids.take(pa.array(i)), c_ids.take(pa.array(j)), pa.array(c_rows[j]), pa.array(s, pa.int64())], ["query_row", "query_id", "id", "row", "score"])

        return run

    schema = f"query_row bigint, query_id {id_type}, id {id_type}, row bigint, score bigint"
    q = q_blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.col("rows").alias("q_rows"))
    top = materialise(q.repartition(q_blocks.count() or 1).mapInArrow(scored(False), schema), "head")
    kth = top.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    # bound of each query, back in the order of its block; a query that has no k scores yet has none
    each = q_blocks.select("block", F.posexplode("rows").alias("at", "query_row")).join(kth, "query_row", "left")
    bounds = each.withColumn("kth", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    bounds = bounds.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "kth"))).alias("x")).select(F.col("block").alias("q_block"), F.col("x.kth").alias("bound"))
    least = each.join(vectors.select(F.col("row").alias("query_row"), "norm"), "query_row")
    reach = least.groupBy(F.col("block").alias("q_block")).agg(F.min(F.when(F.coalesce("kth", F.lit(0)) <= 0, 0.0).otherwise(F.col("kth") / F.col("norm"))).alias("reach"))
    q = materialise(q.join(bounds, "q_block").join(reach, "q_block"), "bounded")
    # a later block meets those blocks of queries that its longest vector can serve
    pairs = c_blocks.where(F.col("block") != head["block"]).select("block", "top").join(q.select("q_block", "reach"), F.col("top") * (1 + SLACK) >= F.col("reach")).select("block", "q_block")
    pairs = materialise(pairs, "pairs")
    later = pairs.repartition(max(1, pairs.count()), "block", "q_block").join(c_blocks, "block").join(q, "q_block").mapInArrow(scored(True), schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = top.unionByName(later).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
