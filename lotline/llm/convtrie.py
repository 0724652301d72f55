"""Prefix trie of conversations by leaf-peeling message passing.

Turns become 128-bit hashes at once; no text is shuffled. A node's key is its depth and the XOR of the hashes of its
turns and their depths, so keys are running XORs, and a parent's key is the node's without its last turn. The nodes whose smallest member is
the same conversation follow each other downwards: they are a path, and paths hang on nodes of other paths. Messages pass between
paths: each holds a counter of the paths below it that haven't finished and the sums received so far; a path with none left sends the totals of
its subtree to its parent, until only the root's path is left. Totals of single nodes are then sums along each path. There are as many
rounds as a leaf has paths above it, at most the depth of the trie.

No conversation, turn or node is held by one task: the order of turns comes from a range partitioning, and running sums
are taken in blocks, then over the blocks. The digest of the members of a node is sequential by definition; ranges of
members are joined to chunks of text first, and one task reads a node's chunks in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialised, materialise

#: Depths of a path whose running sums one task takes.
BLOCK = 4096
#: Bytes of members' ids that are joined to one chunk.
CHUNK = 1 << 15
#: A rebuilt conversation takes its first turns, fewer than HEADS, from the first conversation of its group of GROUP.
GROUP, HEADS = 20, 4

WORDS = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, turn_key, words): turns in order; part is a range of the order, place ascends in it.

    Ties of a turn are ordered by a hash of role and text; rows that are equal in all stay next to each other, in any order.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary")).alias("turn_key"),
        F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "turn_key", "row"]
    ranges = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranges.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "turn_key", "words"), "turns")


def running(df: DataFrame, key: str, block: str, order: Column, values: list[str], total) -> DataFrame:
    """df with each of `values` replaced by its running total over the rows of its key: within a block first, then over blocks.

    A block's rows follow each other in the order, and blocks ascend with it; `total` is an aggregate (sum or bit_xor).
    """
    own = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(key, block).agg(*[total(v).alias(v) for v in values])
    blocks = blocks.select(key, block, *[F.coalesce(total(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    inside = df.select(*[c for c in df.columns if c not in values], *[total(v).over(own).alias(v) for v in values])
    joined = inside.join(blocks, [key, block])
    both = (lambda a, b: a.bitwiseXOR(b)) if total is F.bit_xor else (lambda a, b: a + b)
    return joined.select(*[c for c in inside.columns if c not in values], *[both(F.col(v), F.col(f"{v}_before")).alias(v) for v in values])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, is_end): a row for each rebuilt conversation and depth, the root's included."""
    parts = turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", "first", before.alias("before"), F.sum("n").over(own).alias("length"))
    placed = turns.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("place") - F.col("first") + F.col("before") + 1).alias("pos"), "turn_key", "words", "length")
    placed = materialise(placed, "placed")

    lengths = placed.where(F.col("pos") == 1).select("conv_id", "length")
    heads = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("heads"))
    heads = heads.withColumnRenamed("conv_id", "base")
    convs = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    convs = convs.join(heads, "base", "left").select("conv_id", "length", "h", F.when(F.col("h") > 0, F.slice("heads", 1, F.col("h").cast("int"))).alias("heads"))
    convs = convs.withColumn("n_heads", F.coalesce(F.size("heads"), F.lit(0))).withColumn("n_heads", F.greatest("n_heads", F.lit(0)).cast("bigint"))
    convs = materialise(convs.withColumn("end", F.col("n_heads") + F.greatest(F.col("length") - F.col("h"), F.lit(0))), "convs")

    taken = convs.where(F.col("n_heads") > 0).select("conv_id", F.explode("heads").alias("x"), "end").select("conv_id", F.lit(-1).alias("part"), F.col("x.pos").alias("depth"), F.col("x.turn_key").alias("turn_key"), F.col("x.words").alias("words"), "end")
    kept = placed.join(convs.select("conv_id", "h", "n_heads", "end"), "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", "part", (F.col("n_heads") + F.col("pos") - F.col("h")).alias("depth"), "turn_key", "words", "end")
    rows = taken.unionByName(kept).withColumns({"z1": F.xxhash64("depth", "turn_key"), "z2": F.xxhash64("turn_key", "depth")})
    rows = rows.withColumns({"k1": F.col("z1"), "k2": F.col("z2")})
    rows = running(rows, "conv_id", "part", F.col("depth"), ["k1", "k2"], F.bit_xor)
    rows = rows.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "words", (F.col("depth") == F.col("end")).alias("is_end"))
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"), (F.col("end") == 0).alias("is_end"))
    out = materialise(rows.unionByName(roots), "rebuilt")
    drop_materialised(placed)
    drop_materialised(convs)
    return out


def ends_digest(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where a conversation ends."""
    node = ["depth", "k1", "k2"]

    def chunks(batches):
        key, ids, size, first = None, [], 0, None
        for batch in batches:
            out = []
            for *k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key or size > CHUNK:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, ids, size, first = k, [], 0, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield table(out)
        if ids:
            yield table([(*key, first, ",".join(ids))])

    def table(out):
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], [*node, "first", "ids"])

    def digests(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield result(out)
        if key is not None:
            yield result([(*key, sha.hexdigest())])

    def result(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], [*node, "ends_sha256"])

    ends = rows.where("is_end").select(*node, "conv_id")
    ranges = ends.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    pieces = ranges.mapInArrow(chunks, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def peel(paths: DataFrame) -> list[DataFrame]:
    """(conv_id, parent, at, waiting, saved, leaves) of each path when it finished, one written table a round (rows with waiting = 0)."""
    state, rounds = materialise(paths, "paths"), []
    while True:
        rounds.append(state)
        rest = state.where(F.col("waiting") > 0)
        if rest.isEmpty():
            return rounds
        sent = state.where((F.col("waiting") == 0) & F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n"), F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        got = rest.join(sent.withColumnRenamed("parent", "__to"), F.col("conv_id") == F.col("__to"), "left")
        add = {"waiting": "n", "saved": "s", "leaves": "l"}
        state = materialise(got.select("conv_id", "parent", "at", *[(F.col(c) + F.coalesce(v, F.lit(0)) * (-1 if c == "waiting" else 1)).alias(c) for c, v in add.items()]), "paths")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c takes its first h turns from conversation c - c % 20 (h: crc32 of its decimal id, modulo 4) and its own after the
    first h. Turns are ordered by `turn` (null first), ties by the MD5 of the MD5s of role and text; repeated rows are turns each. Null roles and texts
    are empty. Rows without conv_id belong to no conversation. Without rows there are no nodes, not even a root. Very long texts are
    hashed whole, very long conversations are dealt out in blocks. Other columns, whatever their names, aren't read. Nodes are told apart by 128 bits of hash.
    """
    turns = ordered_turns(conversations)
    rows = rebuilt(turns)
    drop_materialised(turns)
    least = F.min(F.struct("conv_id", "is_end")).alias("least")
    nodes = rows.groupBy("depth", "k1", "k2").agg(least, F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = nodes.select("depth", "k1", "k2", F.col("least.conv_id").alias("conv_id"), (~F.col("least.is_end")).cast("int").alias("goes_on"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "p1", "p2")
    nodes = materialise(nodes.join(ends_digest(rows), ["depth", "k1", "k2"], "left"), "nodes")
    drop_materialised(rows)

    # paths, and the nodes that they hang on
    paths = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"))
    paths = paths.select("conv_id", (F.col("top.depth") - 1).alias("at"), "top.p1", "top.p2", "bottom", "saved")
    above = nodes.select(F.col("depth").alias("at"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    hung = paths.where(F.col("at") >= 0).join(above, ["at", "p1", "p2"])
    columns = ["conv_id", "parent", "at", "bottom", "saved"]
    paths = materialise(hung.select(columns).unionByName(paths.where(F.col("at") < 0).withColumn("parent", F.lit(None).cast("bigint")).select(columns)), "hung")
    below = paths.where(F.col("at") >= 0).groupBy(F.col("parent").alias("__p"), F.col("at").alias("__at")).agg(F.count("*").alias("__n"))
    waiting = below.groupBy(F.col("__p").alias("conv_id")).agg(F.sum("__n").alias("waiting"), F.max("__at").alias("lowest"))
    start = paths.join(waiting, "conv_id", "left").select("conv_id", "parent", "at", F.coalesce("waiting", F.lit(0)).alias("waiting"), "saved", (F.coalesce(F.col("lowest") < F.col("bottom"), F.lit(True))).cast("bigint").alias("leaves"))
    rounds = peel(start)

    # what hangs on each node, and sums along each path from its bottom
    done = rounds[0].where(F.col("waiting") == 0)
    for later in rounds[1:]:
        done = done.unionByName(later.where(F.col("waiting") == 0))
    received = done.where(F.col("at") >= 0).groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("n"), F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    tops = paths.select("conv_id", (F.col("at") + 1).alias("depth"), "parent", F.lit(True).alias("is_top"))
    nodes_all = nodes.join(received, ["conv_id", "depth"], "left").join(tops, ["conv_id", "depth"], "left")
    children = F.coalesce("n", F.lit(0)) + F.col("goes_on")
    nodes_all = nodes_all.select(
        "conv_id",
        "depth",
        F.when(F.col("is_top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        children.alias("n_children"),
        (F.coalesce("l", F.lit(0)) + (children == 0).cast("bigint")).alias("n_leaves"),
        (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        (-F.floor(F.col("depth") / BLOCK)).alias("block"),
    )
    summed = running(nodes_all, "conv_id", "block", F.col("depth").desc(), ["n_leaves", "saved_tokens"], F.sum)
    out = materialise(summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")
    for written in (nodes, paths, *rounds):
        drop_materialised(written)
    return out
