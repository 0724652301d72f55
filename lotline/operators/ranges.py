"""Looking back along one long order in parallel ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the order that one task takes.
RANGE = 1 << 17
#: Seconds of a market that one task takes; a market lives 300.
SPAN = 4


def span(epoch: str) -> Column:
    """The span of a second, never null: what has no second comes first, as in an order."""
    return F.coalesce(F.floor(F.col(epoch) / SPAN), F.lit(-(1 << 62)))


def with_sums_before(rows: DataFrame, group: str, block: str, sums: dict[str, Column]) -> DataFrame:
    """rows + for each name the sum of its column over the earlier blocks of the group, 0 in the first one.

    `block` is a column that grows with the order; neither it nor `group` may be null. A block is a row of a small table whose running
    sums meet the rows again, so a window inside (group, block) and this carry look back over a group of any length in many tasks.
    """
    earlier = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = totals.select(group, block, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])
    return rows.join(before, [group, block])


def numbered(rows: DataFrame, group: str, order: str, name: str, size: int | None = None) -> DataFrame:
    """rows + their number from 1 in the group by `order`, a whole number that is unique in it: ranges of it are numbered apart and shifted by the counts before."""
    cut = rows.select("*", F.struct(group).alias("__group"), F.struct(F.floor(F.col(order) / (size or RANGE))).alias("__block"))  # structs, as nulls in them are equal
    own = F.row_number().over(Window.partitionBy("__group", "__block").orderBy(order))
    out = with_sums_before(cut, "__group", "__block", {"__before": F.lit(1)}).withColumn(name, own + F.col("__before"))
    return out.select(*rows.columns, name)


def with_previous(rows: DataFrame, group: str, order: str, looked_for: dict[str, tuple[Column, Column]], size: int | None = None) -> DataFrame:
    """rows + for each name the value that its column has in the last earlier row of the group for which its condition holds; null if there is none.

    looked_for: name -> (column, condition). `order` is a whole number, such as a line or a sequence. Ranges of `size` numbers are sorted
    each on their own, and what the last fitting row of a range holds is carried over the borders by a window over one row a range, so a
    group of any length is shared among tasks.
    """
    block = F.floor(F.col(order) / (size or RANGE))
    held = {n: F.when(F.coalesce(condition, F.lit(False)), F.struct(column.alias("v"))) for n, (column, condition) in looked_for.items()}
    rows = rows.select("*", block.alias("__block"), *[c.alias(f"__own_{n}") for n, c in held.items()])
    before = Window.partitionBy(group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(F.col(group).alias("__g"), F.col("__block").alias("__b")).agg(*[F.max_by(f"__own_{n}", F.when(F.col(f"__own_{n}").isNotNull(), F.col(order))).alias(n) for n in held])
    ends = ends.select("__g", "__b", *[F.last(n, ignorenulls=True).over(earlier).alias(f"__carried_{n}") for n in held])
    inside = rows.withColumns({f"__in_{n}": F.last(f"__own_{n}", ignorenulls=True).over(before) for n in held})
    both = inside.join(ends, F.col(group).eqNullSafe(F.col("__g")) & F.col("__block").eqNullSafe(F.col("__b")), "left")
    out = both.withColumns({n: F.coalesce(f"__in_{n}", f"__carried_{n}")["v"] for n in held})
    return out.drop(*reduce(lambda names, n: names + [f"__own_{n}", f"__in_{n}", f"__carried_{n}"], held, ["__block", "__g", "__b"]))
