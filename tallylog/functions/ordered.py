"""Neighbours and running sums over long ordered groups, without a task per group.

A group (one server's log, say) may hold a large part of all rows, so its order is cut into blocks of
``block`` order values.  Windows run within (group, block), and one row per block is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values (line numbers) in a block.
BLOCK = 100_000


def _same(group: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(prefix + c))
    return on


def with_neighbours(
    df: DataFrame, group: list[str], order: str, values: dict[str, tuple[Column, int]], block: int = BLOCK
) -> DataFrame:
    """Add columns taken from rows before (negative offset) or after (positive) in the group's order.

    ``values`` maps a new name to (expression, offset).  Rows without such a neighbour get null.  ``order`` is a
    whole number, distinct within the group; a null order comes first.
    """
    reach = max(abs(offset) for _, offset in values.values())
    marked = df.withColumns({f"__in_{name}": expr for name, (expr, _) in values.items()})
    marked = marked.withColumn("__block", F.expr(f"{order} div {block}"))
    inputs = [f"__in_{name}" for name in values]
    packed = F.struct(F.col(order).alias("o"), *inputs)
    own = Window.partitionBy(*group, "__block").orderBy(F.col(order).asc_nulls_first())
    back = Window.partitionBy(*group, "__block").orderBy(F.col(order).desc_nulls_last())
    ranked = marked.withColumn("__row", F.row_number().over(own))
    # only the ``reach`` first and last rows of each block meet the other blocks
    edges = ranked.withColumn("__rev", F.row_number().over(back)).where((F.col("__row") <= reach) | (F.col("__rev") <= reach))
    ends = edges.groupBy(*group, "__block").agg(
        F.array_sort(F.collect_list(F.when(F.col("__row") <= reach, packed))).alias("heads"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("__rev") <= reach, packed)))).alias("tails"),
        F.count("*").alias("n"),
    )
    blocks = Window.partitionBy(*group).orderBy(F.col("__block").asc_nulls_first())
    # a block may hold fewer rows than the reach, so up to ``reach`` blocks on each side are put together
    before = [F.coalesce(F.lag("tails", i).over(blocks), F.array()) for i in range(1, reach + 1)]
    after = [F.coalesce(F.lead("heads", i).over(blocks), F.array()) for i in range(1, reach + 1)]
    around = ends.select(
        *[F.col(c).alias(f"__g_{c}") for c in group],
        F.col("__block").alias("__b"),
        F.concat(*before).alias("__prev_rows"),
        F.concat(*after).alias("__next_rows"),
    )
    joined = ranked.join(around, _same(group, "__g_") & F.col("__block").eqNullSafe(F.col("__b")))
    size = F.count("*").over(Window.partitionBy(*group, "__block"))
    joined = joined.withColumn("__size", size)
    out = {}
    for name, (_, offset) in values.items():
        if offset < 0:
            far = F.get("__prev_rows", F.lit(-offset) - F.col("__row"))[f"__in_{name}"]
            out[name] = F.when(F.col("__row") > -offset, F.lag(f"__in_{name}", -offset).over(own)).otherwise(far)
        else:
            far = F.get("__next_rows", F.lit(offset) - (F.col("__size") - F.col("__row")) - 1)[f"__in_{name}"]
            out[name] = F.when(F.col("__row") + offset <= F.col("__size"), F.lead(f"__in_{name}", offset).over(own)).otherwise(far)
    return joined.withColumns(out).select(*df.columns, *values)


def with_running_sum(df: DataFrame, group: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Add the inclusive running sum of ``value`` in the group's order."""
    marked = df.withColumn("__value", value).withColumn("__block", F.expr(f"{order} div {block}"))
    sums = marked.groupBy(*group, "__block").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy(F.col("__block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"__g_{c}") for c in group], F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset")
    )
    own = Window.partitionBy(*group, "__block").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.join(offsets, _same(group, "__g_") & F.col("__block").eqNullSafe(F.col("__b")))
    return joined.withColumn(name, F.col("__offset") + F.sum("__value").over(own)).select(*df.columns, name)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in an order; Spark keeps ``n`` rows per task."""
    return df.orderBy(*order).limit(n)
