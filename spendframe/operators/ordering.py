"""Row numbers within large groups, without gathering a group in one task.

A window over a whole group puts that group into one task. Here the group is cut
into slices by value, the slices are counted (with map-side combine), the counts
are summed up, and each row is numbered within its slice. A slice is all that
one task ever holds, and the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def block_of(position: Column, block: int = BLOCK) -> Column:
    return F.floor(position / block)


def number_rows(df: DataFrame, keys: Sequence[str], position: str, block: int = BLOCK,
                facts: DataFrame | None = None) -> DataFrame:
    """Add ``seq``, 1, 2, ... by an integer position, and ``total``, the rows of the group.

    Positions may have gaps but not repeat within a group; a block of them is
    then at most ``block`` rows. ``facts`` has the keys and more columns, which are
    added too; a group without facts is left out, one with several repeats. They
    reach the rows by way of the slices, so a large group is no hot join key.
    """
    keys = list(keys)
    rows = df.withColumn("_block", block_of(F.col(position), block))
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_block",
        (F.sum("_rows").over(group.orderBy("_block")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(group).alias("total"),
    )
    added: list[str] = []
    if facts is not None:
        added = [name for name in facts.columns if name not in keys]
        offsets = offsets.join(facts, keys)
    # A struct is never null, so rows with a null key keep their group in the join.
    slices = offsets.select(F.struct(*keys, "_block").alias("_slice"), "_before", "total", *added)
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(position))
    return (
        rows.withColumn("_slice", F.struct(*keys, "_block"))
        .withColumn("_within", within)
        .join(slices, "_slice")
        .withColumn("seq", F.col("_before") + F.col("_within"))
        .select(*df.columns, "seq", "total", *added)
    )


def with_group_facts(df: DataFrame, key: str, spread: Column, facts: DataFrame,
                     slots: int = 1024) -> DataFrame:
    """Add to each row the facts of its group, with large groups spread over slots.

    ``facts`` has one row per group. It is joined to the slots that a group has
    rows in, and the rows are joined by group and slot, so the rows of a large
    group go to many tasks.
    """
    rows = df.withColumn("_slice", F.struct(key, F.pmod(F.xxhash64(spread), F.lit(slots)).alias("_slot")))
    right = facts.select(
        F.struct(key).alias("_group"), *[name for name in facts.columns if name != key]
    )
    slices = (
        rows.select("_slice")
        .distinct()
        .withColumn("_group", F.struct(F.col(f"_slice.{key}").alias(key)))
        .join(right, "_group")
        .drop("_group")
    )
    return rows.join(slices, "_slice").drop("_slice")


def sums_before(df: DataFrame, keys: Sequence[str], position: str, value: str, out: str,
                block: int = BLOCK) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group at smaller positions."""
    keys = list(keys)
    rows = df.withColumn("_block", block_of(F.col(position), block))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_sum")
    offsets = sums.select(F.struct(*keys, "_block").alias("_slice"), ahead.alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_slice").orderBy(position)) - F.col(value)
    return (
        rows.withColumn("_slice", F.struct(*keys, "_block"))
        .join(offsets, "_slice")
        .withColumn(out, F.col("_before") + within)
        .select(*df.columns, out)
    )
