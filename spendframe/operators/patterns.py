"""Recurring charges, habits and unusually high transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.operators.keyed import keyed_join, maybe_sorted

# The largest ledgers, which get their limit by broadcast: a fixed number of rows.
LARGE_LEDGERS = 1000
# Slots of the coarse lower bounds, also broadcast: a fixed number of rows, a power of two.
BOUND_SLOTS = 65536


def recurring_charges(df: DataFrame, keys: Sequence[str] = (), at_least: int = 2,
                      ordered: bool | None = None) -> DataFrame:
    """Same description and amount at least twice."""
    repeats = (
        df.groupBy(*keys, "Desc", "Amt")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= at_least)
    )
    return maybe_sorted(repeats, ordered, keys, "Desc", "Amt")


def habits(df: DataFrame, keys: Sequence[str] = (), at_least: int = 3,
           ordered: bool | None = None) -> DataFrame:
    """Descriptions seen at least three times, with count and mean amount."""
    frequent = (
        df.groupBy(*keys, "Desc")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("Amt").alias("mean"))
        .filter(F.col("count") >= at_least)
    )
    return maybe_sorted(frequent, ordered, keys, "Desc")


def first_habit(df: DataFrame, keys: Sequence[str] = (), at_least: int = 3) -> DataFrame:
    """The alphabetically first habit of each ledger that has any."""
    return (
        habits(df, keys, at_least, ordered=False).groupBy(*keys).agg(F.min("Desc").alias("habit"))
    )


def _limit(sigmas: float) -> Column:
    # A single row has no deviation and so no limit.
    return F.when(
        F.count(F.lit(1)) > 1, F.avg("Amt") + sigmas * F.stddev_samp("Amt")
    )


def anomalies(df: DataFrame, keys: Sequence[str] = (), sigmas: float = 2.5,
              limits: DataFrame | None = None) -> DataFrame:
    """All rows above mean + 2.5 sample deviations of their ledger.

    ``limits`` (the keys, ``_limit`` and ``_rows``) are computed here unless given.

    The limits need one pass; comparing the rows with them is a join on the
    ledger, whose cost would be a shuffle of every row with one large ledger in
    one task. Two broadcasts of a fixed number of rows prevent that:

    * the LARGE_LEDGERS largest ledgers get their exact limit by broadcast, so
      their rows are settled in the scan;
    * every other ledger falls into one of BOUND_SLOTS slots, whose smallest
      limit rules out most rows in the scan.

    Only rows that pass their slot's bound are shuffled and compared with the
    exact limit. Already settled rows ride along under a salt of their own.
    """
    keys = list(keys)
    if limits is None:
        limits = df.groupBy(*keys).agg(
            _limit(sigmas).alias("_limit"), F.count(F.lit(1)).alias("_rows")
        )
    if not keys:
        return df.filter(F.col("Amt") > limits.select("_limit").scalar())

    def slot() -> Column:
        # Never null, so the join puts no filter on this side and Spark can compute
        # the limits once for all three uses.
        return F.xxhash64(*keys).bitwiseAND(BOUND_SLOTS - 1)

    large = limits.orderBy(F.desc("_rows"), *keys).limit(LARGE_LEDGERS).select(
        *keys, F.col("_limit").alias("_known"), F.lit(True).alias("_large")
    )
    bounds = limits.groupBy(slot().alias("_slot")).agg(F.min("_limit").alias("_bound"))

    rows = keyed_join(df.withColumn("_slot", slot()), large, keys, small=True)
    rows = rows.join(F.broadcast(bounds), "_slot", "left").filter(
        F.when(F.col("_large"), F.col("Amt") > F.col("_known")).otherwise(
            F.col("Amt") > F.col("_bound")
        )
    )
    salt = F.when(F.col("_large"), F.pmod(F.xxhash64(*df.columns), F.lit(997)) + 1)
    rows = rows.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    exact = limits.select(
        *keys, F.col("_limit").alias("_exact"), F.lit(0).cast("bigint").alias("_unsalted")
    )
    return (
        keyed_join(rows, exact, keys, also=F.col("_salt") == F.col("_unsalted"))
        .filter(F.coalesce(F.col("_large"), F.col("Amt") > F.col("_exact")))
        .select(*[f"`{name}`" for name in df.columns])
    )


def anomaly_counts(df: DataFrame, keys: Sequence[str] = (), sigmas: float = 2.5,
                   limits: DataFrame | None = None) -> DataFrame:
    """Number of anomalies per ledger; ledgers without any are absent when keyed."""
    return (
        anomalies(df.select(*keys, "Amt"), keys, sigmas, limits)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("anomalies"))
    )
