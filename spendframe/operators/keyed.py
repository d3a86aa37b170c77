"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str],
               also: Column | None = None, small: bool = False) -> DataFrame:
    """Left join on the keys; adds the other columns of ``facts``.

    The comparison is null-safe, so that rows without a key form a ledger of their
    own. The keys of ``facts`` are renamed first: both sides often stem from the
    same table, and equal column identities would make the condition vacuous.
    ``small`` broadcasts ``facts``; it is for tables of a fixed number of rows.
    """
    renamed = {key: f"_key{i}" for i, key in enumerate(keys)}
    right = facts.withColumnsRenamed(renamed)
    condition = reduce(
        lambda both, one: both & one,
        (F.col(f"`{key}`").eqNullSafe(F.col(new)) for key, new in renamed.items()),
    )
    if also is not None:
        condition = condition & also
    return rows.join(F.broadcast(right) if small else right, condition, "left").drop(
        *renamed.values()
    )


def attach(table: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add to one row per ledger the other columns of another such table.

    Nothing is broadcast by force; AQE does that when a side turns out small.
    Without keys both hold a single row and the second becomes a scalar subquery.
    """
    if keys:
        return keyed_join(table, facts, keys)
    row = facts.select(F.struct(*facts.columns)).scalar()
    return table.select("*", *[row.getField(name).alias(name) for name in facts.columns])


def maybe_sorted(df: DataFrame, ordered: bool | None, keys: Sequence[str], *order: object) -> DataFrame:
    """Sort if asked to; by default only results over a single ledger are sorted."""
    wanted = not keys if ordered is None else ordered
    return df.orderBy(*keys, *order) if wanted else df
