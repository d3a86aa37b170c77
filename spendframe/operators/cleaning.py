"""From a raw table to the canonical ledger ``keys, Date, Desc, Amt, Category``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.errors import MappingRequiredError
from spendframe.functions.taxonomy import OTHER, category
from spendframe.functions.values import (
    amount,
    currency_rank,
    description,
    known_or_null,
    strict_amount,
)
from spendframe.operators.roles import (
    explicit_roles,
    header_currency,
    infer_roles,
    matters,
    normal_header,
    share_column,
)


def nulls_at_read(df: DataFrame) -> DataFrame:
    """Missing-value spellings to null in all text columns."""
    return df.select(
        *[
            known_or_null(df[name]).alias(name) if kind == "string" else df[name]
            for name, kind in df.dtypes
        ]
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without rows in which every column is null."""
    return df.na.drop("all")


def filled_columns(df: DataFrame) -> list[str]:
    """Names of the columns that hold any value; one pass over the table."""
    counts = df.agg(*[F.count(F.col(f"`{name}`")).alias(f"c{i}") for i, name in
                      enumerate(df.columns)]).first()
    return [name for i, name in enumerate(df.columns) if counts[f"c{i}"]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns in which every row is null; runs one pass over the table."""
    return df.select(*[f"`{name}`" for name in filled_columns(df)])


def normalize_headers(df: DataFrame) -> DataFrame:
    """Headers stripped and in lower case; repeated ones get ``.1``, ``.2``."""
    names: list[str] = []
    for header in df.columns:
        name = plain = normal_header(header)
        count = 0
        while name in names:
            count += 1
            name = f"{plain}.{count}"
        names.append(name)
    return df.toDF(*names)


def _is_filled(df: DataFrame, slot: str) -> bool:
    # Stops at the first value found; only an empty column is read to its end.
    return bool(df.filter(F.col(slot).isNotNull()).select(slot).take(1))


def normalize(df: DataFrame, keys: Sequence[str] = (), mapping: Mapping[str, str] | None = None,
              share_mode: bool = False, drop_empty: bool = True) -> DataFrame:
    """Canonical ledger of a raw table, with ``CurrencyRank`` for the currency.

    ``keys`` are carried along and take no part in finding roles. Roles come from
    ``mapping`` or else from the headers. ``share_mode`` takes the amount from the
    first column named like a share that has no role, and fails on text that is no
    number; it has no effect with an explicit mapping.

    Rows and columns without any value take no part. Columns are probed only if
    their header matters, and each probe stops at the first value. For tables
    known to have neither, ``drop_empty=False`` spares the probes and lets scans
    leave out the columns that a query does not need.
    """
    keys = list(keys)
    headers = [name for name in df.columns if name not in keys]
    slots = [f"_c{i}" for i in range(len(headers))]
    # Positional names: headers may be equal but for letter case.
    raw = df.toDF(*[name if name in keys else slots[headers.index(name)] for name in df.columns])
    kinds = dict(raw.dtypes)
    clean = raw.select(
        *keys,
        *[
            known_or_null(F.col(slot)).alias(slot) if kinds[slot] == "string" else F.col(slot)
            for slot in slots
        ],
    )
    used = list(range(len(headers)))
    if drop_empty:
        clean = clean.na.drop("all", subset=slots)
        used = [i for i in used if not matters(headers[i]) or _is_filled(clean, slots[i])]
    names = [headers[i] for i in used]
    if mapping is not None:
        roles = explicit_roles(names, mapping)
    else:
        try:
            roles = infer_roles(names)
        except MappingRequiredError:
            filled = set(filled_columns(clean.select(*slots)))
            raise MappingRequiredError(
                [header for header, slot in zip(headers, slots) if slot in filled]
            ) from None
    column = {role: slots[used[index]] for role, index in roles.items()}

    source, amt = column["Amt"], None
    share = None
    if share_mode and mapping is None:
        share = share_column(["" if i in roles.values() else name for i, name in enumerate(names)])
    if share is not None:
        amt = strict_amount(F.col(slots[used[share]]).cast("string"))
    symbol = header_currency(names)
    projected: list[Column] = [F.col(key) for key in keys]
    if "Date" in column:
        projected.append(F.col(column["Date"]).alias("Date"))
    if "Desc" in column:
        projected.append(description(F.col(column["Desc"]).cast("string")).alias("Desc"))
    projected += [
        (_number(source, kinds[source]) if amt is None else amt).alias("Amt"),
        (
            currency_rank(F.col(source).cast("string")) if symbol is None else F.lit(symbol)
        ).alias("CurrencyRank"),
    ]
    return clean.select(*projected)


def _number(slot: str, kind: str) -> Column:
    if kind == "string":
        return amount(F.col(slot))
    value = F.col(slot).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value)


def categorize(df: DataFrame, taxonomy: Mapping[str, list[str]] | None = None,
               other: str = OTHER) -> DataFrame:
    """Add ``Category``; a table without descriptions stays as it is."""
    if "Desc" not in df.columns:
        return df
    chosen = category(F.col("Desc"), None if taxonomy is None else dict(taxonomy), other)
    return df.withColumn("Category", chosen)
