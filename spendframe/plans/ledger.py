"""Loading ledgers from files and analysing them."""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from spendframe.errors import MappingRequiredError
from spendframe.operators.cleaning import categorize, normalize, nulls_at_read
from spendframe.operators.roles import summary_columns
from spendframe.operators.totals import summarize
from spendframe.sources.delimited import (
    SOURCE, Layout, Reject, known_layout, plain, read_delimited, read_layout, survey, unreadable,
)

#: A mapping for all files, or a table of them: source_file, date, desc, amt.
Mappings = Mapping[str, str] | DataFrame | None


@dataclass(frozen=True)
class Loaded:
    """The ledger of the files that could be loaded, and a table of those that could not.

    ``rejects`` has source_file, reason and the headers found.
    """

    ledger: DataFrame
    rejects: DataFrame


NO_ROLES = "date, description or amount not found among the headers"


def _given(mapping: Mappings) -> dict[str, dict[str, str]]:
    """The rows of a mapping table by file; one small row for each, as the layouts have."""
    rows = mapping.toLocalIterator() if isinstance(mapping, DataFrame) else ()
    return {plain(row[SOURCE]): {name: value for name, value in row.asDict().items() if name != SOURCE and value} for row in rows}


def _by_mapping(layout: Layout, mapping: Mappings,
                given: dict[str, dict[str, str]]) -> Iterator[tuple[Layout, Mapping[str, str] | None]]:
    """The layout with its mapping, in parts where a table has different ones for its files."""
    if not isinstance(mapping, DataFrame):
        yield layout, mapping
        return
    parts: dict[tuple, list[str]] = defaultdict(list)
    for file in layout.files:
        parts[tuple(sorted(given.get(file, {}).items()))].append(file)
    for row, files in sorted(parts.items()):
        yield replace(layout, files=tuple(files), given=() if len(parts) > 1 else layout.given), dict(row) or None


def load(spark: SparkSession, paths: str | list[str], mapping: Mappings = None, share_mode: bool = False,
         taxonomy: Mapping[str, list[str]] | None = None, encoding: str | None = None,
         separator: str | None = None, multi_line: bool = False, same_header: bool = False) -> Loaded:
    """Canonical, categorised ledger of all files that can be read; ``source_file`` tells them apart.

    Files with different headers, separators or encodings may be mixed: each layout finds
    its own roles, and a mapping table gives files roles of their own. A file without
    text, separator or rows, or whose roles cannot be found, is listed and stops no other
    one. If no file at all can be loaded, the first problem is raised.
    """
    if same_header and encoding is not None and not isinstance(mapping, DataFrame):
        layouts, rejects = [known_layout(spark, paths, encoding, separator)], []
    else:
        layouts, rejects = survey(spark, paths, encoding, separator)
    given = _given(mapping)
    parts, problem = [], None
    for layout in layouts:
        for part, roles in _by_mapping(layout, mapping, given):
            try:
                parts.append(normalize(read_layout(spark, part, multi_line), [SOURCE], roles, share_mode))
            except (MappingRequiredError, ValueError) as found:
                problem = problem or found
                headers = tuple(found.columns) if isinstance(found, MappingRequiredError) else part.headers
                reason = NO_ROLES if isinstance(found, MappingRequiredError) else str(found)
                rejects += [Reject(file, reason, headers) for file in part.files or part.given]
    if not parts:
        raise problem or unreadable(rejects)
    ledger = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
    listed = spark.createDataFrame(
        sorted((one.source_file, one.reason, list(one.headers)) for one in rejects),
        f"{SOURCE} string, reason string, headers array<string>")
    return Loaded(categorize(ledger, taxonomy), listed)


def load_ledgers(spark: SparkSession, paths: str | list[str], mapping: Mappings = None, share_mode: bool = False,
                 taxonomy: Mapping[str, list[str]] | None = None, encoding: str | None = None,
                 separator: str | None = None, multi_line: bool = False, same_header: bool = False) -> DataFrame:
    """The ledger of :func:`load`; warns of files left out, and raises a ValueError without any row."""
    loaded = load(spark, paths, mapping, share_mode, taxonomy, encoding, separator, multi_line, same_header)
    if loaded.ledger.isEmpty():
        raise ValueError("No row is left after empty ones are dropped")
    left_out = loaded.rejects.limit(4).collect()
    if left_out:
        first = "; ".join(f"{row[SOURCE]}: {row['reason']}" for row in left_out[:3])
        warnings.warn(f"Files left out ({first}{' and more' if len(left_out) > 3 else ''}); see load(...).rejects", stacklevel=2)
    return loaded.ledger


def load_table(df: DataFrame, keys: Sequence[str] = (),
               mapping: Mapping[str, str] | None = None, share_mode: bool = False,
               taxonomy: Mapping[str, list[str]] | None = None,
               drop_empty: bool = True) -> DataFrame:
    """The same for a table that Spark has already, such as Parquet."""
    return categorize(normalize(df, keys, mapping, share_mode, drop_empty), taxonomy)


def summarize_files(spark: SparkSession, paths: str | list[str],
                    separator: str | None = None) -> DataFrame:
    """Sum per raw category over Latin-1 files; each header is looked at by itself."""
    parts = []
    for raw in read_delimited(spark, paths, encoding="latin1", separator=separator):
        raw = nulls_at_read(raw.drop(SOURCE))
        category, value = summary_columns(raw.columns)
        slots = raw.toDF(*_slots(raw))
        parts.append(slots.select(slots[f"_c{category}"].alias("category"), slots[f"_c{value}"].alias("value")))
    return summarize(reduce(DataFrame.union, parts), "category", "value")


def summarize_table(df: DataFrame) -> DataFrame:
    """The same for a table that Spark has already."""
    category, value = summary_columns(df.columns)
    return summarize(nulls_at_read(df).toDF(*_slots(df)), f"_c{category}", f"_c{value}")


def _slots(df: DataFrame) -> list[str]:
    return [f"_c{i}" for i in range(len(df.columns))]
