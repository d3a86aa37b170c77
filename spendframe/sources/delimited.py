"""Delimited text of unknown separator and encoding, as all-string DataFrames.

Files are grouped by layout (encoding, separator, header, quoted line breaks); each
layout is one Spark scan. Finding the layouts reads every file once, since a file counts
as UTF-8 only if all of it is. Files that cannot be read as a table are listed with a
reason and stop no other file.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendframe.functions.text import plain_path

SOURCE = "source_file"
_EXTRA = "_extra_field"
# Bytes without a character in code page 1252.
_UNDEFINED_1252 = ["81", "8D", "8F", "90", "9D"]
_BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Layout:
    """What must be known to read a set of files in one scan."""

    encoding: str  # utf-8, cp1252 or latin1
    separator: str
    headers: tuple[str, ...]
    #: Plain paths, as ``source_file`` shows them.
    files: tuple[str, ...]
    #: Some row has a line break in quotes, so the files cannot be split at line breaks.
    multi_line: bool = False
    #: The paths as the caller gave them, if they hold these files and no others.
    given: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reject:
    """A file that gives no rows, and why."""

    source_file: str
    reason: str
    headers: tuple[str, ...] = ()


NO_TEXT, NO_SEPARATOR, NO_ROWS = "no text", "no separator in the header", "a header without rows"


def guess_separator(header_line: str) -> str:
    """Separator of a header line; raises ValueError if none can be made out.

    A bar wins where no comma, tab or semicolon occurs, since a blank inside a
    header would otherwise be taken for the separator. A letter or digit is none.
    """
    if "|" in header_line and not any(mark in header_line for mark in ",\t;"):
        return "|"
    try:
        found = csv.Sniffer().sniff(header_line).delimiter
    except csv.Error:
        found = ""
    if not found or found.isalnum():
        raise ValueError(f"No separator found in header {header_line!r}")
    return found


def header_names(header_line: str, separator: str) -> list[str]:
    """Header fields; blank ones become ``Unnamed: i``, repeated ones get ``.1``, ``.2``."""
    fields = next(csv.reader([header_line], delimiter=separator))
    seen: dict[str, int] = defaultdict(int)
    names = []
    for index, field in enumerate(fields):
        name = plain = field if field != "" else f"Unnamed: {index}"
        while name in names:
            seen[plain] += 1
            name = f"{plain}.{seen[plain]}"
        names.append(name)
    return names


def survey(spark: SparkSession, paths: str | list[str], encoding: str | None = None,
           separator: str | None = None) -> tuple[list[Layout], list[Reject]]:
    """Layouts of the given files, and the files that have none, by one distributed pass.

    The pass keeps one row per file (is it UTF-8, does a line have an odd number of
    quotes, how many lines it has, its first one); those rows come to the driver, which
    lists the same files anyway to plan a scan. A known ``encoding`` or ``separator`` is
    not looked for. A header is taken to be one line.
    """
    raw = F.col("value").cast("binary")
    undefined = F.lit(False)
    for byte in _UNDEFINED_1252:
        undefined = undefined | F.contains(raw, F.unhex(F.lit(byte)))
    utf8 = F.is_valid_utf8("value") if encoding is None else F.lit(True)
    filled = F.trim(F.col("value")) != ""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    files = (
        spark.read.text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            utf8.alias("utf8"),
            (~utf8 & undefined).alias("undefined"),
            F.when(filled, raw).alias("line"),
            (quotes % 2 == 1).alias("odd"),
            place.alias("place"),
        )
        .groupBy("file")
        .agg(
            F.bool_and("utf8").alias("utf8"),
            F.bool_or("undefined").alias("undefined"),
            F.min_by("line", F.when(F.col("line").isNotNull(), F.col("place"))).alias("line"),
            F.count("line").alias("lines"),
            F.bool_or("odd").alias("odd"),
        )
    )
    groups: dict[tuple, list[str]] = defaultdict(list)
    rejects: list[Reject] = []
    for row in files.toLocalIterator():
        found = encoding or ("utf-8" if row["utf8"] else "latin1" if row["undefined"] else "cp1252")
        line = _decode(bytes(row["line"] or b""), found)
        if not line.strip():
            rejects.append(Reject(plain(row["file"]), NO_TEXT))
            continue
        try:
            mark = separator or guess_separator(line)
        except ValueError:
            rejects.append(Reject(plain(row["file"]), NO_SEPARATOR, (line,)))
            continue
        if row["lines"] == 1:
            rejects.append(Reject(plain(row["file"]), NO_ROWS, tuple(header_names(line, mark))))
            continue
        groups[(found, mark, line, row["odd"])].append(plain(row["file"]))
    # The usual case: Spark lists the files by itself, from the paths as given. Files
    # without text or rows do no harm there.
    alone = len(groups) == 1 and all(one.reason != NO_SEPARATOR for one in rejects)
    given = () if not alone else (paths,) if isinstance(paths, str) else tuple(paths)
    layouts = [
        Layout(found, mark, tuple(header_names(line, mark)), tuple(sorted(members)), odd, given)
        for (found, mark, line, odd), members in sorted(groups.items())
    ]
    return layouts, sorted(rejects, key=lambda one: one.source_file)


def find_layouts(spark: SparkSession, paths: str | list[str]) -> list[Layout]:
    """Layout groups of the given files; a ValueError if none of them can be read."""
    layouts, rejects = survey(spark, paths)
    if not layouts:
        raise unreadable(rejects)
    return layouts


def unreadable(rejects: list[Reject]) -> ValueError:
    reasons = "; ".join(f"{one.source_file}: {one.reason}" for one in rejects[:3]) or "no file with any text"
    return ValueError(f"Nothing to read ({reasons})")


def plain(path: str) -> str:
    """A path from file metadata, which is URL-encoded, as ``source_file`` shows it."""
    return unquote(re.sub(r"\Afile:/+", "file:///", path))


def _literal(path: str) -> str:
    """A plain path with the characters of a path pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def known_layout(spark: SparkSession, paths: str | list[str], encoding: str,
                 separator: str | None = None, multi_line: bool = False) -> Layout:
    """Layout of files that are known to share an encoding and a header; reads one line of one file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).filter(F.trim(F.col("value")) != "")
    first = lines.select(F.col("value").cast("binary").alias("line")).take(1)
    if not first:
        raise unreadable([])
    line = _decode(bytes(first[0]["line"]), encoding)
    separator = separator or guess_separator(line)
    return Layout(encoding, separator, tuple(header_names(line, separator)), (), multi_line, tuple(paths))


def _decode(line: bytes, encoding: str) -> str:
    return line.removeprefix(_BOM).decode(encoding, errors="replace").rstrip("\r\n")


def read_layout(spark: SparkSession, layout: Layout, multi_line: bool = False) -> DataFrame:
    """All files of a layout: its headers as string columns, plus ``source_file``.

    A row with too few fields is filled up with nulls, a row with too many is
    left out. One more column than the header has shows which rows are too long.
    Columns are named by position inside the scan, so headers that differ only in
    letter case do not collide before the caller has picked its columns.
    """
    slots = [f"_c{index}" for index in range(len(layout.headers))]
    schema = T.StructType([T.StructField(slot, T.StringType()) for slot in [*slots, _EXTRA]])
    scan = spark.read.csv(
        list(layout.given) or [_literal(path) for path in layout.files],
        schema=schema,
        sep=layout.separator,
        header=True,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        enforceSchema=True,
        multiLine=multi_line or layout.multi_line,
        encoding="UTF-8" if layout.encoding.startswith("utf") else "ISO-8859-1",
    )
    text = _from_1252 if layout.encoding == "cp1252" else (lambda column: column)
    return scan.filter(F.col(_EXTRA).isNull()).select(
        *[text(F.col(slot)).alias(name) for slot, name in zip(slots, layout.headers)],
        plain_path(F.col("_metadata.file_path")).alias(SOURCE),
    )


def _from_1252(column: Column) -> Column:
    """Give bytes 80-9F, read as Latin-1, their characters of code page 1252."""
    codes = [code for code in range(0x80, 0xA0) if f"{code:02X}" not in _UNDEFINED_1252]
    latin = "".join(map(chr, codes))
    return F.translate(column, latin, bytes(codes).decode("cp1252"))


def read_delimited(spark: SparkSession, paths: str | list[str], encoding: str | None = None,
                   separator: str | None = None, multi_line: bool = False,
                   same_header: bool = False) -> list[DataFrame]:
    """One DataFrame per layout found.

    With ``same_header`` (and an ``encoding``) all files are taken to have the header of
    one of them, and no pass is made to look at the others.
    """
    if same_header and encoding is not None:
        layouts = [known_layout(spark, paths, encoding, separator)]
    else:
        layouts, rejects = survey(spark, paths, encoding, separator)
        if not layouts:
            raise unreadable(rejects)
    return [read_layout(spark, layout, multi_line) for layout in layouts]
