"""Listings of files and their texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.functions.text import (
    base_name,
    break_count,
    ends_with_break,
    extension,
    folder_name,
    plain_path,
)


#: Files that a complete listing hands to Spark at a time.
LISTED_AT_ONCE = 20_000


def _every_file(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    """Path, size and modification time of all files, by the file system's own iterator."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    schema = "path string, length bigint, modified_ms bigint"
    parts: list[DataFrame] = []
    rows: list[tuple[str, int, int]] = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(conf).listFiles(where, recursive)
        while found.hasNext():
            status = found.next()
            rows.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
            if len(rows) == LISTED_AT_ONCE:
                parts.append(spark.createDataFrame(rows, schema))
                rows = []
    listed = spark.createDataFrame(rows, schema)
    for part in parts:
        listed = part.unionByName(listed)
    return listed.select("path", "length", F.timestamp_millis("modified_ms").alias("modificationTime"))


def list_files(spark: SparkSession, path: str | list[str], recursive: bool = True,
               pattern: str | None = None, complete: bool = False) -> DataFrame:
    """Path, folder, name, lower-case extension, size and modification time.

    File contents are never read: they are pruned from the scan, which lists large trees
    on the executors but leaves out empty and hidden files and those that begin with an
    underscore. A ``complete`` listing has these too; the driver makes it, from folders
    named without patterns.
    """
    name = base_name(F.col("path"))
    if complete:
        files = _every_file(spark, [path] if isinstance(path, str) else list(path), recursive)
        if pattern:
            files = files.filter(name.rlike(_glob(pattern)))
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
        files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select(
        "path",
        folder_name(F.col("path")).alias("folder"),
        name.alias("name"),
        F.lower(extension(name)).alias("ext"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def _glob(pattern: str) -> str:
    """Stars and question marks of a file pattern as a regular expression."""
    return r"\A" + re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + r"\z"


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file with its whole text, invalid bytes replaced by U+FFFD."""
    return spark.read.text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_size").alias("length"),
        F.make_valid_utf8("value").alias("text"),
    )


def profile_text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Size, characters and lines per text file, without holding a file in one row.

    Files are split at newlines and the pieces counted by whichever task reads
    them. A file's size tells whether it ends in a newline: if it does, its size
    is that of the pieces plus one newline each, otherwise one less.
    """
    piece = F.make_valid_utf8("value")
    # A carriage return before the newline is part of the same line end.
    inner = break_count(F.regexp_replace(piece, r"\r\z", ""))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    pieces = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        F.length(piece).cast("bigint").alias("chars"),
        F.octet_length(F.col("value").cast("binary")).cast("bigint").alias("bytes"),
        (inner + 1).cast("bigint").alias("lines"),
        (ends_with_break(piece) & ~piece.endswith("\r")).alias("broken"),
        place.alias("place"),
    )
    files = pieces.groupBy("path", "length").agg(
        F.sum("chars").alias("chars"),
        F.sum("bytes").alias("bytes"),
        F.sum("lines").alias("lines"),
        F.count(F.lit(1)).alias("pieces"),
        F.max_by("broken", "place").alias("broken"),
    )
    unfinished = F.col("bytes") + F.col("pieces") > F.col("length")
    return files.select(
        plain_path(F.col("path")).alias("path"),
        "length",
        (F.col("chars") + F.col("pieces") - unfinished.cast("int")).alias("chars"),
        # A last piece that ends in another kind of break starts no line of its own.
        (F.col("lines") - (unfinished & F.col("broken")).cast("int")).alias("lines"),
    )
