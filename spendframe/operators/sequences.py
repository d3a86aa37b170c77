"""Ordered page sequences and the lines and blocks of texts.

A sequence is a table of ``doc``, ``pos`` and anything else, here named by the
arguments; positions are integers that do not repeat within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendframe.functions.text import lines, markdown_blocks, stem
from spendframe.operators.ordering import block_of, number_rows, sums_before, with_group_facts


def line_table(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line, numbered from 0; happens inside each row, without a shuffle."""
    return df.select(doc, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def block_table(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Headings, bullets and paragraphs of Markdown texts, numbered from 0 without blank lines."""
    blocks = df.select(
        doc, F.posexplode(markdown_blocks(F.col(text))).alias("block_no", "_block")
    )
    return blocks.select(doc, "block_no", "_block.kind", "_block.level", "_block.text")


def item_counts(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    return df.groupBy(doc).agg(F.count(F.lit(1)).alias("items"))


def join_text(df: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text",
              separator: str = "\n", block: int = 1024) -> DataFrame:
    """One text per document, its parts in order.

    Blocks of positions are joined first, so a long document is sorted and
    concatenated by many tasks and only whole blocks meet at the end. A document
    too large for one value is for :func:`write_packed_text`.
    """
    blocks = (
        df.withColumn("_block", block_of(F.col(pos), block))
        .groupBy(doc, "_block")
        .agg(_in_order(text, separator, pos))
    )
    return blocks.groupBy(doc).agg(_in_order(text, separator, "_block"))


def _in_order(text: str, separator: str, order: str) -> Column:
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(
        f"listagg(`{text}`, '{quoted}') WITHIN GROUP (ORDER BY `{order}`)"
    ).alias(text)


def write_joined_text(df: DataFrame, path: str, doc: str = "doc_id", pos: str = "pos",
                      text: str = "text") -> None:
    """Write each document's parts in order, newline-joined, to a folder of its own.

    The files of a folder, in the order of their names, are the document. Range
    partitioning lets a large document span many tasks. A folder for each document
    is for some thousands of them; :func:`write_packed_text` is for more.
    """
    (
        df.select(doc, pos, text)
        .repartitionByRange(doc, pos)
        .sortWithinPartitions(doc, pos)
        .select(doc, text)
        .write.mode("overwrite")
        .partitionBy(doc)
        .text(path)
    )


def _packed_blocks(parts: DataFrame, doc: str, pos: str, text: str, buckets: int, file_bytes: int,
                   block: int) -> DataFrame:
    """File, place in the file and extent of each block of positions of each document.

    Documents fall into buckets by a digest. A bucket's blocks stand one after another
    by document and position, and a new file begins at the first block past each
    multiple of ``file_bytes``.
    """
    size = F.octet_length(text) + 1
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    blocks = parts.withColumn("_block", block_of(F.col(pos), block)).groupBy(doc, "_block").agg(
        F.sum(size).alias("_bytes"), F.sum(breaks + 1).alias("_lines"), F.count(F.lit(1)).alias("parts"), F.min(pos).alias("first"), F.max(pos).alias("last"))
    bucket = F.pmod(F.xxhash64(doc), F.lit(buckets))
    ordered = Window.partitionBy("_bucket").orderBy(doc, "_block")
    file = Window.partitionBy("file")
    return (
        blocks.withColumn("_bucket", bucket)
        .withColumn("_before", F.sum("_bytes").over(ordered) - F.col("_bytes"))
        .withColumn("_above", F.sum("_lines").over(ordered) - F.col("_lines"))
        .withColumn("file", F.shiftleft("_bucket", 32) + F.floor(F.col("_before") / file_bytes))
        .withColumn("_at", F.col("_before") - F.min("_before").over(file))
        .withColumn("_line", F.col("_above") - F.min("_above").over(file))
    )


def write_packed_text(df: DataFrame, path: str, doc: str = "doc_id", pos: str = "pos", text: str = "text",
                      file_bytes: int = 1 << 26, block: int = 1024) -> None:
    """Write each document's parts in order, newline-joined, into files of about ``file_bytes``.

    A file holds many documents and a large document spans files, so neither their
    number nor their size is bounded. ``path/text`` has the files and ``path/manifest``
    a row for each document and file: the byte and the line where it begins, its bytes,
    lines and parts, and their first and last position. A document's files are numbered in its order. Which file a
    part goes to follows from the data alone, so a repeated task writes the same again.
    A file exceeds ``file_bytes`` by one block of ``block`` positions at most. Each
    part ends in a newline; null parts are left out, as in :func:`join_text`.
    """
    parts = df.select(doc, pos, text).filter(F.col(text).isNotNull())
    total = parts.agg(F.sum(F.octet_length(text) + 1).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // file_bytes))
    blocks = _packed_blocks(parts, doc, pos, text, buckets, file_bytes, block)
    files = blocks.select(F.struct(doc, "_block").alias("_slice"), "file")
    (
        parts.withColumn("_slice", F.struct(doc, block_of(F.col(pos), block).alias("_block")))
        .join(files, "_slice")
        .repartition(int(max(1, min(2 * buckets, 100_000))), "file")
        .sortWithinPartitions("file", doc, pos)
        .select("file", text)
        .write.mode("overwrite").partitionBy("file").text(f"{path}/text")
    )
    (
        blocks.groupBy(doc, "file")
        .agg(F.min("_at").alias("at"), F.sum("_bytes").alias("bytes"), F.min("_line").alias("line"),
             F.sum("_lines").alias("lines"), F.sum("parts").alias("parts"), F.min("first").alias("first"), F.max("last").alias("last"))
        .repartitionByRange(doc)
        .sortWithinPartitions(doc, "file")
        .write.mode("overwrite").parquet(f"{path}/manifest")
    )


def read_packed_text(spark: SparkSession, path: str, wanted: DataFrame | None = None,
                     doc: str = "doc_id") -> DataFrame:
    """The pieces of documents written by :func:`write_packed_text`: doc, file, first, last, text.

    A document's pieces, in the order of ``file`` and without anything between them,
    are its text with a last newline. ``wanted`` has the documents to read; without it
    all are. Only files that hold one of them are joined to the manifest.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    if wanted is not None:
        manifest = manifest.join(wanted.select(doc).distinct(), doc, "left_semi")
    place = F.struct(F.col(doc), F.col("first"), F.col("last"), (F.col("line") + F.col("lines")).alias("end"))
    starts = manifest.select("file", F.col("line").alias("_line"), F.lit(None).cast("string").alias("_text"), place.alias("_place"))
    number = F.regexp_extract("path", r"/file=(-?\d+)/[^/]*$", 1).cast("bigint")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
        .load(f"{path}/text").select(number.alias("file"), F.decode("content", "utf-8").alias("_whole"))
        .join(manifest.select("file").distinct(), "file", "left_semi")
    )
    every = files.select("file", F.posexplode(F.split("_whole", "\n")).alias("_line", "_text"))
    marked = every.select("file", F.col("_line").cast("bigint").alias("_line"), "_text").unionByName(starts, allowMissingColumns=True)
    # A file is of bounded size, and so is the window over it.
    so_far = Window.partitionBy("file").orderBy("_line", F.col("_text").isNotNull())
    return (
        marked.withColumn("_place", F.last("_place", ignorenulls=True).over(so_far))
        .filter(F.col("_text").isNotNull() & (F.col("_line") < F.col("_place.end")))
        .groupBy("file", "_place")
        .agg(_in_order("_text", "\n", "_line"))
        .select(f"_place.{doc}", "file", "_place.first", "_place.last", F.concat("_text", F.lit("\n")).alias("text"))
    )


def merge(df: DataFrame, order: DataFrame, group: str = "merge_id", rank: str = "rank",
          doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Join documents end to end in the given order and renumber their items from 1.

    ``order`` has one row per merge group and document, with an integer rank.
    Every group must name at least two documents; the query fails otherwise.
    A document's items get their place from its own count of items plus the
    counts of the documents before it, so neither a long document nor a group of
    many documents is gathered anywhere.
    """
    sizes = df.groupBy(doc).agg(F.count(F.lit(1)).alias("_size"))
    members = order.select(group, rank, doc).join(sizes, doc, "left").fillna(0, ["_size"])
    placed = sums_before(members, [group], rank, "_size", "_start")
    named = order.groupBy(group).agg(F.count(F.lit(1)).alias("_documents"))
    start = F.when(F.col("_documents") >= 2, F.col("_start")).otherwise(
        F.raise_error(F.lit("At least 2 documents are required for merging")).cast("bigint")
    )
    starts = with_group_facts(placed, group, F.col(rank), named).select(
        doc, group, start.alias("_start")
    )
    return number_rows(df, [doc], pos, facts=starts).select(
        group, (F.col("_start") + F.col("seq")).alias("new_pos"), *df.columns
    )


def merged_names(order: DataFrame, name: str, group: str = "merge_id", rank: str = "rank",
                 suffix: str = ".pdf") -> DataFrame:
    """Name of each merged document, made from its first member's name."""
    first = F.min_by(name, rank)
    return order.groupBy(group).agg(
        F.concat(F.lit("merged_"), stem(first), F.lit(suffix)).alias("name")
    )


def split(df: DataFrame, at: int | str | Column | None = None, doc: str = "doc_id",
          pos: str = "pos") -> DataFrame:
    """Cut each document of n items in two: 1..s-1 and s..n.

    ``at`` is s, as a number or a column; none or below 1 means (n + 1) div 2 and
    above n means n. Adds ``part``, ``part_pos`` from 1, ``split_at`` and ``total``.
    """
    if at is None:
        wanted = F.lit(None).cast("bigint")
    elif isinstance(at, Column):
        wanted = at
    else:
        wanted = F.col(at) if isinstance(at, str) else F.lit(at)
    total = F.col("total")
    middle = F.floor((total + 1) / 2)
    cut = F.least(F.when(wanted >= 1, wanted.cast("bigint")).otherwise(middle), total)
    return (
        number_rows(df, [doc], pos)
        .withColumn("split_at", cut)
        .withColumn("part", F.when(F.col("seq") < F.col("split_at"), 1).otherwise(2))
        .withColumn(
            "part_pos",
            F.when(F.col("part") == 1, F.col("seq")).otherwise(
                F.col("seq") - F.col("split_at") + 1
            ),
        )
        .select(*df.columns, "part", "part_pos", "split_at", "total")
    )


def split_name(name: Column, part: Column, suffix: str = ".pdf") -> Column:
    return F.concat(
        F.lit("split_part"), part.cast("string"), F.lit("_"), stem(name), F.lit(suffix)
    )
