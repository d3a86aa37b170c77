"""File inventories: kinds, clash-free names, export plans and latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.functions.text import base_name, extension, file_kind, stem
from spendframe.operators.ordering import block_of, number_rows, with_group_facts

NAME_BLOCK = 1024
# A name that numbering another name could give: with an extension, or without any.
_NUMBER = "([1-9][0-9]{0,17})"
_NUMBERED = rf"(?s)\A(?:(.*[^.].*)_{_NUMBER}(\.[^.]*)|(\.*[^.]*)_{_NUMBER})\z"


def classify(files: DataFrame, path: str = "path",
             kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``name``, ``ext`` (lower case) and ``category`` by extension."""
    name = base_name(F.col(path))
    return files.withColumns(
        {"name": name, "ext": F.lower(extension(name)), "category": file_kind(name, kinds)}
    )


def category_counts(files: DataFrame, category: str = "category") -> DataFrame:
    """Files per category."""
    return files.groupBy(category).agg(F.count(F.lit(1)).alias("files"))


def with_suffix(files: DataFrame, suffix: str, name: str = "name", prefix: str = "") -> DataFrame:
    """Files whose name ends in a suffix, any letter case, and starts with a prefix."""
    return files.filter(
        F.lower(F.col(name)).endswith(suffix.lower()) & F.col(name).startswith(prefix)
    )


def latest(files: DataFrame, folder: str = "folder", path: str = "path",
           modified: str = "modified") -> DataFrame:
    """The newest file per folder; of equally new ones the last by path."""
    newest = F.max(F.struct(modified, path))
    return files.groupBy(folder).agg(newest.alias("_newest")).select(
        folder, F.col(f"_newest.{path}").alias(path), F.col(f"_newest.{modified}").alias(modified)
    )


def mark_stale(files: DataFrame, folder: str = "folder", path: str = "path",
               modified: str = "modified") -> DataFrame:
    """All files with ``stale``, true for all but the newest of each folder."""
    newest = files.groupBy(folder).agg(F.max(F.struct(modified, path)).alias("_newest"))
    stale = F.struct(modified, path) != F.col("_newest")
    return (
        with_group_facts(files, folder, F.col(path), newest)
        .withColumn("stale", stale)
        .drop("_newest")
    )


def plan_names(files: DataFrame, folder: str = "folder", name: str = "name",
               path: str = "path", existing: DataFrame | None = None) -> DataFrame:
    """Add ``new_name``, unique within the target folder.

    Files that want the same name in the same folder are put in a fixed order;
    the first keeps the name and the others get ``_1``, ``_2``, ... before the
    extension, passing over every number that some other file's own name, or a
    name in ``existing`` (columns ``folder`` and ``name``), already takes. That is
    what moving the files one by one gives, with all first holders moved first.

    The order within a name is by a slice of the path's digest, then by path: a
    name shared by a great many files is thereby cut into slices that tasks
    number on their own. Free numbers are found without trying them one by one:
    if t is the i-th taken number of a name, the m-th free number is m plus the
    count of taken ones with t - i < m.
    """

    def key(part: Column) -> Column:
        return F.struct(F.col(folder).alias("_f"), F.col(name).alias("_n"), part)

    files = files.withColumn("_digest", F.substring(F.md5(F.col(path).cast("binary")), 1, 3))
    counts = files.groupBy(
        F.col(folder).alias("_f"), F.col(name).alias("_n"), F.col("_digest").alias("_d")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    if existing is not None:
        # A name that exists already is a first holder ahead of all slices.
        held = existing.select(F.col("folder").alias("_f"), F.col("name").alias("_n")).distinct()
        counts = counts.unionByName(
            held.select("_f", "_n", F.lit("").alias("_d"), F.lit(1).cast("bigint").alias("_rows"))
        )
    group = Window.partitionBy("_f", "_n")
    offsets = counts.select(
        F.struct("_f", "_n", "_d").alias("_slice"),
        (F.sum("_rows").over(group.orderBy("_d")) - F.col("_rows")).alias("_before"),
    )
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(path))
    placed = (
        files.withColumn("_slice", key(F.col("_digest").alias("_d")))
        .join(offsets, "_slice")
        .withColumn("_place", F.col("_before") + within - 1)
        .drop("_slice", "_digest", "_before")
    )
    skips = _taken_numbers(counts)
    passed = F.aggregate(
        F.filter("_steps", lambda step: step["from"] <= F.col("_place")),
        F.col("_ahead"),
        lambda sum_, step: sum_ + step["count"],
    )
    number = F.col("_place") + F.coalesce(passed, F.lit(0))
    return (
        placed.withColumn("_key", key(block_of(F.col("_place"), NAME_BLOCK).alias("_block")))
        .join(skips, "_key", "left")
        .withColumn(
            "new_name",
            F.when(F.col("_place") == 0, F.col(name)).otherwise(
                F.concat(
                    stem(F.col(name)), F.lit("_"), number.cast("string"), extension(F.col(name))
                )
            ),
        )
        .drop("_key", "_place", "_steps", "_ahead")
    )


def _taken_numbers(counts: DataFrame) -> DataFrame:
    """Per name and block of places, the steps at which numbers must be passed over.

    ``_steps`` has, for places of that block, ``struct(from, count)``: from place
    ``from`` on, ``count`` more numbers are taken. ``_ahead`` sums up the earlier
    blocks. At most NAME_BLOCK steps are in a block.
    """
    numbered = counts.filter(F.col("_n").rlike(_NUMBERED))
    taken = numbered.select(
        "_f",
        F.regexp_replace("_n", _NUMBERED, "$1$4$3").alias("_n"),
        F.regexp_replace("_n", _NUMBERED, "$2$5").cast("bigint").alias("_t"),
    ).distinct()
    steps = (
        number_rows(taken, ["_f", "_n"], "_t")
        .groupBy("_f", "_n", (F.col("_t") - F.col("seq") + 1).alias("from"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("_block", block_of(F.col("from"), NAME_BLOCK))
    )
    # Blocks of places that exist at all, for the names that have taken numbers.
    sizes = counts.groupBy("_f", "_n").agg(F.sum("_rows").alias("_size"))
    named = steps.select("_f", "_n").distinct()
    blocks = (
        sizes.withColumn("_g", F.struct("_f", "_n"))
        .join(named.select(F.struct("_f", "_n").alias("_g")), "_g", "left_semi")
        .select(
            "_f",
            "_n",
            F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(F.col("_size"), NAME_BLOCK)))
            .alias("_block"),
            F.lit(None).cast("bigint").alias("from"),
            F.lit(None).cast("bigint").alias("count"),
        )
    )
    per_block = (
        steps.select("_f", "_n", "_block", "from", "count")
        .unionByName(blocks)
        .groupBy("_f", "_n", "_block")
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("_sum"),
            F.filter(
                F.collect_list(F.struct("from", "count")), lambda step: step["from"].isNotNull()
            ).alias("_steps"),
        )
    )
    ahead = F.sum("_sum").over(Window.partitionBy("_f", "_n").orderBy("_block")) - F.col("_sum")
    return per_block.select(
        F.struct("_f", "_n", "_block").alias("_key"), "_steps", ahead.alias("_ahead")
    )


def organize(files: DataFrame, path: str = "path",
             kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """Plan to move every file into a folder named after its category."""
    return plan_names(classify(files, path, kinds), "category", "name", path)


def export_plan(files: DataFrame, existing: DataFrame | None = None, folder: Column | None = None,
                name: str = "name", path: str = "path", length: str = "length",
                prefix: str = "converted_") -> DataFrame:
    """Plan to copy the non-empty files to a folder, with the prefix taken off their names."""
    wanted = F.when(
        F.col(name).startswith(prefix), F.substring(F.col(name), len(prefix) + 1, 2147483647)
    ).otherwise(F.col(name))
    target = F.lit("") if folder is None else folder
    plan = files.filter(F.col(length) > 0).withColumns({"clean_name": wanted, "target": target})
    return plan_names(plan, "target", "clean_name", path, existing)
