"""Spark helpers of the operators: stored tables, bounded broadcasts, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 1_000_000
BATCH_ROWS = 1000
#: A key is hot that holds more than this part of the rows; so there are fewer hot keys than 1000.
HOT_PART = 1000
SALTS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns of ``docs``, for a Python function that reads whole texts.

    Texts can be long, so batches of Arrow's default 10,000 rows are too large for
    two tasks side by side; a session that sets a size of its own keeps it.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return docs.select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spendframe-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them again.

    Cuts the lineage: later stages, and retries after a lost executor, start from
    files that every executor can read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spendframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def small_or_plain(df: DataFrame, rows: int | None = None) -> DataFrame:
    """With a broadcast hint if the counted rows are within the bound."""
    count = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, nulls equal, where a key may hold any part of the rows of ``left``.

    ``left`` reads stored tables; ``right`` has few rows of one key. Where ``right`` is too
    large for a broadcast, hot keys of ``left`` are spread over ``SALTS`` cells, and their
    rows of ``right`` repeated in each.
    """
    names = [fresh([*left.columns, *right.columns], f"{key}_right") for key in keys]
    for key, name in zip(keys, names, strict=True):
        right = right.withColumnRenamed(key, name)
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in zip(keys, names, strict=True)]
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), same, how).drop(*names)
    cell, other, mark = (fresh([*left.columns, *right.columns], name) for name in ("cell", "other_cell", "hot"))
    hot = left.groupBy(*keys).agg(F.count("*").alias(mark)).filter(F.col(mark) * HOT_PART > left.count())
    hot = store(hot, "hot").select(*(F.col(key).alias(f"{name}_hot") for key, name in zip(keys, names, strict=True)), F.lit(1).alias(mark))

    def marked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        found = [F.col(column).eqNullSafe(F.col(f"{name}_hot")) for column, name in zip(columns, names, strict=True)]
        return df.join(F.broadcast(hot), found, "left").drop(*(f"{name}_hot" for name in names))

    spread = F.when(F.col(mark).isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    cells = F.when(F.col(mark).isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = marked(left, keys).withColumn(cell, spread.cast("int")).drop(mark)
    right = marked(right, names).withColumn(other, F.explode(cells)).drop(mark)
    return left.join(right, [*same, F.col(cell) == F.col(other)], how).drop(*names, cell, other)


def fresh(taken: Sequence[str], wanted: str) -> str:
    """A column name that none of ``taken`` has, upper and lower case alike."""
    low = {name.lower() for name in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def content_key(text: str | Column = "text") -> Column:
    """A 64-bit digest that tells apart rows of one doc_id with different texts."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def without(docs: DataFrame, rejected: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose (id, digest of text) is not in ``rejected``.

    ``rejected`` has columns ``gone_id`` and ``gone_key``. Nulls compare as equal.
    """
    left = docs.alias("kept")
    gone = small_or_plain(rejected).alias("gone")
    return left.join(
        gone,
        F.col(f"kept.`{id}`").eqNullSafe(F.col("gone.gone_id"))
        & content_key(F.col(f"kept.`{text}`")).eqNullSafe(F.col("gone.gone_key")),
        "left_anti",
    )
