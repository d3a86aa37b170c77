"""Mixing sources to target weights by repeating documents.

Sizes are words, summed up by source in one pass. A source's weight follows its rank
by name; all sources together share the words there are, and none gets more than
``MOST`` times its own. A document is taken floor(rate) times plus once more with
probability rate - floor(rate), where a digest of its id, its text and the seed decides,
so that rows without an id, or with one id, are drawn each by itself.

Defined cases: a null or empty text has size 0; null sources are one source, the last;
an empty source has target 0; a null id counts as an id of its own; rows that agree in id
and text are decided alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.llm import frames

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))


def chance(id: Column, digest: Column, seed: int = SEED) -> Column:
    """A number from 0 (with) to 1 (without) that only the id, the text's digest and the seed decide."""
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("null")), digest)
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Columns source, source_size, target and rate, a row for each source.

    ``sizes`` has source and size. With sources in ascending order of size over weight,
    those ahead of one are at their limit before it. The share of a unit of weight, if
    just these are at their limits, is greatest where that is true of no further one.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.expr(f"(rank - 1) % {len(WEIGHTS)} + 1")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    ahead = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    shared = (
        weighted.withColumn("unit", (F.sum("source_size").over(everything) - MOST * ahead) / behind)
        .withColumn("unit", F.max("unit").over(everything))
    )
    target = F.least((MOST * F.col("source_size")).cast("double"), F.col("unit") * F.col("weight"))
    return shared.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _with_copies(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The rows, which have doc_id, source and digest, with source_size, target and copies."""
    facts = targets.withColumnRenamed("source", "target_source")
    joined = rows.join(frames.small_or_plain(facts), F.col("source").eqNullSafe(F.col("target_source")))
    whole = F.floor("rate")
    once_more = F.when(chance(F.col("doc_id"), F.col("digest"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", whole + once_more).drop("target_source", "rate", "digest")


def mixture(docs: DataFrame, seed: int = SEED, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """Each row's doc_id, source, size, source_size, target, copies and taken words."""
    sized = frames.store(
        docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                    word_count(F.col(f"`{text}`")).alias("size"), text_digest(text).alias("digest")), "sizes")
    targets = frames.store(source_targets(sized), "targets")
    return _with_copies(sized, targets, seed).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    targets = frames.store(source_targets(docs.select("source", word_count("text").alias("size"))), "targets")
    rows = docs.select("doc_id", "source", text_digest().alias("digest"), F.struct("*").alias("row"))
    taken = _with_copies(rows, targets, seed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
