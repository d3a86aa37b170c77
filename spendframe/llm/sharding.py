"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at ``VIRTUAL`` places of a ring of 65,536 buckets. A document's bucket
is the first 16 bits of a digest of its id, and it belongs to the next place clockwise.
Every shard has a bound, floor(n / shards) or one more; documents that find their
shard full go on clockwise to the next place whose shard is not. The bounds add up to
n, so counts differ by one at most, and only what overflows leaves its own shard.

The walk needs no rows: an arc (the buckets before a place) is a number of documents.
At most 65,536 bucket counts are joined to the rows and one sum for each arc is
looked at on the driver. A bucket that holds far more than its share (one id may hold a
third of all rows) is cut into cells by a digest of size and checksum; there are at most
131,072 cells. Which of an arc's documents go on follows from their rank by cell and
digest, counted within cells and added up over the arc. All steps are DataFrame or
SQL expressions; rows are shuffled by cell, without their text.

Defined cases: a null text has size 1 and the checksum of no bytes; a null id is an id of
its own; equal rows (id, size and checksum) are one counted row, and are written out in
runs of ``_RUN`` at most, which are spread over tasks; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.llm import frames

SHARDS = 8
VIRTUAL = 64
_BUCKETS = 1 << 16
#: No cell is meant to hold more different rows than this, or than a bucket's share.
_CELL = 1 << 16
_RUN = 1 << 16


def position(id: Column) -> Column:
    """52 bits of a digest of the id; the upper 16 are its bucket."""
    named = F.coalesce(id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long")


def ring(shards: int = SHARDS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(bucket, shard) of each place in clockwise order; the lowest shard keeps a shared one."""
    places: dict[int, int] = {}
    for shard in range(shards):
        for copy in range(virtual):
            bucket = int(hashlib.md5(f"shard {shard} copy {copy}".encode()).hexdigest()[:4], 16)
            places.setdefault(bucket, shard)
    return sorted(places.items())


def walk(loads: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, from rank, to rank, shard): who takes which of each arc's documents.

    All arcs offer what they have left to one place after another, beginning with their
    own; a shard takes what fits, in clockwise order of the places.
    """
    total = sum(loads.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    left = {arc: (0, load) for arc, load in loads.items() if load}
    taken: list[tuple[int, int, int, int]] = []
    hop = 0
    while left:
        going: dict[int, tuple[int, int]] = {}
        for arc, (start, end) in sorted(left.items()):
            shard = owners[(arc + hop) % len(owners)]
            fits = min(room[shard], end - start)
            if fits:
                room[shard] -= fits
                taken.append((arc, start, start + fits, shard))
            if start + fits < end:
                going[arc] = (start + fits, end)
        left, hop = going, hop + 1
    return taken


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
                       F.crc32(whole).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = counted.withColumn("position", position(F.col("doc_id"))).withColumn(
        "bucket", F.shiftright("position", 36).cast("int"))
    placed = frames.store(placed, "placed")

    places = ring(shards, virtual)
    owners = [shard for _, shard in places]
    edges = F.array(*[F.lit(bucket) for bucket, _ in places])
    arc = F.size(F.filter(edges, lambda edge: edge < F.col("bucket"))) % len(places)
    buckets = placed.groupBy("bucket").agg(F.sum("copies").alias("load"), F.count("*").alias("different")).withColumn("arc", arc)
    buckets = frames.store(buckets, "buckets")
    sums = buckets.groupBy("arc").agg(F.sum("load").alias("load"), F.sum("different").alias("different")).collect()
    loads = {row["arc"]: row["load"] for row in sums}
    share = max(_CELL, -(-sum(row["different"] for row in sums) // _BUCKETS))
    cells_of = buckets.select(F.col("bucket").alias("in_bucket"), "arc", F.ceil(F.col("different") / share).alias("cells"))
    salt = F.pmod(F.xxhash64("size", "text_crc32"), F.col("cells")).cast("int")
    placed = placed.join(F.broadcast(cells_of), F.col("bucket") == F.col("in_bucket")).withColumn("salt", salt).drop(
        "in_bucket", "cells")
    taken = walk(loads, owners, shards) or [(0, 0, 0, 0)]
    used: dict[int, int] = defaultdict(int)
    pieces = []
    for arc_number, start, end, shard in sorted(taken, key=lambda piece: (piece[3], piece[0], piece[1])):
        pieces.append(f"({arc_number}, {start}L, {end}L, {shard}, {used[shard]}L)")
        used[shard] += end - start
    pieces = spark.sql(f"SELECT * FROM VALUES {', '.join(pieces)} AS t(arc, low, high, shard, base)")

    cells = placed.groupBy("arc", "bucket", "salt").agg(F.sum("copies").alias("load"))
    ahead = F.sum("load").over(Window.partitionBy("arc").orderBy("bucket", "salt")) - F.col("load")
    offsets = cells.select(F.col("bucket").alias("of_bucket"), F.col("salt").alias("of_salt"), ahead.alias("ahead"))
    within = Window.partitionBy("bucket", "salt").orderBy("position", "doc_id", "text_crc32", "size")
    ranked = (
        placed.withColumn("end", F.sum("copies").over(within))
        .join(F.broadcast(offsets), (F.col("bucket") == F.col("of_bucket")) & (F.col("salt") == F.col("of_salt")))
        .withColumn("end", F.col("ahead") + F.col("end"))
        .withColumn("start", F.col("end") - F.col("copies"))
        .join(F.broadcast(pieces), "arc")
        .filter("start < high and low < end")
        .withColumn("last", F.least("end", "high") - 1)
        .withColumn("run", F.explode(F.sequence(F.greatest("start", "low"), F.col("last"), F.lit(_RUN).cast("long"))))
        .select("doc_id", "size", "text_crc32", "shard", "run", F.least("last", F.col("run") + _RUN - 1).alias("last"),
                (F.col("base") - F.col("low")).alias("base"))
        .repartition("shard", "run")
    )
    return ranked.withColumn("rank", F.explode(F.sequence("run", "last"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))
