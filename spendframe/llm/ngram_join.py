"""N-gram Jaccard join: a grouped prefix join on sets of word shingles.

A text's set holds its distinct shingles; two texts link when the Jaccard
similarity of their sets reaches ``percent``. Shingles are ordered globally: by
their hash, but repeated ones later and frequent ones last. Repetition is counted among
the first shingles by hash of all texts, and among all shingles of those texts that
have too few unrepeated ones there; bit fields of fixed size hold what was found. A
set's prefix is its first shingles in that order, so many that linked sets must share
one. The order only has to be the same for all sets, so the fields need not be exact.

1. Texts with equal sets are one class. Classes with equal prefix and size are one
   group, and only groups are indexed by their prefix.
2. Group pairs that share a prefix shingle are filtered by size and by the places of
   the shingle in both prefixes. Sizes are cut into buckets and each side is keyed by
   (shingle, bucket), so that the filters are part of the key.
3. Pairs are expanded to members and verified: first by a bound from bit fields, in
   which each shingle flips one bit (two sets differ in at least as many shingles as
   their fields in bits), then on whole sets.

To find what hangs together it is not needed to look at all pairs within a cluster
of copies. A first round verifies each posting against the hub of its cell, the one
with the fewest rarer shingles before it, and members against their group. Where
cells of several components stay large, further rounds draw other hubs for each and
verify, for each two components that meet, the closest pair of a posting and a hub.
The last round summarizes what is left by cell and component: sizes, and the bits that
all, or any, of its fields have. Bits that all fields of one component have and none of
another's differ in every pair of the two, so that most pairs of components that meet
in a cell are ruled out without their members. The rest is expanded, filtered by the
fields of both members while it is joined, and verified. A pair of one component needs
no check, and any link between components is found, so the components are exact.

Defined cases: a null or empty text has an empty set and links with nothing; with
fewer words than a shingle the whole sequence is its one shingle; repeated rows are
copies; rows that share an id are one node; a row without an id is counted but has no
component and gives no links; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import arrays, frames
from spendframe.llm.components import components

WIDTH = 5
PERCENT = 80
#: Shingles found so often come later and later in the order.
REPEATED = (2, 16, 256)
MAX_FIELD_BITS = 27
#: Rows whose shingles are counted by one group, the most groups, and shingles packed at a time.
ROWS_A_GROUP = 1024
MOST_GROUPS = 1 << 16
PACKED = 1 << 20
#: Bit fields folded to so many 64-bit words stand in the postings.
FOLDED = [f"q{i}" for i in range(8)]
#: Hubs drawn for a cell in a round, the most such rounds, and the part of the links that a round adds before another.
HUBS = 4
ROUNDS = 4
WORTH = 0.01


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes, A-Z as a-z."""
    data, bounds = arrays.utf8(column)
    for low, high in arrays.groups(bounds):
        rows = bounds[low : high + 1]
        hashes, begins, _ = arrays.words(data, rows, arrays.WHITE, arrays.FOLDED)
        yield from arrays.distinct(*arrays.windows(hashes, arrays.firsts(begins, rows), width))


def _counted(rows: DataFrame, listed: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, int]]], groups: int) -> DataFrame:
    """Columns key and uses: how often each shingle occurs in the lists that ``listed`` makes, with weights.

    Each task sums up its own shingles first, so a frequent one is a single entry of
    it, and packs them by hash range. A group then adds up the packs of its range.
    """

    def packed(waiting: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        keys = np.concatenate([keys for keys, _ in waiting])
        weights = np.repeat(np.array([weight for _, weight in waiting]), [len(keys) for keys, _ in waiting])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        uses = np.minimum(np.add.reduceat(weights[order], starts), 65535).astype(np.uint16)
        keys = keys[starts]
        part = (keys >> np.uint64(44)).astype(np.int64) * groups >> 20
        bounds = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys)).tolist()
        ranges = list(zip(bounds[:-1], bounds[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[bounds[:-1]]), pa.array([keys[i:j].tobytes() for i, j in ranges], pa.binary()),
             pa.array([uses[i:j].tobytes() for i, j in ranges], pa.binary())], names=["part", "keys", "uses"])

    # Lists are made and packed by one function: two in a row would be two workers for each task.
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, int]] = []
        held = 0
        for batch in batches:
            for keys, weight in listed(batch):
                if len(keys):
                    waiting.append((keys, weight))
                    held += len(keys)
                if held >= PACKED:
                    yield packed(waiting)
                    waiting, held = [], 0
        if waiting:
            yield packed(waiting)

    def add(packs: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(packs.column("keys").to_pylist()), np.uint64)
        uses = np.frombuffer(b"".join(packs.column("uses").to_pylist()), np.uint16)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        sums = np.add.reduceat(uses[order].astype(np.int64), starts)
        often = sums > 1
        return pa.table({"key": keys[starts][often].view(np.int64), "uses": sums[often]})

    packs = rows.mapInArrow(pack, "part long, keys binary, uses binary")
    return packs.groupBy("part").applyInArrow(add, "key long, uses long")


def _first(row: np.ndarray, percent: int) -> int:
    """Length of the prefix in which a set meets every set similar enough to it."""
    return len(row) - -(-percent * len(row) // 100) + 1 if len(row) else 0


def _level(row: np.ndarray, fields: list[np.ndarray]) -> np.ndarray:
    return sum((_in_field(field, row).astype(np.int8) for field in fields), np.zeros(len(row), np.int8))


def repeated_shingles(docs: DataFrame, width: int, percent: int, groups: int) -> list[np.ndarray]:
    """Bit fields of shingles by how often they were found.

    First the prefix by hash and half as much again of each set is counted. A set
    that has fewer unrepeated shingles there than its prefix is long, because it is
    much like others, is then counted in full.
    """

    def fields(cut: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
        def listed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
            return ((cut(row), 1) for row in _sets(batch.column(0), width))

        counted = frames.store(_counted(docs.select("text"), listed, groups), "repeated")
        found = [_field(counted.filter(F.col("uses") >= least)) for least in REPEATED]
        frames.discard(counted)
        return found

    def head(row: np.ndarray) -> np.ndarray:
        return row[: _first(row, percent) * 3 // 2].copy()

    among_first = fields(head)

    def whole_if_repeated(row: np.ndarray) -> np.ndarray:
        unrepeated = np.count_nonzero(~_in_field(among_first[0], head(row)))
        return row if unrepeated < _first(row, percent) else row[:0]

    return among_first + fields(whole_if_repeated)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(row) for row in rows], out=bounds[1:])
    values = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))


def _parity(row: np.ndarray) -> bytes:
    """A bit field of about the set's size in which each shingle flips one bit."""
    bits = max(64 * len(FOLDED), 1 << int(len(row) - 1).bit_length())
    flips = np.bincount((row & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(parity: list[bytes]) -> list[pa.Array]:
    """The words of the fields, each folded to the same length."""
    words = np.array([np.bitwise_xor.reduce(np.frombuffer(one, np.int64).reshape(-1, len(FOLDED)), axis=0) for one in parity],
                     np.int64).reshape(-1, len(FOLDED))
    return [pa.array(words[:, i]) for i in range(len(FOLDED))]


def _differing(one: bytes, two: bytes) -> int:
    """Bits that differ, after folding the longer field to the shorter one's length."""
    left, right = sorted((one, two), key=len)
    short, long, bits = int.from_bytes(left, "little"), int.from_bytes(right, "little"), len(right) * 8
    while bits > len(left) * 8:
        bits //= 2
        long = (long >> bits) ^ (long & ((1 << bits) - 1))
    return (short ^ long).bit_count()


def signatures(docs: DataFrame, repeated: list[np.ndarray], width: int, percent: int) -> DataFrame:
    """Size, digests of set and prefix, the prefix's shingles, and the set's bit field."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            size, one, two, group = np.zeros(rows, np.int64), *(np.zeros(rows, np.uint64) for _ in range(3))
            prefixes: list[np.ndarray] = []
            parity: list[bytes] = []
            for i, row in enumerate(_sets(batch.column(1), width)):
                size[i] = n = len(row)
                parity.append(_parity(row))
                if n:
                    one[i] = arrays.mix(row).sum()
                    two[i] = np.bitwise_xor.reduce(arrays.mix(row + np.uint64(1)))
                    # Ascending hashes, so a stable sort by level orders by (level, hash).
                    prefix = row[np.argsort(_level(row, repeated), kind="stable")][: _first(row, percent)]
                    group[i] = arrays.mix(prefix + np.uint64(2)).sum()
                    prefixes.append(prefix)
                else:
                    prefixes.append(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), *(pa.array(x.view(np.int64)) for x in (one, two, group)),
                 _lists(prefixes), pa.array(parity, pa.binary()), *_folded(parity)],
                names=["doc_id", "n", "one", "two", "group", "prefix", "parity", *FOLDED])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n long, one long, two long, group long, prefix array<long>, parity binary, "
        + ", ".join(f"{name} long" for name in FOLDED))


def _field(keys: DataFrame) -> np.ndarray:
    """A bit field with the bit of every key set, put together by chunks.

    It has about 16 bits a key, and ``MAX_FIELD_BITS`` (16 MB) at most. Scans use it to
    pass over rows that have no match. It may let others through, more of them once it
    is at its bound, and never holds one back; an exact join follows.
    """
    bits = min(MAX_FIELD_BITS, max(16, (8 * keys.count()).bit_length()))
    chunk = 1 << min(bits, 19)

    def draw(rows: pa.Table) -> pa.Table:
        slots = rows.column("slot").to_numpy()
        flags = np.zeros(chunk, np.uint8)
        flags[slots % chunk] = 1
        return pa.table({"part": [int(slots[0]) // chunk], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    found = (
        keys.select(F.expr(f"shiftrightunsigned(key, {64 - bits})").alias("slot")).distinct()
        .groupBy(F.expr(f"slot div {chunk}").alias("part")).applyInArrow(draw, "part long, bits binary").collect()
    )
    field = np.zeros((1 << bits) >> 3, np.uint8)
    for row in found:
        at = row["part"] * (chunk >> 3)
        field[at : at + (chunk >> 3)] = np.frombuffer(row["bits"], np.uint8)
    return field


def _in_field(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) >> np.uint64(64 - (len(field) * 8 - 1).bit_length())
    return (field[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _postings(signed: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Shingle, place, size, group and node for each prefix shingle that several groups have.

    ``anchors`` has a node for each group. Bit fields pick their rows in the scan; a row
    that slips through is one more node with the same shingles and does no harm.
    """
    chosen, mixed = (_field(nodes.select(F.xxhash64("node").alias("key")))
                     for nodes in (anchors, anchors.filter("mixed")))
    rows = signed.filter("n > 0 and doc_id is not null").select(
        F.xxhash64("doc_id").alias("key"), "n", "group", F.col("doc_id").alias("node"), "prefix", *FOLDED)

    def weighed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        batch = batch.filter(pa.array(_in_field(chosen, batch.column(0).to_numpy(zero_copy_only=False))))
        weights = 1 + _in_field(mixed, batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return zip(np.split(values, ends[:-1]), weights.tolist(), strict=True) if len(batch) else iter(())

    shared = frames.store(_counted(rows.select("key", "prefix"), weighed, groups).select("key"), "shared")
    field = _field(shared)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in_field(chosen, batch.column(0).to_numpy(zero_copy_only=False))))
            prefix = batch.column(4)
            token = prefix.flatten().to_numpy(zero_copy_only=False)
            counts = prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), counts)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
            wanted = _in_field(field, token)
            row = pa.array(row[wanted])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(row) for i in (1, 2, 3)), pa.array(pos[wanted].astype(np.int32)),
                 pa.array(token[wanted]), *(batch.column(name).take(row) for name in FOLDED)],
                names=["n", "group", "node", "pos", "token", *FOLDED])

    spread_rows = rows.mapInArrow(spread, "n long, group long, node long, pos int, token long, "
                                  + ", ".join(f"{name} long" for name in FOLDED))
    return spread_rows.join(shared.withColumnRenamed("key", "token"), "token", "left_semi")


def _bucket(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent))).cast("int")


def _most(percent: int) -> Column:
    """The greatest size of a partner that has no rarer shingle in common."""
    return F.expr(f"({100 + percent} * (n - pos)) div {percent} - n")


def _index(postings: DataFrame, percent: int) -> DataFrame:
    """Postings as the smaller side: cell, size and the greatest size of a partner."""
    return postings.withColumn("most", _most(percent)).filter("most >= n").withColumn("bucket", _bucket(F.col("n"), percent))


def _probe(postings: DataFrame, percent: int) -> DataFrame:
    """Postings as the larger side, once for each bucket a partner's size can be in."""
    return (
        postings.withColumn("least", F.expr(f"({percent} * n + 99) div 100"))
        .withColumn("most", F.least("n", _most(percent)))
        .filter("most >= least")
        .withColumn("bucket", F.explode(F.sequence(_bucket(F.col("least"), percent), _bucket(F.col("most"), percent))))
    )


def _ordered(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _plausible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bit fields do not differ in too many bits."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            differing = np.fromiter(map(_differing, batch.column(3).to_pylist(), batch.column(4).to_pylist()),
                                    np.int64, len(batch))
            # 100 * common >= percent * union, with common + common = sizes - difference at most.
            yield batch.select([0, 1]).filter(
                pa.array(100 * (sizes - differing) >= percent * (sizes + differing)))

    facts = signed.select("doc_id", "n", "parity")
    left = facts.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("left"))
    right = facts.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("right"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "left", "right")
        .mapInArrow(compare, "a long, b long").distinct()
    )


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of ids whose whole sets are similar enough.

    Sets are made again from the texts of the ids concerned only.
    """
    field = _field(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("key")).distinct())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in_field(field, batch.column(0).to_numpy(zero_copy_only=False))))
            if len(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), _lists(list(_sets(batch.column(2), width)))], names=["node", "items"])

    hashed = docs.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("key"), "doc_id", "text")
    sets = frames.store(hashed.mapInArrow(build, "node long, items array<long>"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    found = frames.store(
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", (F.size("left") + F.size("right")).alias("sizes"), both.alias("common"))
        .filter(f"100 * common >= {percent} * (sizes - common)")
        .select("a", "b").distinct(), "verified")
    frames.discard(sets)
    return found


def _within(differing: Column, sizes: Column, percent: int) -> Column:
    """Whether sets of these sizes together, that differ in so many shingles, can be similar enough."""
    return (100 + percent) * differing <= (100 - percent) * sizes


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0]).cast("long")


def _unsettled(postings: DataFrame, known: DataFrame) -> tuple[DataFrame, bool]:
    """Postings of the shingles that several components have, with their component.

    Also whether drawn hubs pay: whether these shingles join many more pairs of
    different components than there are pairs of a posting with its hubs.
    """
    rows = postings.join(known, "node", "left").select(
        "token", "pos", "n", "node", F.coalesce("component", "node").alias("component"), *FOLDED)
    mixed = frames.store(
        rows.groupBy("token", "component").agg(F.count("*").cast("double").alias("one"))
        .groupBy("token").agg(F.count("*").alias("components"), F.sum("one").alias("rows"), F.sum(F.col("one") * F.col("one")).alias("within"))
        .filter("components > 1").select("token", "rows", (F.col("rows") * F.col("rows") - F.col("within")).alias("between")), "mixed")
    tokens, all_rows, between = mixed.agg(F.count("*"), F.sum("rows"), F.sum("between")).first()
    left = frames.store(rows.join(frames.small_or_plain(mixed.select("token"), tokens), "token", "left_semi"), "labelled")
    frames.discard(mixed)
    return left, bool(tokens) and between > 4 * HUBS * all_rows


def _differing_bits(one: Callable[[str], Column], two: Callable[[str], Column]) -> Column:
    return _total([F.bit_count(one(name).bitwiseXOR(two(name))) for name in FOLDED])


def _closest_to_hubs(labelled: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs a, b of nodes: for each two components the closest of a posting and a hub of its cell.

    Hubs are drawn by a digest of shingle and node, others in each turn. A hub also
    meets the postings of the next smaller and larger sizes.
    """
    rows = labelled.withColumn("most", _most(percent)).withColumn("bucket", _bucket(F.col("n"), percent))
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(turn), "token", "node"))
    hubs = (
        drawn.groupBy("token", "bucket", F.pmod("draw", F.lit(HUBS)).alias("part"))
        .agg(F.min(F.struct("draw", "node", "component", "n", "most", *FOLDED)).alias("hub"))
        .select("token", F.explode(F.expr("sequence(bucket - 1, bucket + 1)")).alias("bucket"), "hub")
    )
    differing = _differing_bits(F.col, lambda name: F.col(f"hub.{name}"))
    sizes = F.col("n") + F.col("hub.n")
    met = rows.join(hubs, ["token", "bucket"]).filter(
        (F.col("component") != F.col("hub.component")) & (F.col("n") <= F.col("hub.most")) & (F.col("hub.n") <= F.col("most"))
        & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & _within(differing, sizes, percent))
    pair = F.struct((differing / sizes).alias("apart"), *_ordered("node", "hub.node"))
    return (
        met.groupBy(F.least("component", "hub.component").alias("ca"), F.greatest("component", "hub.component").alias("cb"))
        .agg(F.min(pair).alias("pair")).select("pair.a", "pair.b")
    )


def _between_components(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y of nodes of different components that share a cell and pass all filters."""
    cell = ["token", "bucket"]
    small, large = _index(labelled, percent), _probe(labelled, percent)

    def bits(side: str) -> list[Column]:
        return [part for name in FOLDED for part in (
            F.bit_and(name).alias(f"{side}_all_{name}"), F.bit_or(name).alias(f"{side}_any_{name}"))]

    small_sums = small.groupBy(*cell, F.col("component").alias("ca")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("most").alias("reach"), *bits("a"))
    large_sums = large.groupBy(*cell, F.col("component").alias("cb")).agg(
        F.min("least").alias("b_least"), F.max("most").alias("b_most"), F.min("n").alias("b_size"), F.max("n").alias("b_top"), *bits("b"))

    def surely(some: Callable[[str], tuple[Column, Column]]) -> Column:
        """Bits that all of a side have and none of the other; ``some`` gives one side's, all and any."""
        return _total([F.bit_count(one) for name in FOLDED for one in (
            some(name)[0].bitwiseAND(F.bitwise_not(F.col(f"b_any_{name}"))),
            F.col(f"b_all_{name}").bitwiseAND(F.bitwise_not(some(name)[1])))])

    meet = frames.store(
        small_sums.join(large_sums, cell).filter(
            (F.col("ca") != F.col("cb")) & (F.col("low") <= F.col("b_most")) & (F.col("high") >= F.col("b_least"))
            & (F.col("b_size") <= F.col("reach"))
            & _within(surely(lambda name: (F.col(f"a_all_{name}"), F.col(f"a_any_{name}"))), F.col("high") + F.col("b_top"), percent))
        .select(*cell, "ca", *large_sums.columns[2:]), "cells")
    left = small.select(*cell, F.col("component").alias("ca"), F.col("node").alias("x"), F.col("n").alias("nx"),
                        F.col("most").alias("reach"), *[F.col(name).alias(f"x_{name}") for name in FOLDED])
    # A node has to be close enough to what a whole component can hold before it meets its members.
    near = meet.join(left, [*cell, "ca"]).filter(
        F.col("nx").between(F.col("b_least"), F.col("b_most")) & (F.col("b_size") <= F.col("reach"))
        & _within(surely(lambda name: (F.col(f"x_{name}"), F.col(f"x_{name}"))), F.col("nx") + F.col("b_top"), percent))
    near = near.select(*left.columns[:2], "cb", "x", "nx", "reach", *[f"x_{name}" for name in FOLDED])
    right = large.select(*cell, F.col("component").alias("cb"), F.col("node").alias("y"), F.col("n").alias("ny"),
                         "least", "most", *[F.col(name).alias(f"y_{name}") for name in FOLDED])
    differing = _differing_bits(lambda name: F.col(f"x_{name}"), lambda name: F.col(f"y_{name}"))
    return near.join(right, [*cell, "cb"]).filter(
        (F.col("x") != F.col("y")) & F.col("nx").between(F.col("least"), F.col("most")) & (F.col("ny") <= F.col("reach"))
        & _within(differing, F.col("nx") + F.col("ny"), percent))


def similarity_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                          text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    docs = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    groups = min(MOST_GROUPS, max(16, docs.count() // ROWS_A_GROUP))
    repeated = repeated_shingles(docs, width, percent, groups)
    signed = frames.store(signatures(docs, repeated, width, percent), "signatures")
    usable = signed.filter("n > 0 and doc_id is not null")
    classes = frames.store(usable.groupBy("n", "one", "two").agg(
        F.min("doc_id").alias("node"), F.min("group").alias("group"), F.count("*").alias("rows"),
        *[F.min(name).alias(name) for name in FOLDED]), "classes")
    anchors = classes.groupBy("n", "group").agg(F.min("node").alias("node"), (F.count("*") > 1).alias("mixed"))
    postings = frames.store(_postings(signed, anchors, groups), "postings")
    members = frames.store(
        classes.select("n", "group", F.col("node").alias("member"), *FOLDED).join(
            anchors.filter("mixed").select("n", "group", "node"), ["n", "group"]).filter("member != node"), "members")

    hubs = _index(postings, percent).groupBy("token", "bucket").agg(F.min(F.struct("pos", "node", "n", "most")).alias("hub"))
    near = (
        _probe(postings, percent).join(hubs, ["token", "bucket"])
        .filter("node != hub.node and hub.n between least and most and n <= hub.most")
        .select(*_ordered("node", "hub.node"))
    )
    tried = frames.store(near.union(members.select(*_ordered("node", "member"))).distinct(), "pairs")
    likely = frames.store(_plausible(tried, usable, percent), "likely")
    links = _verified(docs, likely, width, percent)
    known = frames.store(components(links), "components")

    everyone = postings.select("token", "pos", "n", "node", *FOLDED).union(
        postings.drop(*FOLDED).join(members.select("n", "group", "member", *FOLDED), ["n", "group"])
        .select("token", "pos", "n", F.col("member").alias("node"), *FOLDED))
    labelled, crowded = _unsettled(everyone, known)
    frames.discard(postings)
    for turn in range(ROUNDS):
        if not crowded:
            break
        close = frames.store(_closest_to_hubs(labelled, percent, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        likely = frames.store(_plausible(close, usable, percent), "likely")
        tried = tried.union(close)
        more = _verified(docs, likely, width, percent)
        added, had = more.count(), links.count()
        if added:
            links = links.union(more)
            known = frames.store(components(links), "components")
            before = labelled
            labelled, crowded = _unsettled(before.drop("component"), known)
            frames.discard(before)
        if added < WORTH * had:
            break
    # What the rounds leave is compared whole.
    candidates = _between_components(labelled, percent)
    rest = candidates.select(*_ordered("x", "y")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = frames.store(_plausible(rest, usable, percent), "likely")
    if not rest.isEmpty():
        more = _verified(docs, rest, width, percent)
        if not more.isEmpty():
            known = frames.store(components(links.union(more)), "components")

    # Classes of one row in no link stand for themselves.
    special = (
        classes.join(known, "node", "left")
        .select("n", "one", "two", "rows", "node", F.coalesce("component", "node").alias("component"))
        .filter("rows > 1 or component != node").drop("rows", "node")
    )
    return signed.select("doc_id", "n", "one", "two").join(special, ["n", "one", "two"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``: the one of the smallest id, nulls last, then of the smallest digest.

    A node is an id, null or not, with a digest of its text, so an id with two texts is
    two nodes and rows without an id are compared like others. Nodes are named by 64-bit
    hashes. Of rows of one node one stays, the first by its other columns.
    """
    content = frames.content_key("text")
    node = F.xxhash64(F.col("doc_id").isNull(), "doc_id", content)
    found = similarity_components(docs.select(node.alias("doc_id"), "text"), width, percent)
    keys = frames.store(
        docs.select(node.alias("node"), "doc_id", content.alias("content"))
        .groupBy("node", "doc_id", "content").agg(F.count("*").alias("rows")), "keys")
    linked = frames.store(
        found.filter("component_id != doc_id")
        .select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct(), "linked")
    named = linked.union(linked.select(F.col("component").alias("node"), "component").distinct()).join(keys, "node")
    first = named.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content", "node")).alias("first")).select("first.node")
    copies = frames.store(named.join(first, "node", "left_anti").select("node", "doc_id", "content"), "copies")
    again = frames.store(
        keys.filter("rows > 1").join(copies.select("node"), "node", "left_anti").select("node", "doc_id", "content"), "again")
    gone = copies.union(again).select(F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_key"))
    left = frames.without(docs, gone)
    if again.isEmpty():
        return left
    again_id, again_key, row = (frames.fresh(docs.columns, name) for name in ("again_id", "again_key", "row"))
    repeated = frames.small_or_plain(again.select(F.col("doc_id").alias(again_id), F.col("content").alias(again_key)))
    rows = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col(again_id)) & content.eqNullSafe(F.col(again_key)), "left_semi")
    others = F.to_json(F.struct(*[F.col(f"`{name}`") for name in docs.columns if name != "text"]))
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    kept = rows.groupBy(F.col("doc_id").alias(again_id), content.alias(again_key)).agg(F.min_by(whole, others).alias(row))
    return left.unionByName(kept.select(f"{row}.*"))
