"""Hard-negative mining with an R-tree packed by sort-tile-recursion.

Vectors are of integers; a score is the inner product with an anchor. An anchor's
positives are its best rows of the same label, and a positive's hard negatives the best
rows of other labels whose score lies within a window below the positive's.

1. Rows are dealt by range of (label, first component) into tiles of about ``TILE_ROWS``
   rows. Each tile is packed into a tree of its own: rows of one label are sorted along
   their widest component and cut into slabs, these along the next one, and so on;
   ``LEAF_ROWS`` rows in that order are a leaf, ``FANOUT`` nodes one node above. A node
   holds the least and the greatest value of each component and label.
2. A component of the anchor times the ends of a node's interval bounds its part of every
   inner product in the node; the sums of these parts bound the scores on both sides.
3. A search takes nodes from a queue, highest bound first, and passes over nodes of the
   wrong label, outside all score windows, or strictly below the k-th score found.
4. Trees are searched in two waves. The first (one tree in ``FIRST_WAVE``) gives k-th
   scores that prune the second. What the trees find is merged by Spark.

Anchors are a stated set of queries, read in blocks of about ``ANCHOR_BLOCK`` rows, and
each block is searched in the stored trees without moving them.

Scores are exact: doubles hold them as long as they are below 2^53, beyond that 64-bit
integers are multiplied; where even these could overflow a ValueError is raised.

Defined cases: rows with a null label or vector, or a component that is null or not
finite, take no part; of vectors of different lengths the shorter are filled up with
zeros, so an empty one scores 0; each of several equal rows is a row of its own, so a
copy of an anchor is among its other rows; a row without an id is no anchor, keeps its
label, and comes last among equal scores; an anchor without another row of its label, or
without a row in a window, gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.llm import frames

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least so many hundredths of the positive's, and not above it.
PERCENT = 80
TILE_ROWS = 4096
LEAF_ROWS = 64
FANOUT = 8
AXES = 3
FIRST_WAVE = 8
ANCHOR_BLOCK = 8192
_NO_ID = np.iinfo(np.int64).max

_TREE = "tree long, size int, width int, ids binary, rows binary, labels binary, vectors binary, ends binary"
_FOUND = "anchor int, positive int, row long, vec_id long, score long"


def usable(embeddings: DataFrame, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding",
           label: str = "label") -> DataFrame:
    """Columns vec_id, label and vector (integers) of the rows that take part."""
    values = F.col(f"`{vector}`")
    rows = embeddings.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("int").alias("label"),
                             F.transform(values, lambda x: x.cast("double")).alias("vector"))
    infinite = float("inf")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    return rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select(
        "vec_id", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def packed_order(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF_ROWS, axes: int = AXES) -> list[np.ndarray]:
    """The rows of each leaf: sorted, cut into slabs and sorted again, for each label by itself."""
    leaves: list[np.ndarray] = []

    def tile(rows: np.ndarray, left: list[int]) -> None:
        if len(rows) <= leaf:
            leaves.append(rows)
            return
        rows = rows[np.argsort(vectors[rows, left[0]], kind="stable")] if left else rows
        slabs = -(-len(rows) // leaf)
        if len(left) > 1:
            slabs = max(2, int(np.ceil(slabs ** (1 / len(left)))))
        # Whole leaves in every slab but the last one.
        each = -(-len(rows) // slabs)
        each = -(-each // leaf) * leaf
        for at in range(0, len(rows), each):
            tile(rows[at : at + each], left[1:])

    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        spread = vectors[rows].max(0) - vectors[rows].min(0)
        tile(rows, np.argsort(-spread, kind="stable")[:axes].tolist())
    return leaves


class Tree:
    """Rows in packed order, where each leaf ends, and for each level from the leaves up its nodes' bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, ends: np.ndarray, exact: bool):
        self.ids, self.rows, self.labels, self.ends = ids, rows, labels, ends.tolist()
        self.vectors = vectors.astype(np.float64 if exact else np.int64)
        starts = np.array([0, *self.ends[:-1]])
        facts = [np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts),
                 np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)]
        self.levels = [facts]
        while len(facts[0]) > 1:
            starts = np.arange(0, len(facts[0]), FANOUT)
            facts = [f.reduceat(fact, starts) for f, fact in zip((np.minimum, np.maximum) * 2, facts, strict=True)]
            self.levels.append(facts)

    def bounds(self, anchors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level, the least and greatest score that a node can hold for each anchor."""
        above, below = np.maximum(anchors, 0), np.minimum(anchors, 0)
        least = [above @ low.T + below @ high.T for low, high, _, _ in self.levels]
        most = [above @ high.T + below @ low.T for low, high, _, _ in self.levels]
        return least, most


class Best:
    """The best rows found for one question, and the score that a row must reach."""

    def __init__(self, top: int, low: int | None, high: int | None, least: int | None):
        self.top, self.low, self.high, self.least = top, low, high, least
        self.found: list[tuple[int, int, int]] = []

    def wants(self, low: float, high: float) -> bool:
        """Whether a node with scores from ``low`` to ``high`` can hold a row that counts."""
        return ((self.high is None or low <= self.high) and (self.low is None or high >= self.low)
                and (self.least is None or high >= self.least))

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        right = np.ones(len(scores), bool)
        for edge, above in ((self.low, True), (self.least, True), (self.high, False)):
            if edge is not None:
                right &= scores >= edge if above else scores <= edge
        if right.any():
            found = zip((-scores[right]).tolist(), ids[right].tolist(), rows[right].tolist(), strict=True)
            self.found = heapq.nsmallest(self.top, [*self.found, *found])
            if len(self.found) == self.top:
                last = -self.found[-1][0]
                self.least = last if self.least is None else max(self.least, last)


def search(tree: Tree, anchor: np.ndarray, row: int, label: int, same: bool, questions: list[Best],
           least: list[np.ndarray], most: list[np.ndarray]) -> None:
    """Answer an anchor's questions about rows of its label, or of others, in one tree.

    ``least`` and ``most`` are the anchor's bounds by level. ``row`` is the anchor itself.
    """
    top = len(tree.levels) - 1
    queue = [(-most[top][0], top, 0)]
    while queue:
        bound, level, node = heapq.heappop(queue)
        _, _, low_label, high_label = tree.levels[level]
        first, last = low_label[node], high_label[node]
        if (same and not first <= label <= last) or (not same and first == last == label):
            continue
        asked = [question for question in questions if question.wants(least[level][node], -bound)]
        if not asked:
            continue
        if level:
            for child in range(node * FANOUT, min((node + 1) * FANOUT, len(most[level - 1]))):
                heapq.heappush(queue, (-most[level - 1][child], level - 1, child))
            continue
        part = slice(tree.ends[node - 1] if node else 0, tree.ends[node])
        right = (tree.labels[part] == label) == same
        right &= tree.rows[part] != row
        scores = (tree.vectors[part] @ anchor)[right].astype(np.int64)
        for question in asked:
            question.add(scores, tree.ids[part][right], tree.rows[part][right])


def build(rows: DataFrame, tiles: int) -> DataFrame:
    """One row for each tree, packed from rows of neighbouring labels and first components: ``_TREE``.

    ``rows`` has row, vec_id, label and vector. Rows that agree in label and component are
    dealt by their number, so that many equal vectors make many tiles.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(part: pa.Table) -> pa.RecordBatch:
            lists = part.column("vector").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            vectors = np.zeros((len(sizes), max(1, int(sizes.max()))), np.int64)
            vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = values
            ids, number = part.column("vec_id").fill_null(_NO_ID).to_numpy(), part.column("row").to_numpy()
            labels = part.column("label").to_numpy().astype(np.int64)
            leaves = packed_order(vectors, labels)
            packed = np.concatenate(leaves)
            columns = [ids[packed], number[packed], labels[packed], vectors[packed], np.cumsum([len(leaf) for leaf in leaves])]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(number.min())]), pa.array([len(sizes)], pa.int32()), pa.array([vectors.shape[1]], pa.int32()),
                 *(pa.array([column.tobytes()], pa.binary()) for column in columns)],
                names=["tree", "size", "width", "ids", "rows", "labels", "vectors", "ends"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= TILE_ROWS:
                yield tree(pa.Table.from_batches(waiting))
                waiting.clear()
        if sum(map(len, waiting)):
            yield tree(pa.Table.from_batches(waiting))

    first = F.coalesce(F.get("vector", F.lit(0)), F.lit(0))
    tiled = rows.select("row", "vec_id", "label", "vector", first.alias("first")).repartitionByRange(tiles, "label", "first", "row")
    return tiled.sortWithinPartitions("label", "first").drop("first").mapInArrow(pack, _TREE)


def _trees(batches: Iterator[pa.RecordBatch], width: int, exact: bool) -> Iterator[Tree]:
    for batch in batches:
        for row in batch.to_pylist():
            vectors = np.frombuffer(row["vectors"], np.int64).reshape(row["size"], row["width"])
            if row["width"] < width:
                vectors = np.pad(vectors, ((0, 0), (0, width - row["width"])))
            ids, rows, labels, ends = (np.frombuffer(row[name], np.int64) for name in ("ids", "rows", "labels", "ends"))
            yield Tree(ids, rows, labels, vectors, ends, exact)


def _answers(trees: DataFrame, anchors: np.ndarray, rows: np.ndarray, labels: np.ndarray, same: bool, exact: bool,
             asked: list[list[tuple[int, int | None, int | None, int | None]]]) -> DataFrame:
    """The best rows of every question in every tree: ``_FOUND``.

    ``asked`` has for each anchor (how many, least score, greatest score, k-th so far).
    """
    chunk = 512

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(batches, anchors.shape[1], exact):
            found: list[tuple[int, int, int, int, int]] = []
            for at in range(0, len(anchors), chunk):
                least, most = tree.bounds(anchors[at : at + chunk])
                for i in range(at, min(at + chunk, len(anchors))):
                    questions = [Best(*one) for one in asked[i]]
                    if questions:
                        search(tree, anchors[i], rows[i], labels[i], same, questions,
                               [one[i - at] for one in least], [one[i - at] for one in most])
                    found += [(i, place, row, vec_id, -score) for place, question in enumerate(questions)
                              for score, vec_id, row in question.found]
            if found:
                place = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[0].astype(np.int32)), pa.array(place[1].astype(np.int32)), pa.array(place[2]),
                     pa.array(place[3], mask=place[3] == _NO_ID), pa.array(place[4])],
                    names=["anchor", "positive", "row", "vec_id", "score"])

    return trees.mapInArrow(answer, _FOUND)


def _in_waves(trees: DataFrame, ask, top: int) -> DataFrame:
    """The best ``top`` answers of each question over all trees, with their rank.

    ``ask(trees, bounds)`` searches some trees, given k-th scores by (anchor, positive).
    """
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    early = F.pmod(F.xxhash64("tree"), F.lit(FIRST_WAVE)) == 0
    first = frames.store(ranked(ask(trees.filter(early), {})), "first_wave")
    kth = first.filter(F.col("rank") == top).select("anchor", "positive", "score").collect()
    rest = ask(trees.filter(~early), {(row["anchor"], row["positive"]): row["score"] for row in kth})
    return frames.store(ranked(rest.union(first.drop("rank"))), "answers")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         percent: int = PERCENT, block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for every anchor and positive.

    ``rows`` has vec_id, label and vector (integers, see :func:`usable`).
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    numbered = frames.store(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    facts = numbered.agg(
        F.count("*").alias("rows"), F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", F.abs))).alias("largest"),
        F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    if not facts["anchors"]:
        return empty
    width = max(1, facts["width"])
    limit = width * int(facts["largest"] or 0) ** 2
    if limit >= 1 << 62:
        raise ValueError("Scores of these vectors do not fit into 64 bits")
    exact = limit < 1 << 53
    trees = frames.store(build(numbered, -(-facts["rows"] // TILE_ROWS)), "trees")

    result = empty
    parts = -(-facts["anchors"] // block)
    for part in range(parts):
        chosen = numbered.filter(is_anchor & (F.pmod(F.xxhash64("row"), F.lit(parts)) == part)).orderBy("row").collect()
        anchors = np.zeros((len(chosen), width), np.float64 if exact else np.int64)
        for i, row in enumerate(chosen):
            anchors[i, : len(row["vector"])] = row["vector"]
        numbers, labels = np.array([row["row"] for row in chosen]), np.array([row["label"] for row in chosen])

        def near(some: DataFrame, kth: dict) -> DataFrame:
            asked = [[(positives, None, None, kth.get((i, 0)))] for i in range(len(chosen))]
            return _answers(some, anchors, numbers, labels, True, exact, asked)

        # At most ``positives`` rows for each anchor of the block.
        found = _in_waves(trees, near, positives).select("anchor", "rank", "vec_id", "score").collect()
        by_anchor: list[list] = [[] for _ in chosen]
        for row in sorted(found, key=lambda row: row["rank"]):
            by_anchor[row["anchor"]].append(row)

        def hard(some: DataFrame, kth: dict) -> DataFrame:
            # percent * score, rounded up to the next whole score.
            asked = [[(negatives, -(-percent * row["score"] // 100), row["score"], kth.get((i, place)))
                      for place, row in enumerate(near_rows)] for i, near_rows in enumerate(by_anchor)]
            return _answers(some, anchors, numbers, labels, False, exact, asked)

        answers = _in_waves(trees, hard, negatives)
        facts_of = spark.createDataFrame(
            [(i, place, chosen[i]["vec_id"], row["vec_id"], row["score"])
             for i, near_rows in enumerate(by_anchor) for place, row in enumerate(near_rows)],
            "of_anchor int, of_positive int, anchor_id long, positive_id long, positive_score long")
        result = result.union(
            answers.join(F.broadcast(facts_of), (F.col("anchor") == F.col("of_anchor")) & (F.col("positive") == F.col("of_positive")))
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
    return result


def hard_negatives(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """:func:`mine` on an embeddings table; rows whose id is divisible by ``every`` are the anchors."""
    return mine(usable(embeddings), F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
