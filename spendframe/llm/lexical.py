"""Ranked lexical search: the best documents of each query by norm buckets.

A document is a vector of impacts, one for each of its terms, a query one of weights,
and the score is their inner product. Impacts and weights are integers; BM25 gives the
shape of both. Only terms of some query matter, so vectors hold just these.

1. One pass over the texts counts terms; documents, their lengths and the documents of
   each term are summed up over all of them.
2. Vectors are ordered by their norm, longest first, and stored. They are searched in
   waves of falling norm: what a wave leaves as k-th score of each query bounds the next
   one, and vectors too short for every query are not read at all.
3. A task cuts its vectors into buckets. Where a query's norm times the norm of the
   longest vector is below the query's k-th score, the bucket is passed over (Cauchy and
   Schwarz).
4. Inside a bucket a query's largest coordinates are looked at, so many that the norm of
   the others, times the longest vector, stays below the k-th score: a document without
   any of these cannot reach it. For the others the products seen so far and the norms
   of what is left on both sides bound the score.
5. What passes that bound is scored again in 64-bit integers.

Bounds are doubles and are raised by one part in 10^9, so that rounding loses nothing;
equal scores are kept until ids decide. Terms are known by 64-bit hashes: among 10^5
terms of queries and 10^9 different words the odds that any two share one are about
5 in 10^6. Queries are a stated set, read in blocks of ``QUERY_BLOCK`` rows.

Defined cases: a null text, or one without a term, is no document and is not counted; a
query without known terms has no rows; repeated documents and queries count as rows of
their own; equal scores go by ascending id, without an id last; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendframe.llm import arrays, frames

TOP = 20
QUERY_BLOCK = 4096
BUCKET_ROWS = 2048
#: Shares of the vectors, by falling norm, at which a wave ends.
WAVES = (0.02, 0.25)
_FIELD_BITS = 20
_SLACK = 1 + 1e-9
_NO_ID = np.iinfo(np.int64).max

_COUNTS = "doc_id long, n long, terms array<int>, times array<int>"
_VECTORS = "doc_id long, norm double, tie int, terms array<int>, impacts array<int>"
_FOUND = "place int, doc_id long, score long"


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of rows: the first row, the term hashes, and each row's first term."""
    data, bounds = arrays.utf8(column)
    for low, high in arrays.groups(bounds):
        rows = bounds[low : high + 1]
        hashes, begins, _ = arrays.words(data, rows, arrays.NOT_ALNUM, arrays.FOLDED)
        yield low, hashes, arrays.firsts(begins, rows)


class Vocabulary:
    """The terms of a block of queries; a bit field passes over most other words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.field = np.zeros(1 << _FIELD_BITS, bool)
        self.field[(self.hashes >> np.uint64(64 - _FIELD_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a known term, and the number of the term."""
        places = np.flatnonzero(self.field[(hashes >> np.uint64(64 - _FIELD_BITS)).astype(np.int64)])
        if not len(places) or not len(self.hashes):
            return places[:0], places[:0]
        number = np.minimum(np.searchsorted(self.hashes, hashes[places]), len(self.hashes) - 1)
        known = self.hashes[number] == hashes[places]
        return places[known], number[known]


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))


def term_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Length and counts of the known terms of every text that has a term: ``_COUNTS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary.hashes))
        for batch in batches:
            for low, hashes, first in _hashed(batch.column(1)):
                n = np.diff(first)
                places, number = vocabulary.find(hashes)
                row = np.searchsorted(first, places, "right") - 1
                pairs, times = np.unique(row * size + number, return_counts=True)
                held = np.bincount(pairs // size, minlength=len(n))
                some = n > 0
                ids = batch.column(0).slice(low, len(n)).filter(pa.array(some))
                # Rows without any term hold no pairs, so the lists stay aligned.
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n[some]), _list(pairs % size, held[some]), _list(times, held[some])],
                    names=["doc_id", "n", "terms", "times"])

    return docs.select("doc_id", "text").mapInArrow(count, _COUNTS)


def impact(times: np.ndarray, length_factor: np.ndarray) -> np.ndarray:
    """Thousandths of the saturation of a term's occurrences, times 1000, in integers."""
    return (1_000_000_000 * times) // (1000 * times + 12 * length_factor)


def length_factors(lengths: list[int], documents: int, words: int) -> np.ndarray:
    """Hundredths by which a text's length, against the mean, weakens its terms."""
    # Python integers: length times documents can pass 64 bits.
    return np.array([75 + 25 * n * documents // words for n in lengths], np.int64)


def vectors(counts: DataFrame, documents: int, words: int) -> DataFrame:
    """Impact vectors with their norms, for texts with a known term: ``_VECTORS``."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            times = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            factor = np.repeat(length_factors(batch.column(1).to_pylist(), documents, words), held)
            impacts = impact(times, factor)
            squares = np.add.reduceat(impacts.astype(float) ** 2, np.cumsum(held) - held) if len(held) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.sqrt(squares) * _SLACK), pa.array(np.arange(len(batch), dtype=np.int32)),
                 batch.column(2), _list(impacts, held)], names=["doc_id", "norm", "tie", "terms", "impacts"])

    return counts.filter(F.size("terms") > 0).mapInArrow(weigh, _VECTORS)


class Queries:
    """Weights of a block of queries, each query's largest first, and the norms of the rest."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.size = len(weights)
        self.terms, self.weights, self.rest = [], [], []
        for numbers in terms:
            unique, times = np.unique(numbers, return_counts=True)
            weight = weights[unique] * times
            order = np.argsort(-weight, kind="stable")
            order = order[weight[order] > 0]
            weight = weight[order]
            self.terms.append(unique[order])
            self.weights.append(weight)
            squares = np.append(weight.astype(float) ** 2, 0.0)
            self.rest.append(np.sqrt(np.cumsum(squares[::-1])[::-1]) * _SLACK)


class Best:
    """The best rows of one query: scores, ids, and the k-th score once there are k."""

    def __init__(self, top: int, least: int):
        self.top, self.least = top, max(1, least)
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = max(self.least, int(self.scores[-1]))


class Bucket:
    """Some vectors, by document and by term."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, held: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int):
        self.ids, self.norms, self.terms, self.impacts = ids, norms, terms, impacts
        self.ends = np.cumsum(held)
        self.starts = self.ends - held
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), held)[order]
        self.by_term = impacts[order].astype(float)
        self.at = np.searchsorted(terms[order], np.arange(size + 1))
        self.longest = float(norms.max()) if len(norms) else 0.0

    def _entries(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = ends - starts
        which = np.repeat(np.arange(len(sizes)), sizes)
        return which, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)

    def search(self, terms: np.ndarray, weights: np.ndarray, rest: np.ndarray, least: int, dense: np.ndarray) -> np.ndarray:
        """Rows of the bucket that can reach ``least``, with their exact scores, as two rows."""
        # The first so many coordinates that those behind them cannot make up for none of them.
        focus = int(np.count_nonzero(rest * self.longest * _SLACK >= least))
        if not focus:
            return np.empty((2, 0), np.int64)
        focus = min(focus, len(terms))
        which, places = self._entries(self.at[terms[:focus]], self.at[terms[:focus] + 1])
        rows, impacts = self.rows[places], self.by_term[places]
        seen = np.bincount(rows, impacts * weights[:focus][which], len(self.ids))
        squares = np.bincount(rows, impacts * impacts, len(self.ids))
        left = np.sqrt(np.maximum(self.norms**2 - squares, 0)) * rest[focus]
        hopeful = np.flatnonzero((squares > 0) & ((seen + left) * _SLACK >= least))
        if not len(hopeful):
            return np.empty((2, 0), np.int64)
        dense[terms] = weights
        which, places = self._entries(self.starts[hopeful], self.ends[hopeful])
        products = dense[self.terms[places]] * self.impacts[places]
        sizes = self.ends[hopeful] - self.starts[hopeful]
        scores = np.add.reduceat(products, np.cumsum(sizes) - sizes)
        dense[terms] = 0
        reached = scores >= least
        return np.stack([hopeful[reached], scores[reached]])


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Bucket]:
    waiting: list[pa.RecordBatch] = []

    def made() -> Bucket:
        table = pa.Table.from_batches(waiting).combine_chunks()
        lists = table.column("terms").combine_chunks()
        return Bucket(
            table.column("doc_id").fill_null(_NO_ID).to_numpy(), table.column("norm").to_numpy(),
            lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False),
            table.column("impacts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64), size)

    for batch in batches:
        for start in range(0, len(batch), BUCKET_ROWS):
            waiting.append(batch.slice(start, BUCKET_ROWS))
            if sum(map(len, waiting)) >= BUCKET_ROWS:
                yield made()
                waiting.clear()
    if waiting:
        yield made()


def _search(stored: DataFrame, queries: Queries, bounds: list[int], top: int) -> DataFrame:
    """The best rows of each query in each partition: ``_FOUND``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top, bound) for bound in bounds]
        dense = np.zeros(queries.size, np.int64)
        for bucket in _buckets(batches, queries.size):
            for one, terms, weights, rest in zip(best, queries.terms, queries.weights, queries.rest, strict=True):
                rows, scores = bucket.search(terms, weights, rest, one.least, dense)
                if len(rows):
                    one.add(scores, bucket.ids[rows])
        place = np.repeat(np.arange(len(best)), [len(one.ids) for one in best])
        ids = np.concatenate([one.ids for one in best]) if best else np.empty(0, np.int64)
        scores = np.concatenate([one.scores for one in best]) if best else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["place", "doc_id", "score"])

    return stored.mapInArrow(search, _FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each query; Spark limits each partition before the shuffle."""
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block(docs: DataFrame, ids: list[int], texts: list[str | None], top: int) -> DataFrame | None:
    hashed = [(hashes, first) for _, hashes, first in _hashed(pa.array(texts, pa.string()))]
    terms = [part for hashes, first in hashed for part in np.split(hashes, first[1:-1])]
    vocabulary = Vocabulary(np.concatenate(terms) if terms else np.empty(0, np.uint64))
    if not len(vocabulary.hashes):
        return None
    counts = frames.store(term_counts(docs, vocabulary), "terms")
    sums = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    if not sums["documents"]:
        return None
    held = np.zeros(len(vocabulary.hashes), np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        held[row["term"]] = row["n"]
    weights = np.array([math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    queries = Queries([vocabulary.find(part)[1] for part in terms], weights)

    impacts = vectors(counts, sums["documents"], sums["words"])
    ordered = impacts.repartitionByRange(F.desc("norm"), "tie").sortWithinPartitions(F.desc("norm"))
    stored = frames.store(ordered.drop("tie"), "vectors")
    edges = [float("inf"), *sorted(stored.approxQuantile("norm", [1 - share for share in WAVES], 0.005), reverse=True)]
    bounds, kept = [1] * len(texts), None
    for high, low in zip(edges, [*edges[1:], -1.0], strict=True):
        # Shorter vectors than this reach no query's k-th score.
        least = min((bound / float(rest[0]) for bound, rest in zip(bounds, queries.rest, strict=True) if rest[0] > 0), default=math.inf)
        part = stored.filter((F.col("norm") < high) & (F.col("norm") >= max(low, least / _SLACK)))
        found = _search(part, queries, bounds, top)
        kept = frames.store(_ranked(found if kept is None else found.union(kept.drop("rank")), top), "ranked")
        for row in kept.filter(F.col("rank") == top).select("place", "score").collect():
            bounds[row["place"]] = max(bounds[row["place"]], row["score"])
    frames.discard(counts)
    frames.discard(stored)
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "query int, item_id long")
    return kept.join(F.broadcast(names), F.col("place") == F.col("query")).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP, text: str = "text", id: str = "doc_id",
                  block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` best documents of each query.

    ``queries`` has item_id and text. Scores are above 0; fewer rows mean that no more
    documents share a term with the query.
    """
    rows = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"),
                        F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # A little room, so that blocks by hash stay within the bound.
    parts = -(-asked.count() // block)
    parts = parts if parts <= 1 else 2 * parts
    found = None
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        ranked = _block(rows, [row["item_id"] for row in mine], [row["text"] for row in mine], top)
        if ranked is not None:
            found = ranked if found is None else found.union(ranked)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
