"""Quality rules judged by an isolation forest on rule statistics.

Each text gets rule counts (``rules``). Fixed base rules fail texts of under 50
words and texts more than half of which repeats. For the rest, the excess of each
statistic over its rule's limit is a coordinate, so what is within all limits is usual;
random axis-parallel splits of small subsamples isolate unusual points early, and a
short mean path marks an anomaly. Splits are drawn from the whole span that an axis
can have, not from the sample's alone, so a kind of junk that no sampled row shows
is isolated too. The score above which a text is rejected is calibrated on labelled rows.

All counts cover whole texts and all rows. Only fitting reads a sample: at most
about ``FIT_ROWS`` rows labelled clean that pass the base rules (any labelled rows, or
all rows, where there are none), chosen by a hash of their id.

Defined cases: a null or empty text has zero counts and fails the base rules;
repeated rows are judged alike; a label without a document, a null label and a
null id take no part in fitting; without labels of both kinds the threshold is
``DEFAULT_THRESHOLD``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import frames
from spendframe.llm.rules import COUNTS, rule_counts

FIT_ROWS = 8192
TREES = 100
SUBSAMPLE = 256
SEED = 11
DEFAULT_THRESHOLD = 0.4
#: How far each coordinate can be expected to reach, by its rule; a sample that reaches further counts.
SPANS = (1.0, 10.0, 0.7, 0.2, 0.8, 0.5, 0.8)
#: Losing one share of clean labelled rows counts as much as missing so many shares of bad ones.
CLEAN_WEIGHT = 10.0
BINS = 4096
MIN_WORDS = 50


def rule_table(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Id, digest of the text and rule counts of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = rule_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(counts[name], pa.int64()) for name in COUNTS)],
                names=["doc_id", "content", *COUNTS])

    rows = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"),
                        frames.content_key(F.col(f"`{text}`")).alias("content"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    schema = "doc_id long, content long, " + ", ".join(f"{name} long" for name in COUNTS)
    return rows.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def coordinates(counts: dict[str, np.ndarray]) -> np.ndarray:
    """How far each rule statistic is beyond its rule's limit; zero within it."""
    words = np.maximum(1, counts["n_words"])
    chars = np.maximum(1, counts["word_chars"])
    lines = np.maximum(1, counts["n_lines"])
    length = counts["word_chars"] / words
    return np.stack([
        np.maximum(0, counts["n_symbols"] / words - 0.1),
        np.maximum(0, length - 10) + np.maximum(0, 3 - length),
        np.maximum(0, counts["n_dup_lines"] / lines - 0.3),
        np.maximum(0, counts["n_repeat_words"] / words - 0.3),
        np.maximum(0, counts["n_upper"] / chars - 0.2),
        np.maximum(0, counts["n_marks"] / words - 0.5),
        np.maximum(0, counts["n_digits"] / chars - 0.2),
    ], axis=1)


def _mean_path(rows: int) -> float:
    """Mean path length of an unsuccessful search among so many points."""
    if rows <= 1:
        return 0.0
    return 1.0 if rows == 2 else 2 * (np.log(rows - 1) + np.euler_gamma) - 2 * (rows - 1) / rows


@dataclass
class Forest:
    """Trees side by side: node tables of split axis (-1: leaf), value, children, path length."""

    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    scale: float
    depth: int

    @classmethod
    def fit(cls, points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED,
            spans: Sequence[float] | None = None) -> Forest:
        """Axes are split up to the sample's highest value or the axis's span, whichever is more."""
        reach = np.zeros(points.shape[1]) if spans is None else np.array(spans, float)
        rng = np.random.default_rng(seed)
        size = min(subsample, len(points))
        limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes: list[list[float]] = []
        roots = []
        for _ in range(trees):
            roots.append(len(nodes))
            nodes.append([])
            chosen = points[rng.choice(len(points), size, replace=False)]
            waiting = [(len(nodes) - 1, chosen, reach, 0)]
            while waiting:
                at, inside, top, depth = waiting.pop()
                low = inside.min(0) if len(inside) else np.zeros(1)
                high = np.maximum(inside.max(0), top) if len(inside) else low
                open_axes = np.flatnonzero(high > low)
                if depth >= limit or len(inside) <= 1 or not len(open_axes):
                    nodes[at] = [-1, 0.0, 0, 0, depth + _mean_path(len(inside))]
                    continue
                axis = int(rng.choice(open_axes))
                value = float(rng.uniform(low[axis], high[axis]))
                below = inside[:, axis] < value
                nodes[at] = [axis, value, len(nodes), len(nodes) + 1, 0.0]
                nodes += [[], []]
                lower = top.copy()
                lower[axis] = min(lower[axis], value)
                waiting += [(len(nodes) - 2, inside[below], lower, depth + 1),
                            (len(nodes) - 1, inside[~below], top, depth + 1)]
        parts = np.array(nodes, float).T
        return cls(parts[0].astype(int), parts[1], parts[2].astype(int), parts[3].astype(int), parts[4],
                   np.array(roots), max(_mean_path(size), 1e-9), limit)

    def score(self, points: np.ndarray) -> np.ndarray:
        """Anomaly score between 0 and 1 of each point; higher is more unusual."""
        # Clean rows share the point of no excess, so that each different point is walked once.
        unique, place = np.unique(points, axis=0, return_inverse=True)
        lengths = np.zeros(len(unique))
        rows = np.arange(len(unique))
        for root in self.roots:
            at = np.full(len(unique), root)
            for _ in range(self.depth):
                axis = self.axis[at]
                inner = axis >= 0
                if not inner.any():
                    break
                below = unique[rows, np.maximum(axis, 0)] < self.value[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            lengths += self.length[at]
        total = lengths[place.reshape(-1)] / len(self.roots)
        return 2.0 ** (-total / self.scale)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(name).to_numpy(zero_copy_only=False) for name in COUNTS}


def score_table(counts: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of a rule table with ``base_failed`` and ``score``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = (forest.score(coordinates(_columns(batch))) if forest is not None and len(batch)
                     else np.full(len(batch), 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, "score"])

    rows = counts.withColumn("base_failed", base_failed())
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes) + ", score double"
    return rows.mapInArrow(judge, schema)


def fit_forest(counts: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS) -> Forest | None:
    """Fit on about ``rows`` rows that pass the base rules: labelled clean, else labelled, else any."""
    for source in (labelled.filter("quality = 1"), labelled, counts):
        source = source.filter(~base_failed())
        total = source.count()
        if total:
            share = min(1.0, rows / total)
            chosen = F.pmod(F.xxhash64("doc_id", "content", F.lit(SEED)), F.lit(1 << 20)) < round(share * (1 << 20)) + 1
            sample = source.filter(chosen).orderBy("doc_id", "content").select(*COUNTS).limit(2 * rows).toPandas()
            if len(sample) >= 2:
                return Forest.fit(coordinates({name: sample[name].to_numpy() for name in COUNTS}), spans=SPANS)
    return None


def calibrate(scored: DataFrame) -> float:
    """The score that best parts labelled rows of quality 0 from those of quality 1.

    Counts of both kinds by score are summed up in Spark over all labelled rows that
    pass the base rules; only ``BINS`` sums reach the driver. Of equally good
    thresholds the middle of the widest run is taken.
    """
    sums = (
        scored.filter(~F.col("base_failed"))
        .groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"))
        .agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"),
             F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("clean"))
        .collect()
    )
    bad, clean = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for row in sums:
        bad[row["bin"]], clean[row["bin"]] = row["bad"], row["clean"]
    if not bad.sum() or not clean.sum():
        return DEFAULT_THRESHOLD
    caught = np.cumsum(bad[::-1])[::-1] / bad.sum()
    lost = np.cumsum(clean[::-1])[::-1] / clean.sum()
    gain = caught - CLEAN_WEIGHT * lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) / 2 / BINS)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rule counts, ``base_failed``, ``score`` and ``kept`` of every row of ``docs``.

    ``labels`` has doc_id and quality (1: clean, 0: not). The rule counts are stored
    once; fitting, calibration and the verdict read that narrow table.
    """
    counts = frames.store(rule_table(docs, text, id), "rules")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    labelled = counts.join(known, "doc_id")
    forest = fit_forest(counts, labelled)
    threshold = calibrate(score_table(labelled, forest)) if forest is not None else DEFAULT_THRESHOLD
    scored = score_table(counts, forest)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    gone = judge(docs, labels).filter(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_key")).distinct()
    return frames.without(docs, frames.store(gone, "rejected"))
