"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its n-grams of ``SIZES`` characters, in lower case, with everything
of ASCII that is no letter or digit as a space. Each n-gram of the vocabulary has a
ratio, the logarithm of its share among n-grams of toxic texts over that among others;
a text's features are the ratios of the n-grams it holds, and a logistic regression with
a ridge penalty weighs them. A frequent n-gram of no side has a ratio near 0, so that a
few telling ones decide even in a very long text.

The vocabulary and the regression are fitted on a bounded sample of labelled rows, at most
about ``SAMPLE_ROWS``, half of each kind where there are so many; the regression weighs
each kind by the rows it stands for. The counts behind the ratios cover all labelled rows
that may be learned from. Whole texts are scored, without a shuffle.

Defined cases: a null or empty text has no n-grams and gets the score of the intercept;
labels without a document, other than 0 and 1, or null, and rows with a null id, are not
learned from; each row of a repeated label counts; without labels of both kinds every
score is the share of toxic labels, 0 if there is none; repeated texts score alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import arrays, frames

SIZES = (3, 4, 5)
SAMPLE_ROWS = 4000
VOCABULARY = 8192
LEAST_TEXTS = 5
#: An n-gram of the vocabulary has at least this G statistic (chance gives it once in 10^5).
LEAST_TELLING = 19.5
SMOOTHING = 1.0
RIDGE = 1.0
SEED = 41
_PIECE = 1 << 18
_FIELD_BITS = 22
_PARTS = 64
_LIMBS = np.random.default_rng(12).integers(0, 1 << 63, max(SIZES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = ord(" ")
_PLAIN[0] = 0


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts in groups of bounded size; a long text is cut, with an overlap."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        text = f" {text} " if text else ""
        for at in range(0, len(text), _PIECE):
            part = text[at : at + _PIECE + max(SIZES) - 1]
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= _PIECE:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and 64-bit hash of every n-gram, for groups of texts or parts of one."""
    for rows, parts in _pieces(texts):
        # A zero parts the texts; no n-gram runs across one.
        parts = [part.lower() for part in parts]
        codes = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes).astype(np.uint64)
        ends = np.flatnonzero(codes == 0)
        number = np.zeros(len(codes) + 1, np.int32)
        number[ends + 1] = 1
        number = np.cumsum(number)
        lengths = np.cumsum([len(part) + 1 for part in parts])
        found_rows, found = [], []
        sums = np.zeros(len(codes), np.uint64)
        for size in range(1, max(SIZES) + 1):
            if len(codes) < size:
                break
            sums = sums[: len(codes) - size + 1] + codes[size - 1 :] * _LIMBS[size - 1]
            if size in SIZES:
                whole = np.flatnonzero(number[size:] == number[: len(codes) - size + 1])
                found.append(arrays.mix(sums[whole] + np.uint64(size)))
                found_rows.append(np.searchsorted(lengths, whole, "right"))
        if found:
            yield np.array(rows)[np.concatenate(found_rows)], np.concatenate(found)


def _distinct(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of one n-gram of each kind in each row."""
    both = arrays.mix(keys ^ ((rows + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.unique(both, return_index=True)[1]


class Known:
    """The n-grams of the vocabulary; a bit field passes over most others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.field = np.zeros(1 << _FIELD_BITS, bool)
        self.field[(self.keys >> np.uint64(64 - _FIELD_BITS)).astype(np.int64)] = True

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of each known n-gram that a text holds, once for each text."""
        size = max(1, len(self.keys))
        found = [np.empty(0, np.int64)]
        for rows, keys in ngrams(texts):
            places = np.flatnonzero(self.field[(keys >> np.uint64(64 - _FIELD_BITS)).astype(np.int64)])
            if len(places) and len(self.keys):
                number = np.minimum(np.searchsorted(self.keys, keys[places]), size - 1)
                right = self.keys[number] == keys[places]
                found.append(np.unique(rows[places][right] * size + number[right]))
        pairs = np.unique(np.concatenate(found))
        return pairs // size, pairs % size


@dataclass
class Model:
    known: Known
    #: Ratio times weight of each n-gram of the vocabulary.
    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows, numbers = self.known.of(texts)
        values = self.intercept + np.bincount(rows, self.weights[numbers], len(texts))
        return 1 / (1 + np.exp(-np.clip(values, -500, 500)))


def ratios(toxic: np.ndarray, other: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Naive Bayes log-count ratios of n-grams from the texts of each kind that hold them."""
    one, two = toxic + smoothing, other + smoothing
    return np.log((one / one.sum()) / (two / two.sum()))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, goal: np.ndarray, shares: np.ndarray,
             size: int, ridge: float = RIDGE, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on sparse features, by L-BFGS.

    The loss is the weighted sum over rows plus half of ``ridge`` times the squared norm
    of the weights; the intercept is not penalized.
    """
    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        margin = goal * (point[-1] + np.bincount(rows, values * point[columns], len(goal)))
        slope = -goal * shares / (1 + np.exp(np.clip(margin, -500, 500)))
        gradient = np.append(np.bincount(columns, values * slope[rows], size) + ridge * point[:-1], slope.sum())
        return float((shares * np.logaddexp(0, -margin)).sum() + ridge / 2 * (point[:-1] ** 2).sum()), gradient

    point = np.zeros(size + 1)
    now, gradient = loss(point)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, pulled = -gradient, []
        for move, change in reversed(past):
            part = move @ step / (move @ change)
            pulled.append(part)
            step = step - part * change
        if past:
            move, change = past[-1]
            step = step * (move @ change / (change @ change))
        else:
            step = step / max(1.0, np.linalg.norm(gradient))
        for (move, change), part in zip(past, reversed(pulled), strict=True):
            step = step + (part - change @ step / (move @ change)) * move
        rate, slope = 1.0, gradient @ step
        while rate > 1e-10:
            then, bent = loss(point + rate * step)
            if then <= now + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        move, change = rate * step, bent - gradient
        if move @ change > 1e-12:
            past = [*past[-9:], (move, change)]
        done = now - then < 1e-7 * max(1.0, abs(now))
        point, now, gradient = point + move, then, bent
        if done:
            break
    return point[:-1], float(point[-1])


def _vocabulary(sample: DataFrame, size: int, least: int) -> np.ndarray:
    """The n-grams of the sample that tell its kinds apart best, by the G statistic.

    ``sample`` has text and toxic. Each task counts the texts of either kind that hold an
    n-gram and packs its counts by hash range; a group adds up one range.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for group_rows, group_keys in ngrams(batch.column(0).to_pylist()):
                once = _distinct(group_rows, group_keys)
                rows.append(group_rows[once])
                keys.append(group_keys[once])
            all_rows, all_keys = np.concatenate(rows), np.concatenate(keys)
            once = _distinct(all_rows, all_keys)
            unique, place = np.unique(all_keys[once], return_inverse=True)
            bad = np.bincount(place, toxic[all_rows[once]], len(unique)).astype(np.int32)
            every = np.bincount(place, minlength=len(unique)).astype(np.int32)
            part = (unique >> np.uint64(58)).astype(np.int64)
            bounds = np.searchsorted(part, np.arange(_PARTS + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(_PARTS, dtype=np.int64)),
                 *(pa.array([column[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                   for column in (unique, bad, every))], names=["part", "keys", "bad", "every"])

    totals = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def add(packs: pa.Table) -> pa.Table:
        keys, bad, every = (np.frombuffer(b"".join(packs.column(name).to_pylist()), kind)
                            for name, kind in (("keys", np.uint64), ("bad", np.int32), ("every", np.int32)))
        unique, place = np.unique(keys, return_inverse=True)
        with_bad, with_any = np.bincount(place, bad, len(unique)), np.bincount(place, every, len(unique))
        n_bad, n_all = totals.get(1, 0), sum(totals.values())

        def part(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
            return found * np.log(np.maximum(found, 1e-300) / np.maximum(expected, 1e-300))

        held, n_good = with_any - with_bad, n_all - n_bad
        tells = 2 * (part(with_bad, with_any * n_bad / n_all) + part(held, with_any * n_good / n_all)
                     + part(n_bad - with_bad, (n_all - with_any) * n_bad / n_all)
                     + part(n_good - held, (n_all - with_any) * n_good / n_all))
        enough = (with_any >= least) & (tells >= LEAST_TELLING)
        return pa.table({"key": unique[enough].view(np.int64), "tells": tells[enough]})

    packs = sample.select("text", "toxic").mapInArrow(pack, "part long, keys binary, bad binary, every binary")
    counted = packs.groupBy("part").applyInArrow(add, "key long, tells double")
    return np.array([row["key"] for row in counted.orderBy(F.desc("tells"), "key").limit(size).collect()], np.int64).view(np.uint64)


def _holders(labelled: DataFrame, known: Known) -> np.ndarray:
    """For other and toxic texts, how many of all labelled ones hold each known n-gram."""
    size = len(known.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            rows, numbers = known.of(batch.column(0).to_pylist())
            toxic = batch.column(1).to_numpy(zero_copy_only=False)[rows]
            for kind in (0, 1):
                sums[kind] += np.bincount(numbers[toxic == kind], minlength=size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array([sums[0].tobytes(), sums[1].tobytes()], pa.binary())], names=["kind", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for sums in parts.column("sums"):
            total += np.frombuffer(sums.as_py(), np.int64)
        return pa.table({"kind": parts.column("kind").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    counted = labelled.select("text", "toxic").mapInArrow(count, "kind int, sums binary")
    # First within 64 shares of the tasks, so that no group gathers a row of every task.
    shared = counted.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(_PARTS)))
    first = shared.groupBy("kind", "share").applyInArrow(add, "kind int, sums binary")
    found = np.zeros((2, size))
    for row in first.collect():
        found[row["kind"]] += np.frombuffer(row["sums"], np.int64)
    return found


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = VOCABULARY,
        least: int = LEAST_TEXTS) -> Model | float:
    """A model, or the share of toxic labels where they are not of both kinds.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. Held-out ids are left out here.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("labelled_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("labelled_id")))
    totals = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return float(bool(totals.get(1)))

    def with_text(chosen: DataFrame, count: int | None = None) -> DataFrame:
        return docs.join(frames.small_or_plain(chosen, count), F.col("doc_id") == F.col("labelled_id")).select(
            "doc_id", "text", "toxic")

    slot = F.pmod(F.xxhash64("labelled_id", F.lit(SEED)), F.lit(1 << 20))
    wanted = {kind: max(rows // 2, rows - totals[1 - kind]) for kind in (0, 1)}
    share = F.when(F.col("toxic") == 1, int(wanted[1] / totals[1] * (1 << 20)) + 1).otherwise(int(wanted[0] / totals[0] * (1 << 20)) + 1)
    sample = frames.store(with_text(known.filter(slot < share)), "toxic_sample")
    counted = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counted) < 2:
        return totals[1] / (totals[0] + totals[1])
    vocabulary = Known(_vocabulary(sample, size, least))
    other, toxic = _holders(with_text(known), vocabulary)
    ratio = ratios(toxic, other)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, numbers = vocabulary.of(batch.column(1).to_pylist())
            parts = np.split(numbers.astype(np.int32), np.searchsorted(found, np.arange(1, len(batch))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([part.tobytes() for part in parts], pa.binary())],
                names=["doc_id", "toxic", "numbers"])

    made = sample.mapInArrow(features, "doc_id long, toxic int, numbers binary").collect()
    made.sort(key=lambda row: (row["doc_id"], row["toxic"], row["numbers"]))
    lists = [np.frombuffer(row["numbers"], np.int32) for row in made]
    kinds = np.array([row["toxic"] for row in made])
    # Each kind counts by its share of all labels, scaled to the size of the sample.
    weight = {kind: totals[kind] / counted[kind] * len(made) / (totals[0] + totals[1]) for kind in (0, 1)}
    columns = np.concatenate(lists).astype(np.int64)
    weights, intercept = logistic(np.repeat(np.arange(len(lists)), [len(part) for part in lists]), columns, ratio[columns],
                                  np.where(kinds == 1, 1.0, -1.0), np.where(kinds == 1, weight[1], weight[0]), len(ratio))
    return Model(vocabulary, weights * ratio, intercept)


def predict(docs: DataFrame, model: Model | float) -> DataFrame:
    """Columns doc_id and score for each row; reads doc_id and text only."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column(1).to_pylist()) if isinstance(model, Model) else np.full(len(batch), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Learn from the labelled rows that are not held out, score all: doc_id, held_out, score, predicted."""
    rows = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    scored = predict(rows, fit(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
