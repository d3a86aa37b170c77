"""Language identification by string kernels.

The kernel of two texts is the number of letter n-grams of one to three letters that
both contain (presence, not counts), over the geometric mean of their own numbers.
Letters of all scripts are read in lower case, and runs of anything else are one
separator; an n-gram's number is a hash of its code points. Nyström features are kernels
with a few landmark texts, whitened by the landmarks' own kernel matrix; a ridge
regression of -1 and 1 on them is solved for each language. Whole texts are scored in
batches by two matrix products: presence by landmarks, kernels by weights.

Only fitting reads a sample: about ``TRAIN_ROWS`` labelled rows in equal shares by
language, chosen by a hash of the id. Its n-grams, not its texts, reach the driver.

Defined cases: a null text or one without letters is ``und`` with score 0; without any
labelled row every text is; rows with a null id or language are not learned from;
repeated rows are scored alike; equal scores go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import frames

TRAIN_ROWS = 2400
LANDMARKS = 192
RIDGE = 1e-3
SEED = 23
UNKNOWN = "und"
#: Numbers of n-grams; a text of 10,000 different ones has about 1 in 100 of them share a number.
_BINS = 1 << 19
_PIECE = 1 << 18
_BATCH = 64


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lru_cache(maxsize=1)
def code_table() -> np.ndarray:
    """For each code point that of its lower case, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            table[point] = ord(letter.lower()[0])
    return table


def _number(codes: np.ndarray, size: int) -> np.ndarray:
    """The number of each n-gram of ``size`` symbols."""
    count = max(0, len(codes) - size + 1)
    mixed = np.full(count, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ codes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(16)).astype(np.int64) % _BINS


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Numbers of the n-grams of a text, in pieces that overlap by two symbols; none without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([[0], code_table()[points], [0]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]
    if not codes.any():
        return
    for at in range(0, max(1, len(codes) - 2), _PIECE):
        part = codes[at : at + _PIECE + 2]
        yield _number(part[part > 0], 1)
        yield _number(part, 2)
        yield _number(part, 3)


class _Presence:
    """Marks the n-grams of one text after another in the same array."""

    def __init__(self):
        self.seen = np.zeros(_BINS, bool)

    def of(self, text: str | None, wanted: np.ndarray | None) -> tuple[np.ndarray, int]:
        """Flags of the wanted n-grams (or all present ones), and how many there are."""
        parts = list(ngrams(text))
        for part in parts:
            self.seen[part] = True
        found = np.flatnonzero(self.seen) if wanted is None else self.seen[wanted]
        number = int(np.count_nonzero(self.seen)) if parts else 0
        for part in parts:
            self.seen[part] = False
        return found, number


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray
    #: n-grams by landmarks, each divided by the root of the landmark's number.
    landmarks: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        presence = _Presence()
        names, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), _BATCH):
            part = texts[at : at + _BATCH]
            flags = np.zeros((len(part), len(self.vocabulary)), np.float32)
            numbers = np.zeros(len(part))
            for i, text in enumerate(part):
                flags[i], numbers[i] = presence.of(text, self.vocabulary)
            kernels = (flags @ self.landmarks) / np.sqrt(np.maximum(numbers, 1))[:, None]
            values = kernels @ self.weights
            best = values.argmax(1)
            known = numbers > 0
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores[at : at + len(part)] = np.where(known, np.clip((values.max(1) + 1) / 2, 0, 1), 0)
        return names, scores


def train(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS,
          ridge: float = RIDGE) -> Model | None:
    """Fit on (language, n-grams) pairs; landmarks are spread evenly over them."""
    rows = [row for row in rows if len(row[1])]
    if not rows:
        return None
    languages = sorted({language for language, _ in rows})
    by_language = [[grams for language, grams in rows if language == name] for name in languages]
    each = -(-landmarks // len(languages))
    chosen = [grams for found in by_language for grams in found[:each]]
    vocabulary = np.unique(np.concatenate(chosen))
    columns = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for i, grams in enumerate(chosen):
        columns[np.searchsorted(vocabulary, grams), i] = 1
    columns /= np.sqrt([len(grams) for grams in chosen]).astype(np.float32)
    own = (columns.T @ columns).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = np.zeros((len(rows), len(chosen)))
    for at in range(0, len(rows), _BATCH):
        flags = np.zeros((len(rows[at : at + _BATCH]), len(vocabulary)), np.float32)
        for i, (_, grams) in enumerate(rows[at : at + _BATCH]):
            place = np.searchsorted(vocabulary, grams)
            place[place == len(vocabulary)] = 0
            flags[i, place[vocabulary[place] == grams]] = 1
            flags[i] /= np.sqrt(len(grams))
        features[at : at + len(flags)] = (flags @ columns) @ whiten
    goal = np.array([[1.0 if language == name else -1.0 for name in languages] for language, _ in rows])
    # Each language counts alike, however many rows it has.
    shares = np.array([1 / len(by_language[languages.index(language)]) for language, _ in rows])
    shares *= len(rows) / shares.sum()
    square = features.T @ (features * shares[:, None]) + ridge * len(rows) * np.eye(len(chosen))
    weights = whiten @ np.linalg.solve(square, features.T @ (goal * shares[:, None]))
    return Model(languages, vocabulary, columns, weights)


def fit(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from ``text`` and ``lang`` of a bounded sample of the usable labelled rows."""
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, rows // len(counts))
    shares = docs.sparkSession.createDataFrame(
        [(lang, min(1 << 20, int(each / n * (1 << 20)) + 1)) for lang, n in counts.items()], "known string, share long")
    slot = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20))
    sample = frames.store(
        labelled.select("doc_id", "lang", "text", slot.alias("slot"))
        .join(frames.small_or_plain(shares, len(counts)), (F.col("lang") == F.col("known")) & (F.col("slot") < F.col("share")))
        .select("doc_id", "slot", "lang", "text"), "sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = _Presence()
        for batch in batches:
            grams = []
            for text in batch.column(3).to_pylist():
                found, number = presence.of(text, None)
                grams.append(found.astype(np.int32).tobytes() if number else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2)), pa.array(grams, pa.binary())],
                                             names=["doc_id", "slot", "lang", "grams"])

    found = sample.mapInArrow(present, "doc_id long, slot long, lang string, grams binary").collect()
    found.sort(key=lambda row: (row["slot"], row["doc_id"], row["lang"]))
    taken: dict[str, list[bytes]] = {}
    for row in found:
        if row["grams"] and len(taken.setdefault(row["lang"], [])) < each:
            taken[row["lang"]].append(bytes(row["grams"]))
    pairs = [(lang, np.frombuffer(grams, np.int32)) for lang in sorted(taken) for grams in taken[lang]]
    return train(pairs, landmarks)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Columns doc_id, lang_pred and score for each row; reads doc_id and text only."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = model.score(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    rows = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                        F.col(f"`{lang}`").cast("string").alias("lang"))
    model = fit(rows, ~held_out(F.col("doc_id")))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
