"""Benchmark decontamination by item-sized windows and SimHash fingerprints.

Words are runs of letters and digits, A-Z as a-z. For an item of L words every window
of L words of every text is compared, as a multiset of five-word shingles:

1. A window that holds too few shingles of items of its size cannot be similar enough
   to one of them and is passed over.
2. The others get a 64-bit SimHash. Fingerprints are cut into four blocks of 16 bits.
   If two differ in at most ``RADIUS`` bits, some block differs in at most four, so
   looking up all such variants of each block in the block's table of items of that
   length finds every item within the radius.
3. The weighted Jaccard similarity (shared over united multiplicities) of each
   candidate is computed exactly and has to reach ``percent``.

An item of fewer than five words is one shingle of its own size, and so is each window
of as many words: they are alike if they are equal, and equal windows have equal
fingerprints, so these are looked up whole.

The benchmark is a stated set of queries: it is read in blocks of ``ITEM_BLOCK`` items,
and each block is one scan of all texts. Texts are not shuffled.

Defined cases: null or empty texts match nothing, and so do items without words; an
item of fewer than five words matches wherever these words stand in sequence; a text
shorter than an item of five words or more is one window; repeated rows and repeated items match alike; of equally
similar windows the first is reported; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm import arrays, frames

WIDTH = 5
PERCENT = 80
RADIUS = 19
BLOCK_RADIUS = RADIUS // 4
ITEM_BLOCK = 50_000
_FIELD_BITS = 24
#: All 16-bit numbers of at most BLOCK_RADIUS set bits.
_VARIANTS = np.array([sum(1 << i for i in bits) for size in range(BLOCK_RADIUS + 1)
                      for bits in combinations(range(16), size)], np.uint16)

SCHEMA = "doc_id long, content long, item_id long, similarity double, first_word long, n_words long"


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and the first word of each row."""
    hashes, begins, _ = arrays.words(data, bounds, arrays.NOT_ALNUM, arrays.FOLDED)
    return hashes, arrays.firsts(begins, bounds)


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """64 majority votes over the bits of the shingles; a tie is 0."""
    votes = np.unpackbits(shingles.view(np.uint8)).reshape(len(shingles), 64).sum(0)
    return np.packbits(2 * votes > len(shingles)).view(np.uint64)[0]


class Items:
    """The index of one block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        hashes, first = _words(*arrays.utf8(pa.array(texts, pa.string())))
        shingles, bounds = arrays.windows(hashes, first, WIDTH)
        n_words = np.diff(first)
        #: For each size below a shingle's the windows of such items in order, and their ids.
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in range(1, WIDTH):
            own, at = arrays.windows(hashes, first, size, short=False)
            asked: dict[int, set[int]] = defaultdict(set)
            for i in np.flatnonzero(n_words == size).tolist():
                asked[int(own[at[i]])].add(ids[i])
            if asked:
                self.short[size] = (np.array(sorted(asked), np.uint64), [sorted(asked[key]) for key in sorted(asked)])
        rows = [i for i in range(len(ids)) if n_words[i] >= WIDTH]
        self.ids = [ids[i] for i in rows]
        self.words = [int(n_words[i]) for i in rows]
        self.bags = [shingles[bounds[i] : bounds[i + 1]] for i in rows]
        self.prints = np.array([fingerprint(bag) for bag in self.bags], np.uint64)
        self.known = np.unique(np.concatenate(self.bags)) if rows else np.empty(0, np.uint64)
        self.field = np.zeros(1 << _FIELD_BITS, bool)
        self.field[(self.known >> np.uint64(64 - _FIELD_BITS)).astype(np.int64)] = True
        by_words: dict[int, list[int]] = defaultdict(list)
        for place, size in enumerate(self.words):
            by_words[size].append(place)
        pairs = sorted({(shingle, self.words[i]) for i, bag in enumerate(self.bags) for shingle in bag.tolist()})
        #: The item sizes that each known shingle occurs in, from ``at`` on.
        self.sizes = [size for _, size in pairs]
        self.at = np.searchsorted(np.array([shingle for shingle, _ in pairs], np.uint64), self.known).tolist() + [len(pairs)]
        #: For each item size the items and, for each block, its values in order.
        self.tables = {}
        for size, places in sorted(by_words.items()):
            parts = self.prints[places].view(np.uint16).reshape(-1, 4)
            order = [np.argsort(parts[:, block], kind="stable") for block in range(4)]
            self.tables[size] = (np.array(places), [(parts[order[b], b], order[b]) for b in range(4)])

    def has(self, shingles: np.ndarray) -> np.ndarray:
        found = self.field[(shingles >> np.uint64(64 - _FIELD_BITS)).astype(np.int64)]
        places = np.flatnonzero(found)
        found[places] = np.isin(shingles[places], self.known)
        return found

    def by_size(self, shingles: np.ndarray, places: np.ndarray) -> dict[int, list[int]]:
        """For each item size the places whose shingle is in an item of that size."""
        found: dict[int, list[int]] = defaultdict(list)
        for place, known in zip(places.tolist(), np.searchsorted(self.known, shingles[places]).tolist(), strict=True):
            for size in self.sizes[self.at[known] : self.at[known + 1]]:
                found[size].append(place)
        return found

    def within(self, size: int, code: np.uint64) -> list[int]:
        """Items of ``size`` words whose fingerprint is within the radius of ``code``."""
        places, blocks = self.tables[size]
        parts = np.array([code]).view(np.uint16)
        found: set[int] = set()
        for part, (values, order) in zip(parts, blocks, strict=True):
            wanted = part ^ _VARIANTS
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            for i in np.flatnonzero(high > low):
                found.update(order[low[i] : high[i]].tolist())
        return [int(places[i]) for i in sorted(found)
                if int(np.bitwise_count(self.prints[places[i]] ^ code)) <= RADIUS]


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    left, right = Counter(one.tolist()), Counter(two.tolist())
    shared = (left & right).total()
    return shared / (len(one) + len(two) - shared)


def _matches(items: Items, shingles: np.ndarray, held: np.ndarray, percent: int) -> dict[int, tuple[float, int, int]]:
    """By item the best similarity, the first word and the words of its window."""
    best: dict[int, tuple[float, int, int]] = {}
    for size, places in items.by_size(shingles, np.flatnonzero(held)).items():
        full = max(1, size - WIDTH + 1)
        width = min(full, len(shingles))
        need = -(-percent * full // 100)
        if len(places) < need:
            continue
        before = np.zeros(len(held) + 1, np.int64)
        before[np.array(places) + 1] = 1
        before = np.cumsum(before)
        for start in np.flatnonzero(before[width:] - before[:-width] >= need).tolist():
            window = shingles[start : start + width]
            for place in items.within(size, fingerprint(window)):
                alike = similarity(window, items.bags[place])
                if alike * 100 >= percent - 1e-9 and alike > best.get(place, (0.0,))[0]:
                    best[place] = (alike, start, width + min(WIDTH, size) - 1)
    return best


def _short_matches(items: Items, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, first word and words of the first window equal to each short item."""
    for size, (asked, ids) in items.short.items():
        windows, at = arrays.windows(hashes, first, size, short=False)
        places = np.flatnonzero(np.isin(windows, asked))
        rows = np.searchsorted(at, places, "right") - 1
        known = np.searchsorted(asked, windows[places])
        _, once = np.unique(np.stack([rows, known]), axis=1, return_index=True)
        for i in once.tolist():
            for item in ids[known[i]]:
                yield int(rows[i]), item, int(places[i] - at[rows[i]]), size


def _scan(docs: DataFrame, items: Items, percent: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            data, bounds = arrays.utf8(batch.column(2))
            for low, high in arrays.groups(bounds):
                hashes, first = _words(data, bounds[low : high + 1])
                rows += [(low + i, item, 1.0, start, size) for i, item, start, size in _short_matches(items, hashes, first)]
                shingles, at = arrays.windows(hashes, first, WIDTH)
                held = items.has(shingles)
                for i in np.flatnonzero(arrays.per_row(held, at)).tolist():
                    part = slice(at[i], at[i + 1])
                    found = _matches(items, shingles[part], held[part], percent)
                    rows += [(low + i, items.ids[place], *best) for place, best in found.items()]
            if rows:
                place, item, alike, first, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(place)) for c in (0, 1)), pa.array(item, pa.int64()),
                     pa.array(alike, pa.float64()), pa.array(first, pa.int64()), pa.array(size, pa.int64())],
                    names=["doc_id", "content", "item_id", "similarity", "first_word", "n_words"])

    return docs.mapInArrow(search, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT,
                 text: str = "text", id: str = "doc_id", block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each text and benchmark item that it holds: ``SCHEMA``.

    ``content`` is the digest of the text. ``benchmark`` has item_id and text.
    """
    rows = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"),
                        frames.content_key(F.col(f"`{text}`")).alias("content"),
                        F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = -(-asked.count() // block)
    # A little room, so that blocks by hash stay within the bound.
    parts = parts if parts <= 1 else 2 * parts
    found = None
    for part in range(max(1, parts)):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))) == part).orderBy("item_id", "text").collect()
        scanned = _scan(rows, Items([row["item_id"] for row in mine], [row["text"] for row in mine]), percent)
        found = scanned if found is None else found.union(scanned)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    gone = contaminated(docs, benchmark, percent).select(
        F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_key")).distinct()
    return frames.without(docs, frames.store(gone, "contaminated"))
