"""Hashes of words, lines and shingles, computed over whole Arrow batches.

Text stays in Arrow's UTF-8 buffer. Each byte is mapped to a 64-bit number, a
running sum of these times powers of an odd base is formed (modulo 2**64), and
a word's hash is the difference of the sum at its ends times the inverse power at
its start. No Python object is made per word. Buffers are handled in chunks that
end at a separator, so memory is bounded by the chunk and one document's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
GROUP_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LIMBS = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_set(*members: int) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


#: Space and the ASCII controls from tab to carriage return.
WHITE = byte_set(0x20, *range(0x09, 0x0E))
NEWLINE = byte_set(0x0A)
#: Everything in ASCII that is neither a digit nor a letter.
NOT_ALNUM = byte_set(*(b for b in range(128) if not chr(b).isalnum()))

EXACT = _BYTE_VALUES.copy()
#: A-Z count as a-z.
FOLDED = _BYTE_VALUES.copy()
FOLDED[0x41:0x5B] = _BYTE_VALUES[0x61:0x7B]

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(size: int) -> None:
    global _powers, _inverses
    if len(_powers) < size:
        def run(base: int) -> np.ndarray:
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        _powers, _inverses = run(_BASE), run(_INVERSE)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each value's bounds in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), bounds.astype(np.int64)


def groups(bounds: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one longer row."""
    at, rows = 0, len(bounds) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(end, rows)
        at = end


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray,
          values: np.ndarray = EXACT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte range of each maximal run without separators, row by row.

    Rows lie side by side; a run never crosses from one row into the next.
    """
    at, stop = int(bounds[0]), int(bounds[-1])
    found: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    while at < stop:
        end, size = stop, CHUNK
        while at + size < stop:
            last = np.flatnonzero(separator[data[at : at + size]])
            row = int(bounds[np.searchsorted(bounds, at + size, "right") - 1])
            end = max(at + int(last[-1]) + 1 if len(last) else at, row)
            if end > at:
                break
            end, size = stop, size * 2
        part = data[at:end]
        inside = ~separator[part]
        rows = bounds[(bounds > at) & (bounds < end)] - at
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[rows] = inside[rows]
        final = inside.copy()
        final[:-1] &= ~inside[1:]
        final[rows - 1] = inside[rows - 1]
        first, final = np.flatnonzero(first), np.flatnonzero(final) + 1
        _grow(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[part] * _powers[: len(part)], out=sums[1:])
        hashes = (sums[final] - sums[first]) * _inverses[first]
        found.append(mix(hashes + (final - first).astype(np.uint64)))
        begins.append(first + at)
        ends.append(final + at)
        at = end
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(begins), np.concatenate(ends)


def firsts(begins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the number of its first run, with the number of runs at the end."""
    return np.searchsorted(begins, bounds, "left").astype(np.int64)


def windows(hashes: np.ndarray, first: np.ndarray, width: int,
            short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every ``width`` runs in sequence, and each row's first such window.

    With ``short`` a row with fewer runs, but any, has one window of all of them.
    """
    counts = np.diff(first)
    made = np.maximum(counts - width + 1, 0)
    if short:
        made[(counts > 0) & (counts < width)] = 1
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(made, out=bounds[1:])
    out = np.empty(int(bounds[-1]), np.uint64)
    if len(hashes) >= width:
        sums = hashes[: len(hashes) - width + 1] * _LIMBS[0]
        for i in range(1, width):
            sums += hashes[i : len(hashes) - width + 1 + i] * _LIMBS[i]
        place = np.arange(len(sums), dtype=np.int64)
        long = counts >= width
        row = np.repeat(np.arange(len(counts)), counts)[: len(sums)]
        fits = long[row] & (place + width <= first[1:][row])
        place, row = place[fits], row[fits]
        out[bounds[:-1][row] + place - first[:-1][row]] = mix(sums[fits])
    if short:
        for size in range(1, width):
            rows = np.flatnonzero(counts == size)
            if len(rows):
                sums = np.full(len(rows), size, np.uint64)
                for i in range(size):
                    sums += hashes[first[rows] + i] * _LIMBS[i]
                out[bounds[rows]] = mix(sums + np.uint64(1))
    return out, bounds


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of set flags in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def by_row(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows even where the content is the same."""
    rows = np.arange(1, len(counts) + 1, dtype=np.uint64) * np.uint64(_BASE)
    return mix(hashes ^ np.repeat(rows, counts))


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the hash occurs more than once; it occurred at a smaller place."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    later = np.zeros(len(hashes), bool)
    later[order[1:]] = same
    often = later.copy()
    often[order[:-1]] |= same
    return often, later


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's different hashes in ascending order."""
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        row = np.sort(hashes[low:high])
        if len(row) > 1:
            fresh = np.empty(len(row), bool)
            fresh[0] = True
            np.not_equal(row[1:], row[:-1], out=fresh[1:])
            row = row[fresh]
        yield row
