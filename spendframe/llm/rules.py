"""Counts that quality rules are built on, for each whole text.

Words are runs without white space, lines are what newlines separate. A null or
empty text counts zero everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from spendframe.llm import arrays

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_marks", "n_digits")

_SYMBOLS = arrays.byte_set(*b"#*$%&|<>")
_UPPER = arrays.byte_set(*range(0x41, 0x5B))
_MARKS = arrays.byte_set(*b"!?.,;:")
_DIGITS = arrays.byte_set(*range(0x30, 0x3A))
_FOLLOWING = arrays.byte_set(*range(0x80, 0xC0))


def rule_counts(column: pa.Array) -> dict[str, np.ndarray]:
    data, bounds = arrays.utf8(column)
    parts: list[list[np.ndarray]] = []
    for low, high in arrays.groups(bounds):
        parts.append(_counts(data, bounds[low : high + 1]))
    joined = [np.concatenate(values) for values in zip(*parts, strict=True)] if parts else [
        np.empty(0, np.int64) for _ in COUNTS]
    return dict(zip(COUNTS, joined, strict=True))


def _counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    part, inner = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    hashes, begins, _ = arrays.words(data, bounds, arrays.WHITE)
    first = arrays.firsts(begins, bounds)
    n_words = np.diff(first)

    def bytes_in(members: np.ndarray) -> np.ndarray:
        return arrays.per_row(members[part], inner)

    triples, at = arrays.windows(hashes, first, 3, short=False)
    often, _ = arrays.repeats(arrays.by_row(triples, np.diff(at)))
    covered = np.zeros(len(hashes), bool)
    starts = np.flatnonzero(often)
    rows = np.searchsorted(at, starts, "right") - 1
    places = first[rows] + starts - at[rows]
    for i in range(3):
        covered[places + i] = True

    lines, line_begins, line_ends = arrays.words(data, bounds, arrays.NEWLINE)
    filled = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
    line_at = arrays.firsts(line_begins[filled], bounds)
    _, again = arrays.repeats(arrays.by_row(lines[filled], np.diff(line_at)))
    return [
        n_words,
        np.diff(inner) - bytes_in(arrays.WHITE) - bytes_in(_FOLLOWING),
        bytes_in(_SYMBOLS),
        arrays.per_row(again, line_at),
        arrays.per_row(covered, first),
        np.diff(line_at),
        bytes_in(_UPPER),
        bytes_in(_MARKS),
        bytes_in(_DIGITS),
    ]
