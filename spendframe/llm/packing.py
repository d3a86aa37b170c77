"""Token ids packed into rows of fixed length, best fit decreasing.

Texts become ids of a public byte-pair vocabulary, each ended by ``end_id``. Documents
longer than a row are split into full rows and a rest; no id is lost. Segments are put,
longest first, into the row whose free space fits best; a segment tree over free
space finds that row in log(length) steps. Each task packs what it reads, ``POOL`` ids
at a time, and carries its emptiest rows on, so no text is shuffled and memory is bounded.

A packed row has ``ids`` (little-endian uint16, padded with ``end_id``), ``cu_seqlens``
(where segments begin and the last one ends), ``resets`` (where position ids restart at 0),
and for each segment ``doc_ids``, ``origins`` (a number for each input row) and ``parts``
(the piece of it, from 0). ``row_id`` and ``origins`` are unique within one result.

Defined cases: a null or empty text is one segment of ``end_id`` alone; a null id stays
null; repeated rows are packed as often as they occur, under origins of their own;
strings that look like special tokens are ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm import frames

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts were cut into pieces; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
LENGTH = 2048
POOL = 4 << 20
CARRIED = 256
_FULL = 0.98

SCHEMA = ("row_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
          "doc_ids array<long>, origins array<long>, parts array<int>")


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = VOCABULARY) -> bytes:
    """The text's ids as little-endian uint16."""
    ids = array("H", _encoding(path).encode_ordinary(text or ""))
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class FreeSpace:
    """Rows by free space: a binary tree over 0..length that finds the tightest fit."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]
        self.filled = bytearray(2 * self.leaves)

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        node = self.leaves + space
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """Remove and return the least space of at least ``needed``, and a row that has it."""
        node = self.leaves + needed
        if not self.filled[node]:
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        space = node - self.leaves
        row = self.rows[space].pop()
        if not self.rows[space]:
            self.filled[node] = 0
            node >>= 1
            while node and not (self.filled[2 * node] or self.filled[2 * node + 1]):
                self.filled[node] = 0
                node >>= 1
        return space, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Places of ``sizes`` by row, so that each row holds at most ``length``."""
    rows: list[list[int]] = []
    free = FreeSpace(length)
    for place in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[place]
        found = free.take(size)
        if found is None:
            rows.append([])
            found = length, len(rows) - 1
        space, row = found
        rows[row].append(place)
        if space > size:
            free.add(space - size, row)
    return rows


def _packed(pool: list[tuple], length: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Rows of segments to write, and segments of the emptiest rows to go on with."""
    sizes = [len(segment[0]) >> 1 for segment in pool]
    rows = best_fit_decreasing(sizes, length)
    held: list[tuple] = []
    if not last:
        filled = sorted(range(len(rows)), key=lambda r: sum(sizes[i] for i in rows[r]))
        carried = {r for r in filled[:CARRIED] if sum(sizes[i] for i in rows[r]) < _FULL * length}
        held = [pool[i] for r in sorted(carried) for i in rows[r]]
        rows = [row for r, row in enumerate(rows) if r not in carried]
    return [[pool[i] for i in row] for row in rows], held


def _batch(rows: list[list[tuple]], first: int, length: int, end_id: int) -> pa.RecordBatch:
    bounds = [np.concatenate([[0], np.cumsum([len(s[0]) >> 1 for s in row])]).astype(np.int32) for row in rows]
    fill = np.array([end_id], "<u2").tobytes()
    ids = [b"".join(s[0] for s in row) for row in rows]
    return pa.RecordBatch.from_arrays([
        pa.array(range(first, first + len(rows)), pa.int64()),
        pa.array([len(x) >> 1 for x in ids], pa.int32()),
        pa.array([x + fill * (length - (len(x) >> 1)) for x in ids], pa.binary()),
        pa.array(bounds, pa.list_(pa.int32())),
        pa.array([b[:-1] for b in bounds], pa.list_(pa.int32())),
        pa.array([[s[1] for s in row] for row in rows], pa.list_(pa.int64())),
        pa.array([[s[2] for s in row] for row in rows], pa.list_(pa.int64())),
        pa.array([[s[3] for s in row] for row in rows], pa.list_(pa.int32())),
    ], names=["row_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "origins", "parts"])


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID,
         text: str = "text", id: str = "doc_id") -> DataFrame:
    """Packed rows of ``length`` ids: ``SCHEMA``. ``vocabulary`` is a path all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u2").tobytes()
        pool: list[tuple] = []
        pooled, written, origin = 0, base, base

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pool, pooled, written
            rows, pool = _packed(pool, length, last)
            pooled = sum(len(segment[0]) for segment in pool)
            for at in range(0, len(rows), 256):
                yield _batch(rows[at : at + 256], written, length, end_id)
                written += len(rows[at : at + 256])

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(value.as_py(), vocabulary) + end
                for part, at in enumerate(range(0, len(ids), 2 * length)):
                    pool.append((ids[at : at + 2 * length], name.as_py(), origin, part))
                origin += 1
                pooled += len(ids)
                if pooled >= 2 * POOL:
                    yield from flush(False)
        if pool:
            yield from flush(True)

    rows = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def matrix(ids: list[bytes], length: int = LENGTH) -> np.ndarray:
    """The id matrix of collected rows."""
    return np.frombuffer(b"".join(ids), "<u2").reshape(-1, length)


def position_ids(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """Position ids of a row: they count from 0 in each segment, and in the padding."""
    starts = np.zeros(length, np.int64)
    starts[[at for at in cu_seqlens if at < length]] = [at for at in cu_seqlens if at < length]
    return np.arange(length) - np.maximum.accumulate(starts)


def write_packed(packed: DataFrame, path: str, length: int = LENGTH, vocabulary: str = VOCABULARY,
                 end_id: int = END_ID) -> None:
    """Write the rows as Parquet under ``path``/rows and what describes them as JSON."""
    packed.write.mode("overwrite").parquet(f"{path}/rows")
    facts = [(vocabulary.rsplit("/", 1)[-1], length, "uint16", end_id)]
    spark = packed.sparkSession
    spark.createDataFrame(facts, "vocabulary string, length int, dtype string, end_id int").coalesce(1).write.mode(
        "overwrite").json(f"{path}/about")


def unpack(packed: DataFrame) -> DataFrame:
    """Columns doc_id, origin and ids (without the end) of every input row."""
    cut = F.explode(F.transform("origins", lambda origin, i: F.struct(
        origin.alias("origin"), F.get("doc_ids", i).alias("doc_id"), F.get("parts", i).alias("part"),
        F.substring("ids", 2 * F.get("cu_seqlens", i) + 1,
                    2 * (F.get("cu_seqlens", i + 1) - F.get("cu_seqlens", i))).alias("ids"))))
    pieces = packed.select(cut.alias("piece")).select("piece.*")
    joined = pieces.groupBy("origin").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("part", F.hex("ids").alias("ids")))).alias("pieces"))
    whole = F.unhex(F.array_join(F.transform("pieces", lambda piece: piece["ids"]), ""))
    return joined.select("doc_id", "origin", F.substring(whole, F.lit(1), F.length(whole) - 2).alias("ids"))
