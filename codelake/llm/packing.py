"""Packing of token ids into fixed rows, best fit decreasing.

Each task encodes its texts and buffers about ``buffer`` tokens, then packs
them: texts longer than a row are split into full rows and a rest, pieces are
placed longest first into the row whose free space fits them best, found by a
segment tree over free capacities, and rows are written. Memory is bounded by
the buffer and the longest text; nothing is shuffled. Which texts share a row
follows from how Spark cuts the input.

A row has ``ids`` (little-endian unsigned 16 or 32 bit, ``length`` of them, padded
with ``pad``), ``positions`` (the same, counted from 0 in each piece), ``ends``
(cumulative piece lengths, from 0), and per piece its ``doc_ids``, the place of
its first token in the text (``starts``) and its number of tokens. Every text
ends with ``end``; concatenating the pieces of a text by ``starts`` gives its
ids again. A null or empty text is one ``end`` token. Repeated rows are packed
as often. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm import pieces
from codelake.llm.spread import plain
from codelake.llm.text import byte_lists

LENGTH = 2048
BUFFER = 1 << 20


class Capacities:
    """A segment tree over capacities 1 to ``most``: finds the least one in use that is enough."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, capacity: int) -> None:
        if capacity:
            self.rows[capacity].append(row)
            self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least capacity of at least ``need``, and that capacity; it is taken out."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Row of each piece, and the number of rows. Pieces of equal size go in their order."""
    free = Capacities(length)
    placed = np.zeros(len(sizes), np.int64)
    rows = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = free.take(size)
        if found is None:
            found, rows = (rows, length), rows + 1
        placed[i] = found[0]
        free.add(found[0], found[1] - size)
    return placed, rows


def split(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first token within the text, and size of every piece."""
    parts = -(-counts // length)
    text = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = number * length
    return text, start, np.minimum(length, counts[text] - start)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)


def pack(ids: np.ndarray, counts: np.ndarray, doc_ids: pa.Array, length: int, pad: int, first_row: int) -> pa.RecordBatch:
    text, start, size = split(counts, length)
    row, n = best_fit(size, length)
    order = np.argsort(row, kind="stable")  # pieces of a row stay longest first or in text order
    text, start, size, row = text[order], start[order], size[order], row[order]
    begin = (np.cumsum(counts) - counts)[text] + start  # in ids
    per_row = np.bincount(row, minlength=n)
    ends = np.cumsum(size)
    used = np.bincount(row, size, n).astype(np.int64)
    offset = ends - size - np.repeat(np.cumsum(used) - used, per_row)  # within the row
    inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
    target = np.repeat(row * length + offset, size) + inner
    matrix = np.full(n * length, pad, ids.dtype)
    matrix[target] = ids[np.repeat(begin, size) + inner]
    positions = np.zeros(n * length, ids.dtype)
    positions[target] = inner
    cumulative = np.insert(offset + size, np.cumsum(per_row) - per_row, 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first_row + np.arange(n), pa.int64()), byte_lists(matrix, np.full(n, length)), byte_lists(positions, np.full(n, length)),
            _lists(pa.array(cumulative, pa.int32()), per_row + 1), _lists(doc_ids.take(pa.array(text)), per_row),
            _lists(pa.array(start, pa.int64()), per_row), _lists(pa.array(size, pa.int32()), per_row), pa.array(used, pa.int64()),
        ],
        names=["row_id", "ids", "positions", "ends", "doc_ids", "starts", "sizes", "n_tokens"],
    )


_PACKED = (
    "row_id long, ids binary, positions binary, ends array<int>, doc_ids array<long>, starts array<long>, sizes array<int>, n_tokens long"
)


def _pack_rows(shared, length: int, buffer: int, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces.Codec(shared.value, threads, verify=False)
        kinds = {p: i for i, (p, _, _) in enumerate(codec.model.pieces)}
        end = kinds.get("</s>", len(codec.model.pieces))
        dtype = np.uint16 if max(end, len(codec.model.pieces), length) < 1 << 16 else np.uint32
        row = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            return pack(ids, counts, pa.concat_arrays([h[2] for h in held]), length, end, row)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in pieces.runs(texts):
                ids, counts, _ = codec.encode(texts[low:high])
                ids = np.insert(ids.astype(dtype), np.cumsum(counts), dtype(end))
                held.append((ids, counts + 1, batch.column("doc_id").slice(low, high - low)))
                tokens += len(ids)
                if tokens >= buffer:
                    out = flush()
                    yield out
                    row += out.num_rows
                    held, tokens = [], 0
        if held:
            yield flush()

    return run


def packed(docs: DataFrame, path: str = pieces.MODEL, length: int = LENGTH, buffer: int = BUFFER, threads: int = 2) -> DataFrame:
    """Rows of ``length`` token ids, ready to be written; ``matrix`` reads them back."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces.model_bytes(docs.sparkSession, path))
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack_rows(shared, length, buffer, threads), _PACKED)


def matrix(rows: list[bytes], length: int, width: int = 2) -> np.ndarray:
    """The id (or position) matrix of binary rows."""
    return np.frombuffer(b"".join(rows), f"<u{width}").reshape(-1, length)
