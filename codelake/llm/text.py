"""Words, hashes and columns of whole Arrow batches, in numpy.

Texts stay UTF-8 bytes. A batch is cut into blocks of consecutive rows of about
``BLOCK`` bytes, so memory follows the block, or the longest single text if that
is longer. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Letters, digits and all of non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
WORD_BYTES = (
    ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | ((_byte >= 65) & (_byte <= 90))
    | (_byte >= 128)
)
#: Everything but space and U+0009 to U+000D.
TOKEN_BYTES = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER_VALUE = _VALUE[LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 2**64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(salt)) | np.uint64(1)


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * BLOCK:
            _tables[name] = have
    return have


class Prefix:
    """Prefix sums that give the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray, lower: bool) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            values = (_LOWER_VALUE if lower else _VALUE)[data]
            values *= _powers("p", _P, n)[:n]
            np.cumsum(values, out=self.sums[1:])
        self.inverse = _powers("inverse", _INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64))


class Block:
    """Consecutive rows of a batch: bytes, row offsets and the batch rows themselves."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, table: np.ndarray = WORD_BYTES) -> Words:
        return Words(self, table)

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK) -> Iterator[Block]:
    data, offsets = string_bytes(batch.column(column))
    low, n = 0, batch.num_rows
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        high = min(high, n)
        own = offsets[low : high + 1]
        yield Block(batch.slice(low, high - low), data[own[0] : own[-1]], own - own[0])
        low = high


class Words:
    """Word positions of a block: start and end byte, row, and words per row."""

    def __init__(self, block: Block, table: np.ndarray) -> None:
        self.block = block
        data, offsets = block.data, block.offsets
        n = len(data)
        inside = table[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:][np.diff(offsets) > 0] - 1
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets) if n else np.zeros(len(offsets), np.int64)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(block)), self.counts)
        self.position = np.arange(len(self.start)) - np.repeat(self.bounds[:-1], self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Prefix(self.block.data, lower=True).of(self.start, self.end)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every run of ``k`` words within one row."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 : k - 1 + n])
        total = np.zeros(n, np.uint64)
        for j, m in enumerate(seeds(k, 77)):
            total += hashes[j : j + n] * m
        return at, mix(total[at] + np.uint64(k))

    def text(self, i: int) -> str:
        b = self.block
        return LOWER[b.data[self.start[i] : self.end[i]]].tobytes().decode("utf-8", "replace")

    def texts(self, low: int, high: int) -> list[str]:
        return [self.text(i) for i in range(low, high)]


def word_list(text: str | None) -> list[str]:
    """The words of one text, by the same rule."""
    data = (text or "").encode("utf-8", "surrogatepass")
    block = Block(None, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    found = block.words()
    return found.texts(0, len(found))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def byte_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column from flat fixed-width values and the number of values of each row."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts) * width, out=offsets[1:])
    whole = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]
    ).cast(pa.binary())


def bitmap_test(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in a bitmap made by ``spread.bitmap``."""
    slot = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
