"""Periodic runs of words, found by block convolution.

A run is a longest stretch of consecutive words with smallest period q (words q
apart are identical) and at least ``max(6, 4 * q)`` words. The search works on
word numbers of a whole block of texts; a number of its own after each text
keeps runs within texts.

At scale B = 1, 2, 4, ... it looks for periods from B to 2B - 1. Every aligned
piece of B words is a pattern p, the 2B words after it a window t. The sum of
(p - t)^2 at every shift is sum p^2 + sum t^2 - 2 sum p t, whose last term comes
from a number-theoretic transform over the integers modulo 3 * 2^30 + 1, which
has roots for every length a text can have. Where the sum is zero the piece
occurs again, and shift + B is a distance that may be a period. A run with
period q leaves at least 3q words that equal the word q later, so at least two
neighbouring pieces tell the same distance: chains of such pieces are extended
word by word to both sides (by binary search over prefix hashes) and the
stretch is compared word by word. A stretch inside a run of smaller period has
that period too and is none of its own.

Work is n log^2 n for n words whatever repeats: a scale has at most one distance
for each word. Transforms are cut into slices, so memory follows the block of
texts, or the longest text if that is longer.

A null text has no words, a null id counts as empty text where ids are hashed.
Every row is judged by itself, so repeated rows give repeated results, and an
empty table gives an empty one. Only ``doc_id`` and ``text`` are read, whatever
other columns are named.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.spread import plain
from codelake.llm.text import TOKEN_BYTES, Block, Prefix, blocks

LEAST, FOLD = 6, 4
#: Numbers in one slice of transforms.
SLICE = 1 << 17

_PRIME = 3 * 2**30 + 1
_P = np.uint64(_PRIME)
_ROOT = 5
_BASES = (1_234_567_891, 2_718_281_829)
_roots: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo the prime, for i below n."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, _PRIME))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step % _P
        have += more
    return out


def _root_powers(n: int) -> np.ndarray:
    found = _roots.get(n)
    if found is None:
        found = powers(pow(_ROOT, (_PRIME - 1) // n, _PRIME), n // 2)
        if n <= 1 << 20:
            _roots[n] = found
    return found


def transform(x: np.ndarray) -> np.ndarray:
    """The transform of every column of ``x``, in natural order; rows are a power of two."""
    n, columns = x.shape
    x = np.ascontiguousarray(x)
    half, width = n // 2, columns
    while half:
        pair = x.reshape(2, half, width)
        a, b = pair[0], pair[1]
        y = np.empty((half, 2, width), np.uint64)
        total = a + b
        np.minimum(total, total - _P, out=y[:, 0])
        apart = np.subtract(a, b, out=total)
        apart = np.minimum(apart, apart + _P, out=apart)
        apart *= _root_powers(2 * half)[:, None]
        np.remainder(apart, _P, out=y[:, 1])
        x, half, width = y, half // 2, width * 2
    return x.reshape(n, columns)


class Sequence:
    """Numbers with prefix hashes, to compare stretches in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.n = len(values)
        self.weights = [powers(base, self.n + 1) for base in _BASES]
        self.sums = []
        for weight in self.weights:
            terms = values.astype(np.uint64) % _P * weight[: self.n] % _P
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))

    def equal(self, at: np.ndarray, length: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Which stretches equal the stretch ``distance`` later (both lie inside)."""
        same = np.ones(len(at), bool)
        for weight, sums in zip(self.weights, self.sums, strict=True):
            here = (sums[at + length] - sums[at]) % _P
            there = (sums[at + distance + length] - sums[at + distance]) % _P
            same &= here * weight[distance] % _P == there
        return same

    def reach(self, at: np.ndarray, distance: np.ndarray, most: int, step: int) -> np.ndarray:
        """How many words in a row, after ``at`` or before it, equal the word ``distance`` later; ``most`` at most."""
        low = np.zeros(len(at), np.int64)
        room = self.n - distance - at if step > 0 else at
        high = np.clip(room, 0, most)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            start = at if step > 0 else at - middle
            same = self.equal(start, middle, distance)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low


class Covered:
    """Stretches that are known to be runs, asked which others lie inside one of them."""

    def __init__(self) -> None:
        self.runs = np.zeros((0, 3), np.int64)
        self.start, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, runs: np.ndarray) -> None:
        self.runs = np.concatenate([self.runs, runs])
        order = np.argsort(self.runs[:, 0], kind="stable")
        self.start = self.runs[order, 0]
        self.end = np.maximum.accumulate(self.runs[order, 0] + self.runs[order, 1])

    def inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, "right") - 1
        return (at >= 0) & (self.end[np.maximum(at, 0)] >= end)


def _occurrences(pieces: np.ndarray, squares: np.ndarray, asked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces among ``asked`` and the distances, from ``size`` to twice that, at which they occur again."""
    n = 2 * size
    # Each asked piece is followed by the two pieces of its window.
    near = np.zeros(int(asked[-1] - asked[0]) + 3, bool)
    for i in range(3):
        near[asked - asked[0] + i] = True
    needed = np.flatnonzero(near) + asked[0]
    first = (np.cumsum(near) - 1)[asked - asked[0]]
    padded = np.zeros((n, len(needed)), np.uint64)
    padded[:size] = pieces[needed].T
    spectrum = transform(padded)
    # Moving a piece by half the length changes the sign of its odd frequencies.
    window = spectrum[:, first + 1]
    later = spectrum[:, first + 2]
    window[0::2] += later[0::2]
    window[1::2] += _P - later[1::2]
    window %= _P
    mirror = (n - np.arange(n)) % n
    window *= spectrum[:, first][mirror]
    window %= _P
    product = transform(window)[mirror[:size]]
    start = asked * size
    own = squares[start + size] - squares[start]
    places = start[None, :] + size + np.arange(size)[:, None]
    total = squares[places + size]
    total -= squares[places]
    total += own[None, :]
    total %= _P
    total *= np.uint64(n // 2)
    total %= _P
    shift, column = np.nonzero(total == product)
    return asked[column], shift + size


def _chains(piece: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last piece, and distance, of neighbouring pieces with one distance; two at least."""
    order = np.lexsort((piece, distance))
    piece, distance = piece[order], distance[order]
    head = np.ones(len(piece), bool)
    head[1:] = (piece[1:] != piece[:-1] + 1) | (distance[1:] != distance[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(piece)) - 1
    keep = last > at
    return piece[at[keep]], piece[last[keep]], distance[at[keep]]


def runs(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of a block of texts as rows (start, length, period).

    ``values`` are positive word numbers, text after text; text i has those from
    ``bounds[i]`` to ``bounds[i + 1]``, the last of which is a number that occurs
    nowhere else.
    """
    lengths = np.diff(bounds) - 1
    known = Covered()
    longest = int(lengths.max(initial=0))
    if longest < LEAST:
        return known.runs
    sequence = Sequence(values)
    squares = values.astype(np.uint64) % _P
    squares = squares * squares % _P
    size = 1
    while FOLD * size <= longest:
        padding = np.zeros((len(values) // size + 4) * size - len(values), np.int64)
        pieces = np.concatenate([values, padding]).reshape(-1, size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.concatenate([squares, padding.astype(np.uint64)]), dtype=np.uint64)])
        long = lengths >= max(LEAST, FOLD * size)
        low = -(-bounds[:-1][long] // size)
        count = np.maximum((bounds[:-1][long] + lengths[long]) // size - low, 0)
        asked = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        found = []
        width = max(1, SLICE // (2 * size))
        for i in range(0, len(asked), width):
            piece, distance = _occurrences(pieces, sums, asked[i : i + width], size)
            keep = ~known.inside(piece * size, piece * size + size + distance)
            found.append((piece[keep], distance[keep]))
        piece, distance = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        # The sum is exact modulo the prime; what is zero only there is no occurrence.
        true = sequence.equal(piece * size, np.full(len(piece), size), distance)
        first, last, distance = _chains(piece[true], distance[true])
        start = first * size - sequence.reach(first * size, distance, size, -1)
        end = (last + 1) * size
        end = end + sequence.reach(end, distance, size, 1) + distance
        keep = (end - start >= np.maximum(LEAST, FOLD * distance)) & ~known.inside(start, end)
        fresh = [
            (s, e - s, q)
            for s, e, q in zip(start[keep].tolist(), end[keep].tolist(), distance[keep].tolist(), strict=True)
            if np.array_equal(values[s : e - q], values[s + q : e])
        ]
        if fresh:
            known.add(np.array(fresh, np.int64))
        size *= 2
    return known.runs


def repeat_from(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """Start and period that a tenth of the documents, by the hash of their id, repeat their words with."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class Texts:
    """The words of a block of texts as numbers, and the runs among them."""

    def __init__(self, block: Block, repeats: list[tuple[int, int] | None] | None = None) -> None:
        words = block.words(TOKEN_BYTES)
        number = np.unique(Prefix(block.data, lower=False).of(words.start, words.end), return_inverse=True)[1]
        self.counts = words.counts
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(words.counts + 1)])
        self.repeats = repeats if repeats is not None else [None] * len(block)
        # Every text ends in a number of its own.
        values = np.empty(self.bounds[-1], np.int64)
        values[self.bounds[1:] - 1] = len(number) + 1 + np.arange(len(block))
        values[np.arange(len(number)) + words.row] = number.reshape(-1) + 1
        for i, repeat in enumerate(self.repeats):
            if repeat:
                a, p = repeat
                own = values[self.bounds[i] : self.bounds[i] + self.counts[i]]
                own[a:] = own[a + np.arange(len(own) - a) % p]
        found = runs(values, self.bounds)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        text = np.searchsorted(self.bounds, found[:, 0], "right") - 1
        found[:, 0] -= self.bounds[text]
        edges = np.searchsorted(text, np.arange(len(block) + 1))
        self.runs = [found[edges[i] : edges[i + 1]].tolist() for i in range(len(block))]


def collapsed(words: list[bytes], found: list[list[int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def strongest(found: list[list[int]]) -> list[int] | None:
    """The run with greatest length by period; of equal ones that of least start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_REPORT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def _run_rows(repeated: bool, digests: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                ids = block.rows.column("doc_id").to_pylist()
                raw = [block.data[a:b].tobytes().split() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
                repeats = [repeat_from(len(w), i) if repeated else None for w, i in zip(raw, ids, strict=True)]
                texts = Texts(block, repeats)
                out: dict[str, list] = {name: [] for name in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "kept")}
                for i, words, repeat, found in zip(ids, raw, repeats, texts.runs, strict=True):
                    if repeat:
                        a, p = repeat
                        words = words[:a] + [words[a + k % p] for k in range(len(words) - a)]
                    best = strongest(found)
                    out["doc_id"].append(i)
                    out["n_words"].append(len(words))
                    out["n_runs"].append(len(found))
                    for name, value in zip(("start", "length", "period"), best or (None,) * 3, strict=True):
                        out[name].append(value)
                    out["exponent_milli"].append(best and 1000 * best[1] // best[2])
                    kept = b" ".join(collapsed(words, found))
                    if digests:
                        told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                        out["runs"].append(hashlib.sha256(told.encode()).hexdigest())
                        out["kept"].append(hashlib.sha256(kept).hexdigest())
                    else:
                        out["runs"].append([dict(zip(("start", "length", "period"), run, strict=True)) for run in found])
                        out["kept"].append(kept.decode("utf-8", "replace"))
                run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                types = [pa.int64()] * 7 + ([pa.string(), pa.string()] if digests else [pa.list_(run), pa.string()])
                names = list(out)[:7] + (["runs_sha256", "collapsed_sha256"] if digests else ["runs", "collapsed"])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)

    return rows


def _read(docs: DataFrame) -> DataFrame:
    return plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document row: its runs, the strongest one, and the text without their repetitions.

    ``runs`` is ordered by start, then period; ``start`` to ``exponent_milli`` are
    null where there is none. ``collapsed`` joins the kept words by one space.
    """
    return _read(docs).mapInArrow(_run_rows(repeated=False, digests=False), _REPORT)


def run_digests(docs: DataFrame) -> DataFrame:
    """As ``periodic_runs``, but a tenth of the documents repeat their words first, and runs and kept words are hashed."""
    schema = _REPORT[: _REPORT.index("runs array")] + "runs_sha256 string, collapsed_sha256 string"
    return _read(docs).mapInArrow(_run_rows(repeated=True, digests=True), schema).drop("n_words")
