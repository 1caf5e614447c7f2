"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk where its low ``k`` bits are zero.
The fingerprint is ``k:a:b``: ``k`` is the least, from zero on, that gives at most
63 chunk ends; ``a`` has one character per chunk and ``b`` the same for ``k + 1``.
Two fingerprints are compared where their block sizes agree or are next to each
other: signatures with no common run of seven characters are unlike, others are
as alike as their edit distance by insertions and deletions says. The run is a
third of the shorter signature where that is less than seven, but two at least
where it has two. The first seven bytes are one chunk at least, so of texts under
12 bytes that differ in a third, most are unlike.

Null counts as empty; the fingerprint of the empty text is ``0::``. Equal texts
have equal fingerprints and likeness 1. Repeated rows are treated each on its
own; rows with equal ids are in the order of their texts' hashes, null ids last.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.storage import Stored
from codelake.llm.spread import plain
from codelake.llm.text import BLOCK, Prefix

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
RUN = 7
LONGEST = 63
LEAST_BITS = 0

_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of UTF-8 texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    prefix = Prefix(data, lower=False)
    n = len(data)
    zeros = np.zeros(n, np.uint64)  # the lowest set bit of the rolling hash
    if n >= WINDOW:
        rolled = prefix.of(np.arange(n - WINDOW + 1), np.arange(WINDOW, n + 1))
        zeros[WINDOW - 1 :] = rolled & (~rolled + np.uint64(1))
    out = []
    for text, end in zip(texts, ends.tolist(), strict=True):
        begin = end - len(text)
        low = begin + WINDOW - 1  # a window lies within its text
        spots = low + np.flatnonzero(zeros[low:end] >= 1 << LEAST_BITS)
        size = zeros[spots]
        k = LEAST_BITS
        while np.count_nonzero(size >= 1 << k) > LONGEST:
            k += 1
        both = []
        for bits in (k, k + 1):
            cut = spots[size >= 1 << bits] + 1
            bounds = np.r_[begin, cut] if len(cut) else np.array([begin])
            bounds = np.r_[bounds, end] if bounds[-1] < end else bounds
            chunk = prefix.of(bounds[:-1], bounds[1:])
            both.append(_LETTERS[(chunk >> np.uint64(58)).astype(np.int64)].tobytes().decode())
        out.append(f"{k}:{both[0]}:{both[1]}")
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    run = min(RUN, max(min(2, short), short // 3))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """How alike two fingerprints are, 0 to 1."""
    if x == y:
        return 1.0
    k, a, b = x.split(":")
    m, c, d = y.split(":")
    if k == m:
        return max(_alike(a, c), _alike(b, d))
    if int(k) == int(m) + 1:
        return _alike(a, d)
    if int(m) == int(k) + 1:
        return _alike(b, c)
    return 0.0


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)
_NAMES = [f.split(" ")[0] for f in _RESULT.replace(", ", ",").split(",")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _results(rows: list[tuple[int | None, str]], following: list[str]) -> list[pa.Array]:
    """Result columns of rows whose next texts are given."""
    new = [edited(text, after).encode("utf-8", "surrogatepass") for (_, text), after in zip(rows, following, strict=True)]
    own = [text.encode("utf-8", "surrogatepass") for _, text in rows]
    after = [t.encode("utf-8", "surrogatepass") for t in following]
    # In a run of rows, the text after a row is the next row's own text.
    chained = all(a == b for a, b in zip(after[:-1], own[1:], strict=True))
    marks = fingerprints(own + new + (after[-1:] if chained else after))
    n = len(rows)
    first, second = marks[:n], marks[n : 2 * n]
    third = [*first[1:], marks[-1]] if chained else marks[2 * n :]
    columns = [
        [i for i, _ in rows], [len(t) for _, t in rows], [hashlib.sha256(b).hexdigest() for b in new], first, second,
        [likeness(a, b) for a, b in zip(first, second, strict=True)], [likeness(a, b) for a, b in zip(first, third, strict=True)],
    ]
    return [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition: results where the next text is here; the first and last text besides."""
    part = TaskContext.get().partitionId()
    waiting: list[tuple[int | None, str]] = []
    size, begun = 0, False

    def made(columns: list[pa.Array], kind: str, texts: list[str | None]) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([part] * n, pa.int32()), pa.array([kind] * n), pa.array(texts, pa.string())],
            names=[*_NAMES, "part", "kind", "body"],
        )

    def edge(row: tuple[int | None, str], kind: str) -> pa.RecordBatch:
        columns = [pa.array([row[0]], pa.int64()), *[pa.nulls(1, k) for k in _KINDS[1:]]]
        return made(columns, kind, [row[1]])

    for batch in batches:
        for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not begun:
                begun = True
                yield edge(row, "first")
            waiting.append(row)
            size += len(row[1])
            if size >= BLOCK // 2 and len(waiting) > 1:
                yield made(_results(waiting[:-1], [t for _, t in waiting[1:]]), "whole", [None] * (len(waiting) - 1))
                waiting, size = waiting[-1:], len(waiting[-1][1])
    if len(waiting) > 1:
        yield made(_results(waiting[:-1], [t for _, t in waiting[1:]]), "whole", [None] * (len(waiting) - 1))
    if waiting:
        yield edge(waiting[-1], "last")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays(_results(rows, batch.column("following").to_pylist()), names=_NAMES)


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to one another and to the next text.

    Texts are in descending order of ``doc_id``; after the last comes the first.
    The table is range-partitioned once; the one pair per partition whose texts
    lie in two partitions is compared from a small stored table.
    """
    store = Stored(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    walked = store.table(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk, f"{_RESULT}, part int, kind string, body string"),
        "fingerprints",
    )
    parts = sorted(r["part"] for r in walked.select("part").distinct().collect())  # as many as partitions
    steps = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following_part int")
    first = walked.where("kind = 'first'").select(F.col("part").alias("following_part"), F.col("body").alias("following"))
    last = walked.where("kind = 'last'").join(F.broadcast(steps), "part").join(first, "following_part")
    return walked.where("kind = 'whole'").select(*_NAMES).unionByName(last.select("doc_id", "body", "following").mapInArrow(_edges, _RESULT))
