"""Quality classifier by positive-unlabelled learning.

A linear model over text features is fitted with the non-negative unbiased risk:
``prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])`` with the
logistic loss, trusted positives P and unlabelled texts U. The prior is the share
of positives among the labels of the training rows. The fit uses at most
``positives`` and ``unlabelled`` texts, those whose hashed ids are least; of
several rows with one id, the text of the least hash teaches. All texts are
scored.

A null text counts as empty. A text without words scores 0. Labels that are null
are ignored; an id with several labels is positive if one of them is. Without a
trusted positive every text scores 0.5. Repeated rows are treated each on its
own. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.spread import plain
from codelake.llm.text import Block, blocks, byte_lists, mix

POSITIVES = 6000
UNLABELLED = 12000
THRESHOLD = 0.7
PAIR_BITS = 9
STEPS = 400
RATE = 0.05
PENALTY = 1e-4

_LINES = np.arange(256) != 10
_byte = np.arange(256)
#: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 punctuation, 7 beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[(_byte >= 97) & (_byte <= 122)] = 1
_CLASS[(_byte >= 65) & (_byte <= 90)] = 2
_CLASS[(_byte >= 48) & (_byte <= 57)] = 3
_CLASS[_byte == 32] = 4
_CLASS[_byte == 10] = 5
_CLASS[((_byte >= 33) & (_byte <= 47)) | ((_byte >= 58) & (_byte <= 64)) | ((_byte >= 91) & (_byte <= 96)) | ((_byte >= 123) & (_byte <= 126))] = 6
_CLASS[_byte >= 128] = 7
STATS = 10
WIDTH = (1 << PAIR_BITS) + 64 + STATS


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per row, and the most frequent value's count."""
    mixed = np.sort(((value >> np.uint64(24)) << np.uint64(0)) | (row.astype(np.uint64) << np.uint64(40)))
    if not len(mixed):
        return np.zeros(n), np.zeros(n)
    head = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]])
    size = np.diff(np.r_[head, len(mixed)])
    owner = (mixed[head] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, size)
    return np.bincount(owner, minlength=n).astype(float), most


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per text, and its number of words."""
    n = len(block)
    data, offsets = block.data, block.offsets
    length = np.diff(offsets)
    row = np.repeat(np.arange(n), length)
    kind = _CLASS[data]
    classes = np.bincount(row * 8 + kind, minlength=n * 8).reshape(n, 8)
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(data) > 1 else np.zeros(0, np.int64)
    pair = ((data[inner].astype(np.uint32) * 31 + data[inner + 1]) * np.uint32(2654435761)) >> np.uint32(32 - PAIR_BITS)
    pairs = np.bincount(row[inner] * (1 << PAIR_BITS) + pair, minlength=n << PAIR_BITS).reshape(n, -1)
    steps = np.bincount(row[inner] * 64 + kind[inner] * 8 + kind[inner + 1], minlength=n * 64).reshape(n, 64)
    words = block.words()
    hashes = mix(words.hashes())
    count = words.counts
    distinct, most = _distinct(words.row, hashes, n)
    same = np.flatnonzero((words.row[1:] == words.row[:-1]) & (hashes[1:] == hashes[:-1])) if len(words) > 1 else np.zeros(0, np.int64)
    twins = np.bincount(words.row[same], minlength=n)
    lines = block.words(_LINES)
    line_kinds, _ = _distinct(lines.row, lines.hashes(), n)
    some, bytes_, letters = np.maximum(count, 1), np.maximum(length, 1), np.maximum(classes[:, 1] + classes[:, 2], 1)
    stats = np.column_stack(
        [
            np.log1p(length) / 10, np.log1p(count) / 10, classes[:, 2] / letters, classes[:, 6] / bytes_ * 5,
            classes[:, 3] / bytes_ * 5, distinct / some, most / some, twins / some,
            np.bincount(words.row, words.end - words.start, n) / some / 10,
            1 - line_kinds / np.maximum(lines.counts, 1),
        ]
    )
    share = np.sqrt(np.column_stack([pairs, steps]) / bytes_[:, None])
    return np.column_stack([share, stats]).astype(np.float32), count


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.where(words > 0, 0.5, 0.0)
        g = ((x - self.centre) / self.scale).astype(np.float64) @ self.weights + self.bias
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(g, -500, 500))), 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _spread(x: np.ndarray, columns: int = 32) -> np.ndarray:
    """``x.std(axis=0)``, some columns at a time: the whole would take a copy of the sample."""
    return np.concatenate([x[:, c : c + columns].std(axis=0) for c in range(0, x.shape[1], columns)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative unbiased risk by Adam over the whole sample, whose arrays are standardised in place."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(0), 0.0, np.zeros(0), np.ones(0))
    centre, scale = unlabelled.mean(axis=0), _spread(unlabelled) + 1e-2
    p, u = positive, unlabelled
    for x in (p, u):
        x -= centre
        x /= scale
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        gp, gu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # Derivatives of the losses by g.
        up = -prior * _sigmoid(-gp) / len(p)
        down_u, down_p = _sigmoid(gu) / len(u), -prior * _sigmoid(gp) / len(p)
        if negative >= 0:
            dp, du = up + down_p, down_u
        else:  # step back until the negative risk is not below zero
            dp, du = -down_p, -down_u
        gradient = np.r_[dp @ p + du @ u + PENALTY * w, dp.sum() + du.sum()]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        change = RATE * (1 - 0.9 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - change[:-1]).astype(np.float32), b - change[-1]
    return Model(w.astype(np.float64), float(b), centre, scale)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            x, words = features(block)
            filled = np.flatnonzero(words > 0)
            own = block.rows.select(["doc_id", "positive"]).take(pa.array(filled))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, byte_lists(x[filled].ravel(), np.full(len(filled), WIDTH))], names=["doc_id", "positive", "x"]
            )


def _fit_rows(most: tuple[int, int], prior: float):
    """Fits a model to all rows it gets, at most ``most`` others and positives, and returns it as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.empty((n, WIDTH), np.float32) for n in most]
        size = [0, 0]
        for batch in batches:
            mark = np.asarray(batch.column("positive").to_numpy(zero_copy_only=False), bool)
            c = batch.column("x")
            x = np.frombuffer(c.buffers()[2] or b"", np.float32)[c.offset * WIDTH :][: len(c) * WIDTH].reshape(-1, WIDTH)
            for i, chosen in enumerate((~mark, mark)):
                n = int(chosen.sum())
                parts[i][size[i] : size[i] + n] = x[chosen]
                size[i] += n
        other, positive = (part[:n] for part, n in zip(parts, size, strict=True))
        model = fit(positive, other, prior)
        arrays = [np.asarray(model.weights, np.float64), np.asarray(model.centre, np.float32), np.asarray(model.scale, np.float32)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([a.tobytes()], pa.binary()) for a in arrays], pa.array([model.bias], pa.float64())],
            names=["weights", "centre", "scale", "bias"],
        )

    return run


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED
) -> Model:
    """Learns from the rows for which ``learn``, an expression over ``doc_id``, holds."""
    marks = plain(labels, "doc_id", "quality").where(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = marks.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]

    def first(ids: DataFrame, n: int, seed: int) -> DataFrame:
        return ids.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)

    texts = plain(docs, "doc_id", "text").where(learn)
    chosen = first(marks.where("quality = 1"), positives, 1).withColumn("positive", F.lit(True)).unionByName(
        first(texts, unlabelled, 2).withColumn("positive", F.lit(False))
    )
    # One text of each chosen id, however many rows it has: the sample is bounded.
    one = F.min_by(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).alias("text")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(one)
    # The sample meets in one task, in an order of its own; the driver gets the weights only.
    found = sample.mapInArrow(_feature_rows, sample.drop("text").withColumn("x", F.lit(b"")).schema)
    fitted = found.repartition(1).sortWithinPartitions("positive", "doc_id").mapInArrow(
        _fit_rows((unlabelled, positives), float(share or 0.5)), "weights binary, centre binary, scale binary, bias double"
    ).first()
    if fitted is None:
        return fit(np.zeros((0, WIDTH)), np.zeros((0, WIDTH)), 0.5)
    kinds = {"weights": np.float64, "centre": np.float32, "scale": np.float32}
    return Model(**{name: np.frombuffer(fitted[name], kind) for name, kind in kinds.items()}, bias=fitted["bias"])


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for block in blocks(batch):
                names = [c for c in block.rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*block.rows.select(names).columns, pa.array(model.score(*features(block)), pa.float64())], names=[*names, "score"]
                )

    return run


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns and ``score`` of every row."""
    rows = plain(docs, *keep, "text").withColumn("text", F.col("text").cast("string"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score_rows(shared), f"{kept}, score double")


def _good_rows(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield block.rows.filter(pa.array(shared.value.score(*features(block)) >= least))

    return run


def good_rows(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_good_rows(shared, least), docs.schema)
