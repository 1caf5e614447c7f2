"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams of lower-cased characters per language come
from every training text, summed by Spark. The log-probability matrix has
``2**BITS`` rows and one column per language, whatever the corpus, and is
broadcast; texts are scored in numpy blocks.

A null text, and one without any letter, is ``und`` with score 0; so is every
text if nothing was learned. Texts with null language teach nothing. Ties go to
the language that sorts first. Repeated rows are treated each on its own. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.spread import BROADCAST_BYTES, plain

BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: The score is the posterior as if a text had at most so many n-grams.
EVIDENCE = 60.0
UNDETERMINED = "und"
CHARS = 1 << 19

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x (buckets + 1); the last column is for no n-gram
    prior: np.ndarray


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of about ``CHARS`` characters, lower-cased."""
    low, size, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append((text or "").lower())
        size += len(run[-1])
        if size >= CHARS:
            yield low, i + 1, run
            low, size, run = i + 1, 0, []
    if run:
        yield low, len(texts), run


def buckets(texts: list[str]) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Row offsets in characters, and for each order the bucket of every n-gram (``2**BITS``: none)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def each():
        for n in ORDERS:
            h = np.full(len(chars), n, np.uint32)
            for j in range(n):
                h[: len(chars) - j] += chars[j:] * _MULTIPLIERS[j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            h >>= np.uint32(32 - BITS)
            for j in range(1, n):  # the last characters of a text begin no n-gram
                end = offsets[1:] - j
                h[end[end >= offsets[:-1]]] = 1 << BITS
            yield h

    return offsets, each()


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    width = (1 << BITS) + 1
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for low, high, texts in _pieces(batch.column("text").to_pylist()):
            names = sorted(set(languages[low:high]))
            code = np.array([names.index(x) for x in languages[low:high]], np.int32)
            offsets, orders = buckets(texts)
            base = np.repeat(code * width, np.diff(offsets))
            found = np.zeros(len(names) * width, np.int64)
            for h in orders:
                found += np.bincount(base + h.astype(np.int32), minlength=len(found))
            for i, name in enumerate(names):
                totals[name] = totals.get(name, 0) + found[i * width : (i + 1) * width]
            for x in languages[low:high]:
                docs[x] = docs.get(x, 0) + 1
    for name, counts in totals.items():
        counts[-1] = 0
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(at) + 1)), pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[counts[at], docs[name]], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def train(docs: DataFrame, learn: Column | None = None) -> Model:
    """Learns from the texts with a language, of the rows for which ``learn`` holds."""
    rows = docs if learn is None else docs.where(learn)
    rows = plain(rows, "lang", "text").where("lang is not null and text is not null")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(1 + (BROADCAST_BYTES >> BITS + 2)).collect())
    if len(languages) << (BITS + 2) > BROADCAST_BYTES:
        raise ValueError("too many languages for one broadcast matrix")
    counts = rows.mapInArrow(_count_rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    table = np.zeros((len(languages), (1 << BITS) + 1))
    prior = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        grams = own[own["bucket"] >= 0]
        table[i, grams["bucket"].to_numpy()] = grams["n"].to_numpy()
        prior[i] = own.loc[own["bucket"] < 0, "n"].sum()
    smooth = table[:, :-1] + SMOOTHING
    table[:, :-1] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    table[:, -1] = 0
    return Model(tuple(languages), table.astype(np.float32), np.log(np.maximum(prior, 1) / max(prior.sum(), 1)))


def _predicted(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language of each text (one past the last: undetermined), and its score."""
    pred = np.full(len(texts), len(model.languages))
    score = np.zeros(len(texts))
    for low, high, run in _pieces(texts):
        lettered = np.array([any(map(str.isalpha, t)) for t in run])
        if not model.languages or not lettered.any():
            continue
        offsets, orders = buckets(run)
        filled = np.diff(offsets) > 0
        starts = offsets[:-1][filled]
        total = np.zeros((len(run), len(model.languages)))
        for h in orders:
            for i in range(len(model.languages)):
                total[filled, i] += np.add.reduceat(model.log_prob[i][h], starts, dtype=np.float64)
        grams = np.maximum(len(ORDERS) * np.diff(offsets), 1)[:, None]
        total += model.prior
        tempered = total * np.minimum(1, EVIDENCE / grams)
        tempered -= tempered.max(axis=1, keepdims=True)
        posterior = np.exp(tempered)
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        pred[low:high][lettered] = best[lettered]
        score[low:high][lettered] = posterior[np.arange(len(run)), best][lettered]
    return pred, score


def _predict_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNDETERMINED], object)
        for batch in batches:
            pred, score = _predicted(shared.value, batch.column("text").to_pylist())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, pa.array(names[pred].tolist(), pa.string()), pa.array(score, pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    return run


def _sure_rows(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = _predicted(shared.value, batch.column("text").to_pylist())
            yield batch.filter(pa.array((pred < len(shared.value.languages)) & (score >= least)))

    return run


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row."""
    rows = plain(docs, *keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict_rows(shared), f"{kept}, lang_pred string, score double")


def sure_rows(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is told with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_sure_rows(shared, least), docs.schema)
