"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as a protobuf message; normaliser, metaspace marker,
scores or merges, and byte fallback are rebuilt from it. No piece of the usual
models crosses from a word into the next marker, so a text falls apart into
segments (markers and the word after them) that are encoded on their own; each
distinct segment of a block of texts is encoded once, in multithreaded batches.
With byte fallback, many segments go through the tokenizer as one text, whose
ids fall apart again where the segments end. Where a model has a piece that
crosses, whole texts are encoded.

Parity is verified on every distinct segment against the SentencePiece library,
and by decoding every text again. ``exact`` tells whether decoding gives the
text back; it cannot for a text that holds the marker U+2581 itself, or where
the model's normaliser changes the text. A null text counts as empty; the empty
text has no ids. Repeated rows are treated each on its own.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.spread import plain
from codelake.llm.text import lists

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHARS = 1 << 19
#: Segments that the tokenizer has in hand at once.
AT_ONCE = 4096
#: Segments that are encoded as one text.
JOINED = 512
#: Segments whose ids are kept for the next block.
REMEMBERED = 200_000
MODEL_BYTES = 64 << 20

# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, message[at : at + size]
            at += size
        elif wire == 2:
            size = varint()
            yield number, message[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} is not part of the format")


class Model:
    """Pieces, scores and settings of a SentencePiece model file."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = b"", b""
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                trainer = value
            elif number == 3:
                normaliser = value
        settings = dict(fields(trainer))
        self.kind = settings.get(3, UNIGRAM)
        self.byte_fallback = bool(settings.get(35, 0))
        rules = dict(fields(normaliser))
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix = bool(rules.get(3, 1))
        self.squeeze = bool(rules.get(4, 1))
        self.ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        #: Whether a segment can be encoded on its own.
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED)) and not any(
            k == USER_DEFINED for _, _, k in self.pieces
        )

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces in the order in which they are joined: by the score of what they make."""
        known = {p for p, _, k in self.pieces if k == NORMAL}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                found += [(-score, self.ids[piece], i, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
        return [(left, right) for *_, left, right in sorted(found)]

    def tokenizer(self):
        """A tokenizers model for normalised text, markers included."""
        from tokenizers import Tokenizer, models

        if self.kind == BPE:
            unknown = self.pieces[self.unknown][0]
            core = models.BPE(self.ids, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        return Tokenizer(core)

    def normaliser(self):
        """A function from text to normalised text, before the prefix."""
        steps = []
        if self.charsmap:
            from tokenizers import normalizers

            steps.append(normalizers.Precompiled(self.charsmap).normalize_str)

        def run(text: str) -> str:
            for step in steps:
                text = step(text)
            if self.squeeze:
                text = " ".join(x for x in text.split(" ") if x)
            return text

        return run

    def piece_bytes(self) -> list[bytes]:
        """What each id decodes to; markers as spaces."""
        out = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind in (CONTROL, UNUSED):
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(piece.replace(MARK, " ").encode())
        return out


class Codec:
    """Encodes and decodes lists of texts."""

    def __init__(self, raw: bytes, threads: int = 1, verify: bool = True) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.model = Model(raw)
        self.tokenizer = self.model.tokenizer()
        self.normalise = self.model.normaliser()
        self.bytes = self.model.piece_bytes()
        self.lengths = np.array([len(b) for b in self.bytes])
        #: Bytes of normalised text that each id stands for; an unknown piece stands for any number.
        self.width = np.array([1 if k == BYTE else len(p.encode()) for p, _, k in self.model.pieces])
        self.joins = self.model.splits and self.model.kind == BPE and self.model.byte_fallback
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)

        self._forget()

    def _forget(self) -> None:
        """Ids of segments are kept from block to block, up to a bound."""
        self.code: dict[str, int] = defaultdict(count().__next__)
        self.size, self.pool, self.parity = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def segments(self, text: str) -> list[str]:
        """Markers with the word after them; their sequence is the normalised text."""
        text = self.normalise(text)
        if not text:
            return []
        if not self.model.splits:
            return [(MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)]
        parts = text.replace(MARK, " ").split(" ")
        head, rest = parts[0], [MARK + p for p in parts[1:]]
        out = ([MARK + head] if self.model.dummy_prefix else [head] if head else []) + rest
        if "" not in parts:
            return out
        joined: list[str] = []  # a marker without a word belongs to the next segment
        for part in out:
            if joined and not joined[-1].strip(MARK):
                joined[-1] += part
            else:
                joined.append(part)
        return joined

    def _ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids per segment."""
        if self.joins and all(s[0] == MARK != s[-1] for s in segments):
            texts = ["".join(segments[i : i + JOINED]) for i in range(0, len(segments), JOINED)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int32)
            ends = np.cumsum(self.width[ids])
            wanted = np.cumsum(np.fromiter(map(len, map(str.encode, segments)), np.int64, len(segments)))
            at = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[at], wanted):
                return ids, np.diff(at, prepend=-1)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64)

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, number of ids per segment, and whether SentencePiece gives the same."""
        parts = [self._ids(segments[low : low + AT_ONCE]) for low in range(0, len(segments), AT_ONCE)]
        ids, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if self.reference is None:
            return ids, size, np.ones(len(segments), bool)
        prefix = self.model.dummy_prefix and self.model.splits
        # The library puts the marker before a text by itself; a segment that begins with several has it once less.
        asked = [s.replace(MARK, " ")[1:] if prefix else s.replace(MARK, " ") for s in segments]
        expected = self.reference.encode(asked, num_threads=1)
        same = []
        for own, b, q, s in zip(np.split(ids, np.cumsum(size)[:-1]), expected, asked, segments, strict=True):
            a = own.tolist()
            same.append(a == b if not prefix or q else self.reference.piece_to_id(s) == a[0] or len(a) == len(s))
        return ids, size, np.array(same, bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, number of ids per text, and parity per text."""
        if len(self.code) > REMEMBERED:
            self._forget()
        code, known = self.code, len(self.code)
        flat, counts = [], []
        for text in texts:
            own = self.segments(text)
            counts.append(len(own))
            flat.extend(map(code.__getitem__, own))
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        if len(code) > known:
            ids, own_size, own_parity = self.encode_segments(list(islice(code, known, None)))
            self.size, self.pool = np.r_[self.size, own_size], np.r_[self.pool, ids]
            self.parity = np.r_[self.parity, own_parity]
        size, pool, parity = self.size, self.pool, self.parity
        begin = np.cumsum(size) - size
        flat = np.array(flat)
        own = size[flat]
        ends = np.cumsum(own)
        at = np.repeat(begin[flat] - (ends - own), own) + np.arange(ends[-1])
        segment_ends = np.cumsum(counts)
        per_text = np.diff(np.r_[0, np.r_[0, ends][segment_ends]])
        wrong = np.r_[0, np.cumsum(~parity[flat])]
        same = np.diff(np.r_[0, wrong[segment_ends]]) == 0
        return pool[at], per_text, same

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; a leading space that encoding put there is taken away."""
        if not hasattr(self, "_pool"):
            self._pool = np.frombuffer(b"".join(self.bytes), np.uint8)
            self._begin = np.cumsum(self.lengths) - self.lengths
        ids = np.asarray(ids)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = np.repeat(self._begin[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        text = self._pool[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file, read by Spark from whatever store it is in; bounded, as it is broadcast."""
    row = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("length", "content").first()
    if row["length"] > MODEL_BYTES:
        raise ValueError(f"the model has {row['length']} bytes; at most {MODEL_BYTES} are broadcast")
    return bytes(row["content"])


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``CHARS`` characters."""
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHARS:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _encode_rows(shared, threads: int, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, threads, verify)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in runs(texts):
                ids, counts, parity = codec.encode(texts[low:high])
                ends = np.cumsum(counts)
                exact = [codec.decode(ids[e - c : e]) == t for e, c, t in zip(ends, counts, texts[low:high], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.select(names).slice(low, high - low).columns, lists(ids, counts, pa.int32()), pa.array(counts, pa.int64()),
                        pa.array(parity, pa.bool_()), pa.array(exact, pa.bool_()),
                    ],
                    names=[*names, "ids", "n_ids", "parity", "exact"],
                )

    return run


def encode(docs: DataFrame, *keep: str, path: str = MODEL, threads: int = 2, verify: bool = True) -> DataFrame:
    """``keep`` columns, ``ids``, ``n_ids``, ``parity`` and ``exact`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(docs.sparkSession, path))
    rows = plain(docs, *keep, "text").withColumn("text", F.col("text").cast("string"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(_encode_rows(shared, threads, verify), f"{kept}ids array<int>, n_ids long, parity boolean, exact boolean")


def _decode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, verify=False)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "ids"]
            column = batch.column("ids")
            texts = [codec.decode(column[i].values.to_numpy()) if column[i].is_valid else None for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def decode(encoded: DataFrame, *keep: str, path: str = MODEL) -> DataFrame:
    """``keep`` columns and the ``text`` of the ``ids`` of every row; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(encoded.sparkSession, path))
    rows = plain(encoded, *keep, "ids")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "ids")
    return rows.mapInArrow(_decode_rows(shared), f"{kept}text string")
