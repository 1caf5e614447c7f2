"""Language-model scores by prediction by partial matching, beside a smoothed unigram score.

Model: a trie of byte contexts up to ``ORDER`` bytes, learned from all training
texts and then fixed. A text is its bytes and an end mark. In the longest known
context a symbol seen there costs count / (total + distinct); otherwise the
escape, distinct / (total + distinct), is paid and the context is shortened,
with all symbols seen so far excluded from the counts. Below the empty context
all symbols not excluded are equally likely.

Spark counts all (context, symbol) pairs of the longest order, held in one
64-bit number, over all texts, and derives the shorter orders and the cost of
every pair that occurs from that table by grouping and joining. Scoring is then
a lookup of each pair: the most frequent pairs, as many as fit in
``BROADCAST_BYTES``, are broadcast, and only the occurrences of all others are
shuffled and joined. Word counts for the base score are looked up likewise.

A null text counts as empty, which costs its end mark. Without training texts
every symbol costs a uniform share and every word is unknown. Repeated rows are
treated each on its own. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.storage import Stored
from codelake.llm.spread import plain
from codelake.llm.text import TOKEN_BYTES, Block, blocks, mix, signed

ORDER = 4
#: Bytes that UTF-8 never uses: the mark before a text, and the one after it.
BEGIN, END = 0xFF, 0xFE
SYMBOLS = 256
ADD = 0.1
BROADCAST_BYTES = 24 << 20
END_TOKEN = np.uint64(0x5EED0FE0D0C50001)

_WIDTH = ORDER + 1


def pairs(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every byte and end mark, most recent byte lowest, and the row of each."""
    n = len(block)
    length = np.diff(block.offsets) + _WIDTH
    stop = np.cumsum(length)
    padded = np.full(int(stop[-1]) if n else 0, BEGIN, np.uint8)
    row = np.repeat(np.arange(n), length)
    inner = np.ones(len(padded), bool)
    inner[((stop - length)[:, None] + np.arange(ORDER)).ravel()] = False  # begin marks
    last = stop - 1
    body = inner.copy()
    body[last] = False
    padded[body] = block.data
    padded[last] = END
    key = np.zeros(len(padded), np.uint64)
    for back in range(ORDER + 1):
        key[back:] |= padded[: len(padded) - back].astype(np.uint64) << np.uint64(8 * back)
    return key[inner], row[inner]


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token, the end token of each text last."""
    words = block.words(TOKEN_BYTES)
    n = len(block)
    return np.r_[words.hashes(), np.full(n, END_TOKEN)], np.r_[words.row, np.arange(n)]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.r_[head, len(keys)])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of several tables of keys and counts."""
    keys, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[head], np.add.reduceat(counts, head)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (kind 0) and words (kind 1) with their counts in training texts; pairs of other texts count 0."""
    held: dict[tuple[int, bool], list] = {}

    def emit(kind: int, learn: bool) -> pa.RecordBatch:
        keys, counts = _merged(held.pop((kind, learn)))
        n = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(signed(keys)), pa.array(counts if learn else np.zeros(n, np.int64), pa.int64())],
            names=["kind", "key", "n"],
        )

    for batch in batches:
        learn = batch.column("_learn")
        for which in (True, False):
            part = batch.filter(learn if which else pa.compute.invert(learn))
            for block in blocks(part):
                for kind, keys in ((0, pairs(block)[0]), (1, tokens(block)[0] if which else None)):
                    if keys is None:
                        continue
                    own = held.setdefault((kind, which), [])
                    own.append(_grouped(keys))
                    if sum(len(k) for k, _ in own[1:]) > 1 << 20:
                        held[kind, which] = [_merged(own)]
                    if len(held[kind, which][0][0]) > 1 << 21:  # memory stays bounded
                        yield emit(kind, which)
    for kind, which in list(held):
        yield emit(kind, which)


def costs(grams: DataFrame, store: Stored) -> DataFrame:
    """``key``, ``n`` and ``cost``, its log10 probability, for every pair in ``grams`` (``key``, ``n``: training count)."""
    levels: list[DataFrame] = []
    for order in range(ORDER + 1):
        mask = (1 << (8 * (order + 1))) - 1
        counted = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("g")).agg(F.sum("n").alias("n"))
        levels.append(store.table(counted.withColumn("context", F.shiftrightunsigned("g", 8)), f"order{order}"))
    # Per context: total and distinct, and what is left of them one order below once its symbols are excluded.
    nodes: list[DataFrame] = []
    for order, level in enumerate(levels):
        own = level
        if order:
            below = levels[order - 1].select(F.col("g").alias("shorter"), F.col("n").alias("fewer"))
            short = (1 << (8 * order)) - 1
            own = level.withColumn("shorter", F.col("g").bitwiseAND(F.lit(short))).join(below, "shorter")
        else:
            own = level.withColumn("fewer", F.lit(0).cast("long"))
        nodes.append(
            store.table(
                own.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("fewer").alias("excluded")), f"nodes{order}"
            )
        )
    # The cost of a pair, from the longest order down: `open` while the symbol has not been met.
    log = lambda x: F.log10(x.cast("double"))
    rows = grams.select("key", "n").withColumns({"cost": F.lit(0.0), "done": F.lit(False), "cut_n": F.lit(0).cast("long"), "cut_q": F.lit(0).cast("long")})
    for order in range(ORDER, -1, -1):
        mask, above = (1 << (8 * (order + 1))) - 1, (1 << (8 * order)) - 1
        rows = rows.withColumn("g", F.col("key").bitwiseAND(F.lit(mask))).withColumn("context", F.shiftrightunsigned("g", 8))
        here = nodes[order].withColumnRenamed("excluded", "lower")
        met = levels[order].select("g", F.col("n").alias("seen"))
        if order <= 1:  # 256 contexts and 65,536 pairs at most
            here, met = F.broadcast(here), F.broadcast(met)
        rows = rows.join(here, "context", "left").join(met, "g", "left")
        left_n, left_q = F.col("total") - F.col("cut_n"), F.col("distinct") - F.col("cut_q")
        known = F.col("total").isNotNull() & ~F.col("done")
        found = known & F.col("seen").isNotNull()
        escape = known & ~found
        base = left_n + left_q
        cost = F.when(found, log(F.col("seen")) - log(base)).when(
            escape, F.when(left_q > 0, log(left_q) - log(base)).otherwise(F.lit(0.0))
        ).otherwise(F.lit(0.0))
        rows = rows.select(
            "key", "n",
            (F.col("cost") + cost).alias("cost"),
            (F.col("done") | found).alias("done"),
            F.when(escape, F.col("lower")).otherwise(F.col("cut_n")).alias("cut_n"),
            F.when(escape, F.col("distinct")).otherwise(F.col("cut_q")).alias("cut_q"),
        )
    uniform = -log(F.lit(SYMBOLS) - F.col("cut_q"))
    return rows.select("key", "n", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + uniform).alias("cost"))


class Table:
    """Sorted keys with a value each, to be broadcast."""

    def __init__(self, rows: DataFrame, value: str) -> None:
        found = rows.select("key", value).toArrow()
        keys = found["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], found[value].to_numpy()[order]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each key is there."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[slot], self.keys[slot] == keys


def _frequent(counted: DataFrame, room: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with the greatest ``n``, at most ``room`` of them, and all others if there are any; equal counts stay together."""
    if counted.count() <= room:
        return counted, None
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).limit(room).collect()
    least, used = None, 0
    for size in sizes:
        if used + size["rows"] > room:
            break
        least, used = size["n"], used + size["rows"]
    if least is None:
        return counted.limit(0), counted
    return counted.where(F.col("n") >= F.lit(least)), counted.where(F.col("n") < F.lit(least))


def _occurrences(keys: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and count of every key in every row, by key; keys are of ``bits`` bits, rows of the others."""
    packed, times = _grouped(keys << np.uint64(64 - bits) | row.astype(np.uint64))
    return (packed & np.uint64((1 << (64 - bits)) - 1)).astype(np.int64), packed >> np.uint64(64 - bits), times


def _at_rows(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and count of every key in every row, for keys of 64 bits."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[head], keys[head], np.diff(np.r_[head, len(row)])


def _partial(shared_costs, shared_words):
    """Per text: what the broadcast tables give (kind 0), and a row per other word (kind 1) or pair (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_costs, known_words = shared_costs.value, shared_words.value
        for batch in batches:
            for block in blocks(batch):
                n = len(block)
                out = []
                keys, row = tokens(block)
                count, there = known_words.get(keys)
                log = np.where(there, np.log10(np.maximum(count, 0) + ADD), 0.0)
                base = np.bincount(row, log, n)
                total = np.bincount(row, minlength=n)
                hit = np.bincount(row[there & (count > 0)], minlength=n)
                at, key, times = _at_rows(row[~there], keys[~there])
                out.append((1, at, key, times))
                at, key, times = _occurrences(*pairs(block), 8 * _WIDTH)
                head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # each distinct key is looked up once
                own = np.diff(np.r_[head, len(key)])
                values, there = (np.repeat(found, own) for found in known_costs.get(key[head]))
                score = np.bincount(at[there], (values * times)[there], n)
                out.append((2, at[~there], key[~there], times[~there]))
                rid = block.rows.column("_rid")
                for kind, at, k, times in [(0, np.arange(n), np.zeros(n, np.uint64), None), *out]:
                    whole = kind == 0
                    at_array = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rid.take(at_array), block.rows.column("doc_id").take(at_array), block.rows.column("held_out").take(at_array),
                            pa.array(np.full(len(at), kind, np.int32)), pa.array(signed(k)), pa.array(total if whole else times, pa.int64()),
                            pa.array(hit if whole else np.zeros(len(at), np.int64), pa.int64()),
                            pa.array(base if whole else np.zeros(len(at)), pa.float64()), pa.array(score if whole else np.zeros(len(at)), pa.float64()),
                        ],
                        names=["_rid", "doc_id", "held_out", "kind", "key", "n", "hit", "base", "score"],
                    )

    return run


_PARTIAL = "_rid long, doc_id long, held_out boolean, kind int, key long, n long, hit long, base double, score double"


def scores(docs: DataFrame, held_out: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Scores of every text under the model of those for which ``held_out`` does not hold.

    Columns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, both log10 probabilities.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    rows = plain(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    table = (
        rows.select("text", (~F.col("held_out")).alias("_learn")).mapInArrow(_tables, "kind int, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))
    )
    table = store.table(table, "tables", ["kind"])
    words = table.where("kind = 1").select("key", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, distinct = int(totals[0]), int(totals[1])
    priced = store.table(costs(table.where("kind = 0").select("key", "n"), store), "costs")
    frequent_pairs, other_pairs = _frequent(priced, broadcast_bytes // 16)
    frequent_words, other_words = _frequent(words, broadcast_bytes // 32)
    shared_costs = spark.sparkContext.broadcast(Table(frequent_pairs, "cost"))
    shared_words = spark.sparkContext.broadcast(Table(frequent_words, "n"))
    partial = rows.mapInArrow(_partial(shared_costs, shared_words), _PARTIAL)
    # A left join, so that words that no training text has count 0; of pairs all have a cost.
    rest = words.limit(0) if other_words is None else other_words
    value = rest.select(F.lit(1).alias("kind"), "key", F.col("n").alias("count"), F.lit(None).cast("double").alias("cost"))
    if other_pairs is not None:
        value = value.unionByName(other_pairs.select(F.lit(2).alias("kind"), "key", F.lit(None).cast("long").alias("count"), "cost"))
    # Rows of whole texts find nothing; their key is their own, so that none is common.
    partial = partial.withColumn("key", F.when(F.col("kind") == 0, F.col("_rid")).otherwise(F.col("key")))
    joined = partial.join(value, ["kind", "key"], "left")
    count = F.coalesce("count", F.lit(0))
    per_text = joined.groupBy("_rid", "doc_id", "held_out").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(F.col("kind") == 0, F.col("hit")).when((F.col("kind") == 1) & (count > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log10(count + F.lit(ADD))).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * F.col("cost")).otherwise(F.col("score"))).alias("score"),
    )
    base = math.log10(train_tokens + ADD * (distinct + 1))
    return per_text.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score",
    )
