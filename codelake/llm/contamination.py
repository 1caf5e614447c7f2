"""Benchmark decontamination by winnowing.

Texts are cut into word k-grams; of each window of w successive k-grams the one
with the least hash (the last of equals) is a fingerprint. Two texts that share
k + w - 1 words share the fingerprint of those words, whatever surrounds them.
Fingerprints of documents and of benchmark items meet in a join; each meeting
is extended word by word on both sides, and counts if it spans a whole window
of ``SPAN`` words. An item of fewer words is one window, with k and w to fit.

Nulls and texts without words have no words and are never hit; items without
words are never found. A null item id counts as empty text. Items with the same
id count once. Repeated document rows are treated each on its own. An empty
benchmark gives no hits. Other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.storage import Stored
from codelake.llm.spread import BROADCAST_BYTES, bitmap, plain, small_or_spread
from codelake.llm.text import bitmap_test, blocks, mix, signed

SPAN = 13
GRAM = 5
BITS = 22

_PRINTS = (
    "_rid long, id string, n_words long, span int, hash long, pos long, middle string,"
    " before array<string>, after array<string>"
)


def gram_length(span: int) -> int:
    return min(GRAM, span)


def winnow(values: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """Indices of the fingerprints: in each run of ``w`` values of one row the least, the last of equals."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    low = values
    reach = 1
    while reach < w:  # best of `reach` values that begin at each place, doubled
        step = min(reach, w - reach)
        m = len(best) - step
        right = low[step : step + m] <= low[:m]
        best = np.where(right, best[step : step + m], best[:m])
        low = np.where(right, low[step : step + m], low[:m])
        reach += step
    same = rows[: len(best)] == rows[w - 1 : w - 1 + len(best)]
    return np.unique(best[same])


def _prints(spans: list[int], bits: dict[int, np.ndarray] | None, by_length: bool):
    """Fingerprint rows of each text, and one row with span 0 for the text itself.

    ``by_length``: a text has only the span that its own length asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                words = block.words()
                hashes = words.hashes()
                ids = block.rows.column("id")
                rid = block.rows.column("_rid").to_numpy()
                out = {name: [] for name in ("row", "span", "hash", "pos", "middle", "before", "after")}
                none = [None] * len(block)
                for name, value in (
                    ("row", range(len(block))), ("span", [0] * len(block)), ("hash", rid.tolist()),
                    ("pos", none), ("middle", none), ("before", none), ("after", none),
                ):
                    out[name] += value
                grams = {}
                for span in spans:
                    k = gram_length(span)
                    if k not in grams:
                        grams[k] = words.grams(hashes, k)
                    at, value = grams[k]
                    if by_length:
                        fits = words.counts[words.row[at]]
                        keep = (fits >= span) if span == SPAN else (fits == span)
                        at, value = at[keep], value[keep]
                    rows = words.row[at]
                    pick = winnow(value, rows, span - k + 1)
                    if bits is not None:  # loses no item's fingerprint
                        pick = pick[bitmap_test(bits[span], mix(value[pick] + np.uint64(span)))]
                    side = span - k
                    for i, h in zip(at[pick].tolist(), signed(mix(value[pick] + np.uint64(span))).tolist(), strict=True):
                        row = int(words.row[i])
                        low, high = int(words.bounds[row]), int(words.bounds[row + 1])
                        out["row"].append(row)
                        out["span"].append(span)
                        out["hash"].append(h)
                        out["pos"].append(int(words.position[i]))
                        out["middle"].append(" ".join(words.texts(i, i + k)))
                        out["before"].append(words.texts(max(low, i - side), i)[::-1])
                        out["after"].append(words.texts(i + k, min(high, i + k + side)))
                row = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid).take(row), ids.take(row), pa.array(words.counts).take(row).cast(pa.int64()),
                        pa.array(out["span"], pa.int32()), pa.array(out["hash"], pa.int64()),
                        pa.array(out["pos"], pa.int64()), pa.array(out["middle"], pa.string()),
                        pa.array(out["before"], pa.list_(pa.string())), pa.array(out["after"], pa.list_(pa.string())),
                    ],
                    names=[f.split(" ")[0] for f in _PRINTS.replace(", ", ",").split(",")],
                )

    return run


def _agree(a: str, b: str):
    """Number of leading words that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, F.lit(False))
    return F.when(miss > 0, miss - 1).otherwise(F.size(same).cast("long"))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Shared spans: one row per document row and place, and the items of each window class.

    First frame: ``_rid``, ``id``, ``n_words``, ``start``, ``stop``, ``place``; a row
    without a hit comes with null in the last three. Second: ``place``, ``item_id``.
    """
    def keyed(df, key):
        return plain(df, key, "text").select(
            F.monotonically_increasing_id().alias("_rid"), F.col(key).cast("string").alias("id"), F.col("text").cast("string").alias("text")
        )

    items = (
        keyed(benchmark, "item_id").mapInArrow(_prints(list(range(1, SPAN + 1)), None, True), _PRINTS)
        .where("span > 0")
        .select("span", "hash", "middle", "before", "after", F.coalesce("id", F.lit("")).alias("item_id"),
                F.md5(F.concat_ws("\n", F.col("span").cast("string"), "middle", F.array_join("before", " "), F.array_join("after", " "))).alias("place"))
    )
    places = items.select("span", "hash", "middle", F.col("before").alias("i_before"), F.col("after").alias("i_after"), "place").distinct()
    spans = sorted(r["span"] for r in places.select("span").distinct().collect())  # 13 values at most
    bits = {s: bitmap(places.where(F.col("span") == s), "hash", BITS) for s in spans}
    found = keyed(docs, doc_id).mapInArrow(_prints(spans, bits, False), _PRINTS)
    met = small_or_spread(found, places, ["span", "hash", "middle"], "left", places.count() * 400, "_rid")
    left, right = _agree("before", "i_before"), _agree("after", "i_after")
    k = F.least(F.col("span"), F.lit(GRAM))
    met = met.withColumn("_left", left).withColumn("_right", right).withColumn(
        "_ok", F.coalesce((F.col("_left") + F.col("_right") + k >= F.col("span")) & (F.col("span") > 0), F.lit(False))
    )
    met = met.where("_ok or span = 0").select(
        "_rid", "id", "n_words",
        F.when(F.col("_ok"), F.col("pos") - F.col("_left")).alias("start"),
        F.when(F.col("_ok"), F.col("pos") + k + F.col("_right")).alias("stop"),
        F.when(F.col("_ok"), F.col("place")).alias("place"),
    )
    return met, items.select("place", "item_id").distinct()


def _report(docs: DataFrame, benchmark: DataFrame, doc_id: str) -> DataFrame:
    met, items = hits(docs, benchmark, doc_id)
    before = Window.partitionBy("_rid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    per_doc = (
        met.withColumn("_new", F.greatest(F.lit(0), F.coalesce(fresh, F.lit(0))))
        .groupBy("_rid", "id")
        .agg(F.max("n_words").alias("n_words"), F.sum("_new").alias("n_hit"), F.collect_set("place").alias("places"))
    )
    # A text without a place gets a key of its own, so that no key is common.
    flat = per_doc.withColumn("place", F.explode_outer("places")).withColumn(
        "place", F.coalesce("place", F.concat(F.lit("#"), F.col("_rid").cast("string")))
    )
    named = small_or_spread(flat.drop("places"), items, ["place"], "left", items.count() * 120, "_rid")
    out = named.groupBy("_rid", "id").agg(
        F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("item_ids")
    )
    return out.select(
        "id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: words hit, items found, and whether it counts as contaminated."""
    return _report(docs, benchmark, "doc_id").withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns and values, whatever their names."""
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    texts = docs.select(key.alias("key"), F.col("text"))
    found = _report(texts, benchmark, "key").where("contaminated").select(F.col("id").alias("key")).distinct()
    found = Stored(docs.sparkSession).table(found, "contaminated")
    if found.count() * 80 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    # The rows travel in one column, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(found, "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
