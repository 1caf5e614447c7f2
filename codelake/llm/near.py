"""Near-duplicate classes by order MinHash.

Shingles are runs of five words, labelled with their occurrence in the text. A
sketch is the pair of shingles that are least under one hash, kept in text
order, so it agrees for texts that are close in edit distance and not merely in
content. Two sketches make a band; texts that agree in a band are candidates.
Candidates are verified by aligning the labelled shingles within a band around
the diagonal: two texts of n and m shingles of which L align are linked if
L / (n + m - L) >= 0.8. Such texts differ by at most (n + m) / 9 insertions and
deletions, so that band width loses nothing.

Equal texts are one node. In each bucket of a band all texts are aligned with
one leader, the text with most company over all bands. The texts that a leader
was aligned with are its group, and in rounds further texts of a group lead,
four times as many in each round up to a bound per round, until a group lies in
one class or is used up. Each task holds a chunk of a round's leaders and a chunk
of a group, both bounded in bytes (or one text, if that is longer), counts common
shingles, aligns the pairs that have enough of them, and returns links only.
Leaders are the texts with most room; groups beyond what one task may rank are
ranked in salted rounds, so a group may hold any share of all rows. A text leaves its group if its differences to the leader
prove that it has no partner left there: linked texts share most of their
differences, so those that a text alone has keep it apart from all others. No
candidate is dropped otherwise, and texts in one class are not compared again.
Linked texts that share no band are no candidates: of pairs with similarity 0.8
about 1 in 5 000 for long texts, 1 in 2 500 where the two texts have 10 different
shingles together and 1 in 1 260 where they have 5, by calculation.

A null or empty text, or one without words, is equal only to texts with the
same bytes (null and empty count as equal). A text of fewer than five words has
one shingle. Repeated rows are copies of one another. A class is named by its
least document id; the row with that id stays, and of several such rows one.
An empty table gives an empty result. ``kept_rows`` keeps all other columns with
their values, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.skew import first_rows, lookup_join
from codelake.functions.storage import Stored
from codelake.llm.components import components
from codelake.llm.spread import bitmap, plain
from codelake.llm.text import Block, bitmap_test, blocks, byte_lists, lists, mix, seeds, signed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
SKETCHES_A_BAND = 2
BITS = 24
#: Leaders of a group in the second round, and at most; texts of a group in one task, and bytes of texts and of leaders.
LEADERS, MOST_LEADERS, CHUNK, CHUNK_BYTES = 256, 4096, 1000, 16 << 20
#: Texts that one task ranks; larger groups are ranked in salted rounds, each of which leaves a quarter at most.
RANKED, FUNNEL = 16384, 4
HOT_ROWS = 2000


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all rows in text order, and their number per row."""
    words = block.words()
    hashes = words.hashes()
    at, value = words.grams(hashes, SHINGLE)
    row = words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        own = []
        for r in short.tolist():
            total = np.uint64(0)
            for h, m in zip(hashes[words.bounds[r] : words.bounds[r + 1]], seeds(SHINGLE, 991), strict=False):
                total = np.uint64((int(total) + int(h) * int(m)) % 2**64)
            own.append(total)
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        row, value = row[order], np.concatenate([value, mix(np.array(own, np.uint64))])[order]
    counts = np.bincount(row, minlength=len(block))
    # The second, third, ... occurrence within one text gets a value of its own.
    own = value ^ mix(row.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        slot = np.searchsorted(twice, own)
        repeated = np.flatnonzero(twice[np.minimum(slot, len(twice) - 1)] == own)
        order = repeated[np.argsort(own[repeated], kind="stable")]
        group = own[order]
        head = np.r_[True, group[1:] != group[:-1]]
        start = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
        number = np.arange(len(group)) - start
        order, number = order[number > 0], number[number > 0].astype(np.uint64)
        value = value.copy()
        value[order] = mix(value[order] + number * np.uint64(0x9E3779B97F4A7C15))
    return value, counts


def sketches(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Band hashes, one row per text with shingles, one column per band."""
    have = counts > 0
    starts = (np.cumsum(counts) - counts)[have]
    n = int(have.sum())
    out = np.zeros((n, BANDS), np.uint64)
    if not n:
        return out
    length = counts[have]
    text = np.repeat(np.arange(n), length)
    for s, m in enumerate(seeds(BANDS * SKETCHES_A_BAND, 4242)):
        h = (value ^ (value >> np.uint64(29))) * m
        h ^= h >> np.uint64(32)
        first = np.minimum.reduceat(h, starts)
        spot = np.flatnonzero(h == first[text])
        spot = spot[np.r_[True, text[spot[1:]] != text[spot[:-1]]]]
        h[spot] = np.uint64(2**64 - 1)
        second = np.minimum.reduceat(h, starts)
        other = np.flatnonzero(h == second[text])
        other = other[np.r_[True, text[other[1:]] != text[other[:-1]]]]
        low, high = np.minimum(spot, other), np.maximum(spot, other)  # in text order
        sketch = mix(value[low] * np.uint64(3) + mix(value[high]))
        band = s // SKETCHES_A_BAND
        out[:, band] = mix(out[:, band] + sketch * np.uint64(2 * s + 1))
    return out


_SKETCHED = "key binary, doc_id long, n long, bands array<long>"


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            value, counts = shingles(block)
            bands = sketches(value, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("key"), block.rows.column("doc_id"), pa.array(counts, pa.int64()),
                    lists(signed(bands.ravel()), np.where(counts > 0, BANDS, 0), pa.int64()),
                ],
                names=["key", "doc_id", "n", "bands"],
            )


def _sequence_rows(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag = batch.column("tag").to_numpy().view(np.uint64)
            batch = batch.filter(pa.array(bitmap_test(bits, tag)))
            for block in blocks(batch):
                value, counts = shingles(block)
                yield pa.RecordBatch.from_arrays(
                    [block.rows.column("key"), byte_lists(value, counts)], names=["key", "seq"]
                )

    return run


def increasing(places: np.ndarray) -> int:
    """Length of the longest increasing run of places that need not be adjacent."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        i = bisect_left(tails, p)
        if i == len(tails):
            tails.append(p)
        else:
            tails[i] = p
    return len(tails)


class Leader:
    """A text that many others are aligned with."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.sequence = sequence
        self.order = np.argsort(sequence)
        self.ordered = sequence[self.order]

    def compare(self, other: np.ndarray) -> tuple[float, np.ndarray]:
        """Similarity, and the differences: the shingles that only one of the two texts has.

        All are told: where one text's list ended early, those that it shares
        with another text would pass for the other's own.
        """
        n, m = len(self.sequence), len(other)
        slot = np.minimum(np.searchsorted(self.ordered, other), n - 1)
        both = self.ordered[slot] == other
        place, here = self.order[slot[both]], np.flatnonzero(both)
        near = np.abs(place - here) <= (n + m) // 9
        aligned = increasing(place[near])
        missing = np.ones(n, bool)
        missing[place] = False
        keys = mix(np.concatenate([other[~both], self.sequence[missing]]))
        return aligned / (n + m - aligned), keys


_COMPARED = "leader binary, node binary, n long, similarity double, differences array<long>"


def _compare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, leader = None, None
    for batch in batches:
        names, nodes = batch.column("leader").to_pylist(), batch.column("node").to_pylist()
        ours, theirs = batch.column("leader_seq"), batch.column("seq")
        size, similarity, keys = [], [], []
        for i, name in enumerate(names):
            if name != last:
                last, leader = name, Leader(np.frombuffer(ours[i].as_py(), np.uint64))
            other = np.frombuffer(theirs[i].as_py(), np.uint64)
            value, differences = leader.compare(other)
            size.append(len(other))
            similarity.append(value)
            keys.append(signed(differences))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.binary()), pa.array(nodes, pa.binary()), pa.array(size, pa.int64()), pa.array(similarity, pa.float64()),
                lists(np.concatenate(keys) if keys else np.zeros(0, np.int64), np.array([len(k) for k in keys], np.int64), pa.int64()),
            ],
            names=["leader", "node", "n", "similarity", "differences"],
        )


def _meet(members: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
    """Links between a chunk of a group and leaders that rank before them, one for each other class."""
    links = []
    if len(members) and len(leaders):
        sequences = [np.frombuffer(s, np.uint64) for s in leaders["seq"]]
        sizes = np.array([len(s) for s in sequences])
        owner = np.repeat(np.arange(len(sequences)), sizes)
        values = np.concatenate(sequences)
        order = np.argsort(values)
        values, owner = values[order], owner[order]
        ranks, labels = leaders["rank"].to_numpy(), leaders["label"].to_numpy()
        made: dict[int, Leader] = {}
        for node, rank, label, raw in zip(members["node"], members["rank"], members["label"], members["seq"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(sequences))
            enough = (common >= SIMILARITY * (sizes + len(own) - common)) & (ranks < rank)
            done = {label}
            for i in np.flatnonzero(enough).tolist():
                if labels[i] in done:
                    continue
                if i not in made:
                    made[i] = Leader(sequences[i])
                if made[i].compare(own)[0] >= SIMILARITY:
                    links.append((leaders["node"].iat[i], node))
                    done.add(labels[i])
    return pd.DataFrame(links, columns=["a", "b"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return plain(docs, "doc_id", "text").select(
        F.unhex(F.md5(text.cast("binary"))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")
    )


def _tag(key: str):
    return F.xxhash64(key)


def _compared(pairs: DataFrame, sequences: DataFrame, store: Stored) -> DataFrame:
    both = pairs.join(sequences.withColumnRenamed("key", "node"), "node").join(
        sequences.select(F.col("key").alias("leader"), F.col("seq").alias("leader_seq")), "leader"
    )
    return store.table(both.mapInArrow(_compare_rows, _COMPARED), "compared")


def _room(compared: DataFrame) -> DataFrame:
    """Groups (``bucket``, the leader) with the room that each text has for differences to others, beyond its own."""
    flat = compared.select("leader", "node", F.explode("differences").alias("difference"))
    alone = (
        flat.groupBy("leader", "difference").agg(F.count(F.lit(1)).alias("size"), F.first("node").alias("node"))
        .where("size = 1").groupBy("leader", "node").agg(F.count(F.lit(1)).alias("alone"))
    )
    return compared.join(alone, ["leader", "node"], "left").select(
        F.col("leader").alias("bucket"), "node", "n", (F.col("n") / 9 - F.coalesce("alone", F.lit(0))).alias("room")
    )


def _ranked(sized: DataFrame, lead: int, biggest: int) -> DataFrame:
    """Adds ``rank``, the place by room within the group, to the ``lead`` first of each; the rest has none.

    ``biggest`` is the size of the largest group. No task ranks more than
    ``RANKED`` texts, or ``FUNNEL`` times the leaders if those are more.
    """
    order = [F.desc("room"), "node"]
    if biggest <= RANKED:
        ranked = first_rows(sized, ["bucket"], order, None)
        return ranked.withColumn("rank", F.when(F.col("rank") <= lead, F.col("rank").cast("long")))
    rows, divisor = sized.select("bucket", "node", "room", "size"), FUNNEL * lead
    while biggest > divisor:
        salted = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / divisor)))
        rows = first_rows(salted, ["bucket", "part"], order, lead).drop("part", "rank")
        divisor *= FUNNEL
    first = first_rows(rows, ["bucket"], order, lead).select("bucket", "node", F.col("rank").cast("long").alias("rank"))
    return sized.join(first, ["bucket", "node"], "left")


def classes_of_texts(docs: DataFrame, sketched: DataFrame, store: Stored) -> DataFrame:
    """``node`` and ``label`` of every text that is linked to another."""
    texts = sketched.where("n > 0").groupBy("key").agg(F.first("bands").alias("bands"))
    member = texts.select(F.posexplode("bands").alias("band", "value"), "key").select(
        F.xxhash64("band", "value").alias("bucket"), F.col("key").alias("node")
    )
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = store.table(member.join(sizes, "bucket"), "buckets")
    company = member.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = member.join(company, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("company", "node"))["node"].alias("leader"))
    pairs = store.table(member.join(leaders, "bucket").where("node <> leader").select("leader", "node").distinct(), "pairs")
    involved = pairs.select(F.explode(F.array("leader", "node")).alias("key")).distinct().withColumn("tag", _tag("key"))
    bits = bitmap(involved, "tag", BITS)
    sequences = store.table(
        _keyed(docs).withColumn("tag", _tag("key")).mapInArrow(_sequence_rows(bits), "key binary, seq binary").dropDuplicates(["key"]),
        "sequences",
    )
    compared = _compared(pairs, sequences, store)
    edges = compared.where(F.col("similarity") >= SIMILARITY).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    group = store.table(_room(compared), "room")
    lead = LEADERS
    labels = components(edges, store)
    while True:
        most = group.groupBy("bucket").agg(F.max("room").alias("most"))
        able = lookup_join(group, most, ["bucket"], "inner", HOT_ROWS).where("room + most >= -1e-9").drop("most")
        able = able.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        able = store.table(able, "able")
        live = (
            able.groupBy("bucket").agg(
                F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")
            )
            .where("low <> high")
            .select("bucket", "size", "total", F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("total") * 8 / CHUNK_BYTES)).alias("chunks"))
        )
        live = store.table(live, "live")
        biggest = live.agg(F.max("size").alias("size"), F.max("total").alias("total")).first()
        if biggest["size"] is None:
            return labels
        sized = lookup_join(able, live.drop("total"), ["bucket"], "inner", HOT_ROWS)
        if biggest["size"] > RANKED:
            sized = store.table(sized, "sized")
        ranked = _ranked(sized, lead, biggest["size"]).withColumn("rank", F.coalesce("rank", F.lit(2**62)))
        group = store.table(ranked.join(sequences.withColumnRenamed("key", "node"), "node"), "group")
        halls = group.where(F.col("rank") <= lead).groupBy("bucket").agg(F.ceil(F.sum("n") * 8 / CHUNK_BYTES).alias("halls"))
        # Where no group is longer than a chunk of bytes, neither are its leaders.
        if biggest["total"] * 8 <= CHUNK_BYTES:
            group = group.withColumn("halls", F.lit(1).cast("long"))
        else:
            group = store.table(lookup_join(group, store.table(halls, "halls"), ["bucket"], "inner", HOT_ROWS), "group")
        chunk, hall = F.pmod(F.xxhash64("node"), "chunks"), F.pmod(F.xxhash64("node"), "halls")

        def all_of(count: str):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

        members = group.withColumn("chunk", chunk).withColumn("hall", all_of("halls"))
        leaders = group.where(F.col("rank") <= lead).withColumn("hall", hall).withColumn("chunk", all_of("chunks"))
        keys = ["bucket", "chunk", "hall"]
        met = members.groupBy(*keys).cogroup(leaders.groupBy(*keys)).applyInPandas(_meet, "a binary, b binary")
        met = store.table(met, "met")
        if not met.isEmpty():
            # Links are between classes from here on: the labels are joined, and every text follows its label.
            name = labels.select("node", "label")
            a, b = name.select(F.col("node").alias("a"), F.col("label").alias("x")), name.select(F.col("node").alias("b"), F.col("label").alias("y"))
            joined = met.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
            merged = components(joined, store)
            up = merged.select(F.col("node").alias("label"), F.col("label").alias("_top"))
            labels = name.join(up, "label", "left").select("node", F.coalesce("_top", "label").alias("label"))
            alone = merged.join(name, "node", "left_anti")
            labels = store.table(labels.unionByName(alone), "labels")
        group = group.where(F.col("rank") > lead).select("bucket", "node", "n", "room")
        lead = min(4 * lead, MOST_LEADERS)


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id``, ``class_id`` (least id of its class), ``key`` and ``label``."""
    store = Stored(docs.sparkSession)
    sketched = store.table(_keyed(docs).mapInArrow(_sketch_rows, _SKETCHED), "sketches")
    found = classes_of_texts(docs, sketched, store)
    member = sketched.select("key", "doc_id").join(found.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "doc_id", F.coalesce("label", "key").alias("label")
    )
    named = member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return member.join(named, "label")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one of each class."""
    member = near_classes(docs)
    named = F.col("doc_id").eqNullSafe(F.col("class_id"))
    first = member.where(named).groupBy("label").agg(F.min("key").alias("first"))
    winner = (
        member.where(named).join(first, "label").where("key = first")
        .groupBy("key", F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    )
    winner = Stored(docs.sparkSession).table(winner, "winners")
    # The rows travel in one column, so that no name of theirs meets one of ours.
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(text)).alias("own_key"),
        F.col("doc_id").cast("long").alias("own_id"),
    )
    kept = keyed.join(winner, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("id")))
    if not winner.where("rows > 1").isEmpty():
        kept = kept.where("rows = 1").unionByName(kept.where("rows > 1").dropDuplicates(["own_key"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
