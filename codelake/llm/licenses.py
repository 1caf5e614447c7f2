"""License scan by diagonal voting.

Every word k-gram of every text meets the k-grams of license templates in a
Spark join. A match votes for the diagonal (text position minus template
position). Votes on one diagonal, and on neighbouring diagonals that follow one
another in the text, form a span; a span holds if it is not too long, the words
of its matched k-grams are enough of the template's, and each name that the
template has, such as ``version 3``, stands word by word on one diagonal. So any
one word but those of a name may differ.

Nulls and texts without words give no span and score 0. Repeated rows are
treated each on its own. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm.spread import plain
from codelake.llm.text import Block, bitmap_test, blocks, word_list

# Phrases that must stand word by word, and their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# License notices that may be altered in a few words, but for the names in the third place.
_AS_PUBLISHED = "under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
NOTICES = [
    ("agpl-3.0", _AS_PUBLISHED.format("affero general", "3"), ("gnu affero general", "version 3 of")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ()),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("by nc",)),
    ("cc-by-sa", "licensed under a creative commons attribution share alike license", ("attribution share alike",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ()),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("license version 2",)),
    ("gpl-2.0", _AS_PUBLISHED.format("general", "2"), ("gnu general public", "version 2 of")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("license version 3",)),
    ("gpl-3.0", _AS_PUBLISHED.format("general", "3"), ("gnu general public", "version 3 of")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ()),
    ("lgpl-2.1", _AS_PUBLISHED.format("lesser general", "2 1"), ("gnu lesser general", "version 2 1")),
    ("lgpl-3.0", _AS_PUBLISHED.format("lesser general", "3"), ("gnu lesser general", "version 3 of")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ()),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    ("public-domain", "this work has been released into the public domain", ("the public domain",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ()),
]

LONGEST_GRAM = 3
#: Notices of fewer words have grams of two words, so that one word in the middle does not break most of them.
LONG_NOTICE = 9
COVERAGE = 0.6

_HITS = "_rid long, doc_id long, n_words long, pos long, gram string"


class Templates:
    """Templates and the positions of their grams."""

    def __init__(self, base=BASE, notices=NOTICES) -> None:
        self.rows = []  # template, label, exact, words, gram length, positions of the grams of each name
        self.grams = []  # gram, template, position
        for exact, entries in ((True, base), (False, notices)):
            for label, phrase, *names in entries:
                words = word_list(phrase)
                longest = LONGEST_GRAM if exact or len(words) >= LONG_NOTICE else LONGEST_GRAM - 1
                k, t = min(longest, len(words)), len(self.rows)
                runs = [self._positions(words, word_list(name), k) for name in (names[0] if names else ())]
                self.rows.append((t, label, exact, len(words), k, runs))
                self.grams += [(" ".join(words[i : i + k]), t, i) for i in range(len(words) - k + 1)]
        if len(self.grams) > 1_000_000:
            raise ValueError("more than a million template grams: too many to broadcast")

    @staticmethod
    def _positions(words: list[str], name: list[str], k: int) -> list[int]:
        """Positions of the grams that make up a name."""
        begin = [i for i in range(len(words) - len(name) + 1) if words[i : i + len(name)] == name]
        if not begin or len(name) < k:
            raise ValueError(f"a name needs {k} words of its notice: {' '.join(name)}")
        return list(range(begin[0], begin[0] + len(name) - k + 1))


def _gram_hash(words: list[str]) -> int:
    """The hash that ``Words.grams`` gives the same words."""
    data = " ".join(words).encode()
    found = Block(None, np.frombuffer(data, np.uint8), np.array([0, len(data)])).words()
    return int(found.grams(found.hashes(), len(words))[1][0])


def _hits(templates: Templates):
    lengths = sorted({len(g.split(" ")) for g, _, _ in templates.grams})
    bits = {}
    for k in lengths:
        have = np.zeros(1 << 14, np.uint64)
        for g, _, _ in templates.grams:
            if len(words := g.split(" ")) == k:
                slot = _gram_hash(words) & ((1 << 20) - 1)
                have[slot >> 6] |= np.uint64(1 << (slot & 63))
        bits[k] = have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                words = block.words()
                hashes = words.hashes()
                row, pos, gram = [np.arange(len(block))], [np.full(len(block), -1)], [None] * len(block)
                for k in lengths:
                    at, value = words.grams(hashes, k)
                    at = at[bitmap_test(bits[k], value)]  # no template gram is lost here; the join decides
                    row.append(words.row[at])
                    pos.append(words.position[at])
                    gram += [" ".join(words.texts(i, i + k)) for i in at]
                row, pos = np.concatenate(row), np.concatenate(pos)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.rows.column("_rid").take(pa.array(row)),
                        block.rows.column("doc_id").take(pa.array(row)),
                        pa.array(words.counts[row], pa.int64()),
                        pa.array(pos, pa.int64()),
                        pa.array(gram, pa.string()),
                    ],
                    names=["_rid", "doc_id", "n_words", "pos", "gram"],
                )

    return run


def spans(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """Verified license spans of every text.

    Columns ``_rid`` (the row), ``doc_id``, ``n_words``, ``label``, ``exact``,
    ``start`` and ``stop`` (words), ``coverage``. A row without a span comes
    once, with null in the last five.
    """
    templates = templates or Templates()
    spark = docs.sparkSession
    keyed = plain(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    hits = keyed.mapInArrow(_hits(templates), _HITS)
    grams = spark.createDataFrame(templates.grams, "gram string, template int, at int")
    known = spark.createDataFrame(templates.rows, "template int, label string, exact boolean, m int, k int, names array<array<int>>")
    votes = hits.join(F.broadcast(grams.join(F.broadcast(known), "template")), "gram", "left").where("template is not null or pos < 0")
    diagonal = votes.groupBy("_rid", "doc_id", "n_words", "template", "label", "exact", "m", "k", "names", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max(F.col("pos") + F.col("k")).alias("high")
    ).withColumn("said", F.filter("names", lambda name: F.size(F.array_except(name, F.col("ats"))) == 0))
    follow = Window.partitionBy("_rid", "template").orderBy("low", "diagonal")
    slack = F.greatest(F.lit(2), (F.col("m") / 4).cast("int"))
    fresh = (
        F.coalesce(F.col("exact"), F.lit(True))
        | F.lag("diagonal").over(follow).isNull()
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(follow)) > slack)
        | (F.col("low") - F.lag("high").over(follow) > F.col("m"))
    )
    covered = F.flatten(F.transform("ats", lambda at: F.sequence(at, at + F.col("k") - 1)))
    merged = (
        diagonal.withColumn("_fresh", fresh.cast("int"))
        .withColumn("_group", F.sum("_fresh").over(follow.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("_rid", "doc_id", "n_words", "template", "label", "exact", "m", "k", "names", "_group")
        .agg(
            F.flatten(F.collect_list("ats")).alias("ats"), F.flatten(F.collect_list("said")).alias("said"),
            F.min("low").alias("start"), F.max("high").alias("stop"),
        )
        .withColumn("coverage", F.size(F.array_distinct(covered)) / F.col("m"))
    )
    holds = F.when(F.col("exact"), F.col("coverage") == 1.0).otherwise(
        (F.col("coverage") >= COVERAGE) & (F.size(F.array_except("names", "said")) == 0) & (F.col("stop") - F.col("start") <= F.col("m") * 1.5 + 1)
    )
    kept = F.coalesce(holds, F.lit(False))
    return merged.select(
        "_rid", "doc_id", "n_words",
        *[F.when(kept, F.col(c)).alias(c) for c in ("label", "exact", "start", "stop", "coverage")],
    )


def license_report(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """One row per document: counts of exact places, labels and the best coverage."""
    found = spans(docs, templates)
    base = F.col("exact")

    def joined(labels):
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")

    return found.groupBy("_rid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).cast("double").alias("score"),
        F.count(F.when(~base, 1)).alias("n_notices"),
    ).drop("_rid")
