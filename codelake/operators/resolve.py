"""Reference hints to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.columns import lookup
from codelake.functions.skew import HOT_ROWS, lookup_join
from codelake.functions.storage import stored
from codelake.operators.symbols import name_index, qualified_index


def external_types(hints: DataFrame) -> DataFrame:
    """Hints whose target is a well-known library type (a folded literal set)."""
    return hints.filter(_is_external())


def _is_external() -> Column:
    return F.lower("target_name").isin(sorted({t.lower() for t in fv.EXTERNAL_TYPES}))


def resolve_sources(
    hints: DataFrame, symbols: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds the source symbol, found by its qualified name without case."""
    return _sourced(hints, qualified_index(symbols), hot_rows)


def _sourced(hints: DataFrame, qualified: DataFrame, hot_rows: int) -> DataFrame:
    sources = qualified.select(
        "root",
        F.col("qualified_key").alias("source_key"),
        F.col("symbol_id").alias("source_symbol_id"),
    )
    keyed = hints.withColumn("source_key", F.lower("source_path"))
    joined = lookup_join(
        keyed, sources, ["root", "source_key"], hot_rows=hot_rows,
        spread=F.xxhash64("file_id", "hint_no"),
    )
    return joined.withColumn(
        "base_confidence",
        F.when(
            F.col("source_symbol_id").isNotNull(), fv.CONFIDENCE_UNKNOWN_WITH_SOURCE
        ).otherwise(fv.CONFIDENCE_UNKNOWN),
    ).drop("source_key")


def _targets(qualified: DataFrame, names: DataFrame) -> DataFrame:
    """One row per key: what it means as qualified name and as simple name."""
    by_qualified = qualified.select(
        "root", F.col("qualified_key").alias("target_key"),
        F.col("symbol_id").alias("exact_id"),
        F.lit(None).cast("bigint").alias("candidate_count"),
        F.lit(None).cast("string").alias("only_id"),
    )
    by_name = names.select(
        "root", F.col("name_key").alias("target_key"),
        F.lit(None).cast("string").alias("exact_id"),
        "candidate_count",
        F.col("only_symbol_id").alias("only_id"),
    )
    return (
        by_qualified.unionByName(by_name)
        .groupBy("root", "target_key")
        .agg(
            F.max("exact_id").alias("exact_id"),
            F.max("candidate_count").alias("candidate_count"),
            F.max("only_id").alias("only_id"),
        )
    )


def resolve_via_imports(
    wanted: DataFrame, imports: DataFrame, symbols: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``wanted(root, file_id, target_key)`` -> the one symbol its imports lead to.

    Works on distinct (file, name) pairs. A pair is dropped when its imports
    lead to none or to several symbols.
    """
    return _imported(wanted, imports, qualified_index(symbols), hot_rows)


def _imported(wanted: DataFrame, imports: DataFrame, qualified: DataFrame, hot_rows: int) -> DataFrame:
    plain = (
        imports.filter(F.col("kind").isin(fv.PLAIN_IMPORT_KINDS) & (F.col("target") != ""))
        .select("root", "file_id", F.lower("target").alias("import_key"))
        .distinct()
    )
    candidates = wanted.join(plain, ["root", "file_id"]).withColumn(
        "qualified_key", F.concat_ws(".", "import_key", "target_key")
    )
    found = lookup_join(
        candidates, qualified, ["root", "qualified_key"], "inner",
        hot_rows=hot_rows, spread=F.xxhash64("file_id"),
    )
    return (
        found.groupBy("root", "file_id", "target_key")
        .agg(F.min("symbol_id").alias("import_id"), F.max("symbol_id").alias("_last"))
        .filter(F.col("import_id") == F.col("_last"))
        .drop("_last")
    )


def resolve_references(
    hints: DataFrame, symbols: DataFrame, imports: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Hints to edges, by the ladder exact, unique name, import, ambiguous, external.

    Every join is many-to-one against an aggregated index, so a common name
    cannot multiply rows; frequent names are salted.
    """
    return resolve_by_indexes(hints, qualified_index(symbols), name_index(symbols), imports, hot_rows)


def resolve_by_indexes(
    hints: DataFrame, qualified: DataFrame, names: DataFrame, imports: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``resolve_references`` by ``qualified_index`` and ``name_index``, or those entries of them that the hints can meet."""
    sourced = _sourced(hints, qualified, hot_rows).withColumn(
        "target_key", F.lower("target_name")
    )
    pair = ["root", "file_id", "target_key"]
    # Written once: the settled rows, the undecided rows and their distinct
    # pairs would each run both joins again.
    targeted = stored(
        lookup_join(
            sourced, _targets(qualified, names), ["root", "target_key"], hot_rows=hot_rows,
            spread=F.xxhash64("file_id", "hint_no"),
            counted=hints.select("root", F.lower("target_name").alias("target_key")),
        ),
        "targeted",
    )
    settled = F.col("exact_id").isNotNull() | F.col("only_id").isNotNull()
    # Only what the two indexes leave open meets the imports of its file.
    undecided = targeted.filter(~settled)
    imported = _imported(undecided.select(*pair).distinct(), imports, qualified, hot_rows)
    rows = (
        targeted.filter(settled)
        .withColumn("import_id", F.lit(None).cast("string"))
        .unionByName(undecided.join(imported, pair, "left"))
    )
    resolution = (
        F.when(F.col("exact_id").isNotNull(), "ExactBound")
        .when(F.col("only_id").isNotNull(), "ScopedBound")
        .when(F.col("import_id").isNotNull(), "ImportBound")
        .when(F.col("candidate_count") > 1, "Ambiguous")
        .when(_is_external(), "External")
        .otherwise("Unknown")
    )
    confidence = F.coalesce(
        *[
            F.when(F.col("resolution") == name, F.lit(value))
            for name, value in fv.CONFIDENCE.items()
        ],
        F.col("base_confidence"),
    )
    return (
        rows.withColumn("resolution", resolution)
        .withColumn("confidence", confidence)
        .select(
            "root",
            F.concat_ws("-", F.lit("ref"), "file_id", F.col("hint_no").cast("string")).alias("edge_id"),
            "path",
            "file_id",
            "hint_no",
            "source_symbol_id",
            F.coalesce("exact_id", "only_id", "import_id").alias("target_symbol_id"),
            "kind",
            "resolution",
            F.coalesce("evidence", "target_name").alias("evidence"),
            "language",
            "span",
            "confidence",
        )
    )


def resolution_method(resolution="resolution") -> Column:
    """Label shown next to a resolution class."""
    return lookup(F.col(resolution), fv.RESOLUTION_METHOD, fv.RESOLUTION_METHOD_DEFAULT)


def is_hard(resolution="resolution") -> Column:
    return F.col(resolution).isin(fv.HARD_CLASSES)
