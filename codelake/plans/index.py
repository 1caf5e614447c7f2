"""From files to the relations of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.columns import file_id
from codelake.functions.parsing import parsed
from codelake.functions.storage import stored
from codelake.operators import cs_syntax, py_syntax
from codelake.operators.extract_py import inline_hints, inline_imports, inline_nodes
from codelake.operators.inventory import detect_language, eligibility
from codelake.operators.manifests import brace_surplus, diagnostics_of
from codelake.operators.resolve import resolve_by_indexes
from codelake.operators.symbols import name_index, project_symbols, qualified_index, symbol_occurrences

# language -> syntax (see ``functions.parsing``). Add a language here.
PARSERS: dict[str, type] = {
    "python": py_syntax.Source,
    "csharp": cs_syntax.Source,
}


def inventory(files: DataFrame) -> DataFrame:
    """File records without content; ineligible files stay with their status."""
    rows = detect_language(files)
    if "is_binary" not in rows.columns:
        rows = rows.withColumn("is_binary", F.lit(False))
    if "size_bytes" not in rows.columns:
        rows = rows.withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    if "encoding" not in rows.columns:
        rows = rows.withColumn("encoding", F.lit("utf-8"))
    status = eligibility()
    # A file that was not read changes when its size or time does.
    seen = ["size_bytes", *(c for c in ("modified_at",) if c in rows.columns)]
    unread = F.sha2(F.concat_ws("|", F.lit("unread"), *[F.col(c).cast("string") for c in seen]), 256)
    parsed = F.col("language").isin(list(PARSERS))
    return rows.withColumn("eligibility", status).select(
        "root", "path", file_id().alias("file_id"), "language",
        F.coalesce(F.sha2(F.col("content").cast("binary"), 256), unread).alias("content_hash"),
        "size_bytes", "encoding", "eligibility",
        F.when((F.col("eligibility") != "Eligible") | ~parsed, "Skipped")
        .when(F.col("content").isNull(), "Failed")
        .otherwise("Success")
        .alias("parse_status"),
        "content",
    )


def content_pass(known: DataFrame) -> DataFrame:
    """The file records with all that their content tells: one scan, whatever the number of languages.

    Adds ``unread``, ``surplus`` (of braces) and the nodes, imports and hints of
    eligible files, each read by the syntax of its language; the content goes.
    """
    text, language = F.col("content"), F.col("language")
    readable = (F.col("eligibility") == "Eligible") & text.isNotNull()
    records = [c for c in known.columns if c not in ("root", "path", "file_id", "content", "language")]
    rows = known.select(
        "root", "path", file_id().alias("file_id"), "language", *records,
        text.isNull().alias("unread"),
        F.when(language == "csharp", brace_surplus(text)).alias("surplus"),
        F.when(readable & language.isin(list(PARSERS)), text).alias("content"),
    )
    return parsed(rows, PARSERS)


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """Nodes, imports and hints as relations of their own."""
    return {
        "nodes": inline_nodes(parsed),
        "imports": inline_imports(parsed),
        "hints": inline_hints(parsed),
    }


def link(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds symbols, occurrences and edges to nodes, imports and hints.

    Symbols are written once, and so is their index by qualified name: three
    joins of the resolution read it.
    """
    symbols = stored(project_symbols(tables["nodes"]), "symbols")
    qualified = stored(qualified_index(symbols), "qualified")
    uses = name_uses(tables["hints"])
    # REBALANCE splits the bucket of a name that much of the corpus uses. The file id follows from root and path.
    short = uses.drop("file_id").hint("rebalance", "bucket")
    return {
        **tables,
        "symbols": symbols,
        "occurrences": symbol_occurrences(tables["nodes"]),
        "edges": resolve_by_indexes(tables["hints"], qualified, name_index(symbols), tables["imports"]),
        "uses": stored(short, "uses", ["bucket"]).withColumn("file_id", file_id()).select(*uses.columns),
    }


USE_BUCKETS = 64


def _use_bucket() -> Column:
    return F.pmod(F.xxhash64("root", "name_key"), F.lit(USE_BUCKETS)).cast("int").alias("bucket")


def name_uses(hints: DataFrame) -> DataFrame:
    """The reverse index: which hints use a name (no case), as their source or as their target."""
    keys = F.array_distinct(F.array(F.lower("source_path"), F.lower("target_name")))
    rows = hints.select("root", "path", "file_id", "hint_no", F.explode(keys).alias("name_key")).filter(F.col("name_key").isNotNull())
    return rows.withColumn("bucket", _use_bucket())


def read_uses(uses: DataFrame, keys: DataFrame) -> DataFrame:
    """Uses of ``keys(root, name_key)``; of a stored index only the buckets of these keys are read."""
    buckets = [r[0] for r in keys.select(_use_bucket()).distinct().collect()]
    return uses.filter(F.col("bucket").isin(buckets)).join(keys, ["root", "name_key"], "left_semi")


def file_tables(read: DataFrame) -> dict[str, DataFrame]:
    """File records and diagnostics of a ``content_pass``."""
    tried = read.filter(F.col("parse_status").isin("Success", "Failed"))
    records = read.drop("unread", "surplus", "nodes", "imports", "hints")
    return {
        "files": with_parse_status(records, diagnostics_of(read.select("root", "path", "file_id", "unread", "surplus"))),
        "diagnostics": diagnostics_of(tried.select("root", "path", "file_id", "unread", "surplus")),
    }


def build_index(files: DataFrame) -> dict[str, DataFrame]:
    """``files(root, path, content)`` of any number of repositories -> all relations.

    The content is read once; what it tells is written to the shared folder,
    and everything after works on that.
    """
    read = stored(content_pass(inventory(files)), "parsed")
    return {**link(relations(read)), **file_tables(read)}


def with_parse_status(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """A parsed file with a diagnostic is partial."""
    partial = (
        diagnostics.filter(F.col("severity") == "Warning")
        .select("root", "path", F.lit(True).alias("_p"))
        .distinct()
    )
    return (
        files.join(partial, ["root", "path"], "left")
        .withColumn(
            "parse_status",
            F.when((F.col("parse_status") == "Success") & F.col("_p"), "Partial").otherwise(
                F.col("parse_status")
            ),
        )
        .drop("_p")
    )


COUNTED = {
    "file_count": "files", "node_count": "nodes", "symbol_count": "symbols",
    "occurrence_count": "occurrences", "reference_count": "edges",
    "import_count": "imports", "diagnostic_count": "diagnostics",
}


def language_breakdown(files: DataFrame) -> DataFrame:
    """Parsed files per language."""
    return (
        files.filter(F.col("parse_status").isin("Success", "Partial", "Failed"))
        .groupBy("root", "language")
        .agg(F.count(F.lit(1)).alias("file_count"))
    )


def snapshot_metadata(tables: dict[str, DataFrame], roots: DataFrame | None = None) -> DataFrame:
    """The seven counts of each root, with its language breakdown.

    ``roots(root)`` names roots that get a row of zeros if they have no files.

    The relations are counted apart and the per-root counts are stacked and
    added up, which needs one small shuffle and no join.
    """
    stacked = None
    for column, name in COUNTED.items():
        counts = tables[name].groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        row = counts.select("root", F.lit(column).alias("c"), "n")
        stacked = row if stacked is None else stacked.unionByName(row)
    if roots is not None:
        empty = roots.select("root", F.lit("").alias("c"), F.lit(0).cast("bigint").alias("n"))
        stacked = stacked.unionByName(empty)
    totals = stacked.groupBy("root").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0)).alias(c)
            for c in COUNTED
        ]
    )
    breakdown = language_breakdown(tables["files"]).groupBy("root").agg(
        # At most one entry per known language.
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "file_count")))).alias(
            "language_breakdown"
        )
    )
    return totals.join(breakdown, "root", "left")


def build_result(files: DataFrame) -> DataFrame:
    """Scanned, eligible, indexed, skipped, failed and overall status per root."""
    eligible = F.col("eligibility") == "Eligible"
    status = F.col("parse_status")
    counts = files.groupBy("root").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(eligible).alias("files_eligible"),
        F.count_if(eligible & status.isin("Success", "Partial")).alias("files_indexed"),
        F.count_if(eligible & (status == "Skipped")).alias("files_skipped"),
        F.count_if(eligible & (status == "Failed")).alias("files_failed"),
    )
    failed, indexed = F.col("files_failed") > 0, F.col("files_indexed")
    return counts.withColumn(
        "status",
        F.when(failed & (indexed == 0), "failed").when(failed, "partial").otherwise("success"),
    )
