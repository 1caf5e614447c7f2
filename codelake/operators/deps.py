"""References, dependencies and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.columns import path_key
from codelake.functions.skew import HOT_ROWS, first_rows, lookup_join, request_join
from codelake.operators.resolve import is_hard, resolution_method


def _kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    return edges.filter(F.col("kind").isin(kinds)) if kinds else edges


def _edge_view(edges: DataFrame) -> DataFrame:
    """A reference without target is labelled ambiguous whatever its class."""
    return edges.withColumn(
        "method",
        F.when(F.col("target_symbol_id").isNull(), "ambiguous").otherwise(resolution_method()),
    )


def _known(edges: DataFrame, symbols: DataFrame, column: str, hot_rows: int) -> DataFrame:
    ids = symbols.select("root", F.col("symbol_id").alias(column))
    return lookup_join(
        edges, ids, ["root", column], "inner", hot_rows, F.xxhash64("edge_id")
    ).withColumn("symbol_id", F.col(column))


def references_out(
    edges: DataFrame, symbols: DataFrame, kinds: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Outgoing edges of every symbol, keyed by ``symbol_id``."""
    found = _known(
        _kinds(edges, kinds).filter(F.col("source_symbol_id").isNotNull()),
        symbols, "source_symbol_id", hot_rows,
    )
    return _edge_view(found)


def references_in(
    edges: DataFrame, symbols: DataFrame, kinds: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Incoming edges of every symbol, keyed by ``symbol_id``."""
    found = _known(
        _kinds(edges, kinds).filter(F.col("target_symbol_id").isNotNull()),
        symbols, "target_symbol_id", hot_rows,
    )
    return _edge_view(found)


def union_references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Outgoing then incoming edges of each symbol as one relation."""
    out = references_out(edges, symbols).withColumn("direction", F.lit("out"))
    return out.unionByName(references_in(edges, symbols).withColumn("direction", F.lit("in")))


def page_references(
    edges: DataFrame, symbols: DataFrame, page: int = 1, size: int = fv.DEFAULT_PAGE_SIZE
) -> DataFrame:
    """One page of the outgoing edges of each symbol; incoming edges stay whole."""
    page = max(1, page)
    ranked = first_rows(
        references_out(edges, symbols), ["root", "symbol_id"],
        ["path", "hint_no"], page * size, "_rank",
    )
    out = ranked.filter(F.col("_rank") > (page - 1) * size).drop("_rank")
    return out.withColumn("direction", F.lit("out")).unionByName(
        references_in(edges, symbols).withColumn("direction", F.lit("in"))
    )


def file_references(edges: DataFrame, symbols: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges keyed by the primary file of their source symbol."""
    owner = symbols.select(
        "root", F.col("symbol_id").alias("source_symbol_id"),
        F.col("primary_file_id").alias("source_file_id"),
        F.col("primary_path").alias("source_path"),
    )
    found = lookup_join(
        edges.filter(F.col("source_symbol_id").isNotNull()), owner,
        ["root", "source_symbol_id"], "inner", hot_rows, F.xxhash64("edge_id"),
    )
    return _edge_view(found)


def file_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``files(root, path)`` requested, any case and slash, with their imports."""
    wanted = files.select("root", path_key().alias("_key"), F.col("path").alias("requested_path"))
    found = imports.withColumn("_key", path_key())
    return wanted.join(found, ["root", "_key"]).drop("_key")


def _other_end(symbols: DataFrame, column: str) -> DataFrame:
    return symbols.select(
        "root", F.col("symbol_id").alias(column),
        F.col("qualified_name"), F.col("kind").alias("symbol_kind"),
        F.col("language").alias("symbol_language"),
    )


def dependencies(
    edges: DataFrame, symbols: DataFrame, hard_only: bool = True,
    kinds: list[str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What each symbol depends on."""
    chosen = _kinds(edges.filter(is_hard()) if hard_only else edges, kinds)
    out = _known(
        chosen.filter(F.col("source_symbol_id").isNotNull()), symbols,
        "source_symbol_id", hot_rows,
    )
    return lookup_join(
        out, _other_end(symbols, "target_symbol_id"), ["root", "target_symbol_id"],
        hot_rows=hot_rows, spread=F.xxhash64("edge_id"), counted=edges,
    ).withColumn("method", resolution_method())


def dependents(
    edges: DataFrame, symbols: DataFrame, hard_only: bool = True,
    kinds: list[str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What depends on each symbol."""
    chosen = _kinds(edges.filter(is_hard()) if hard_only else edges, kinds)
    into = _known(
        chosen.filter(F.col("target_symbol_id").isNotNull()), symbols,
        "target_symbol_id", hot_rows,
    )
    return lookup_join(
        into, _other_end(symbols, "source_symbol_id"), ["root", "source_symbol_id"],
        hot_rows=hot_rows, spread=F.xxhash64("edge_id"), counted=edges,
    ).withColumn("method", resolution_method())


def _file_pairs(
    edges: DataFrame, symbols: DataFrame, hard_only: bool, hot_rows: int
) -> DataFrame:
    chosen = edges.filter(is_hard()) if hard_only else edges
    sourced = file_references(
        chosen.filter(F.col("target_symbol_id").isNotNull()), symbols, hot_rows
    )
    targets = symbols.select(
        "root", F.col("symbol_id").alias("target_symbol_id"),
        F.col("primary_file_id").alias("target_file_id"),
        F.col("primary_path").alias("target_path"),
    )
    return lookup_join(
        sourced, targets, ["root", "target_symbol_id"], "inner", hot_rows,
        F.xxhash64("edge_id"), counted=edges,
    ).filter(F.col("source_file_id") != F.col("target_file_id"))


def file_dependencies(
    edges: DataFrame, symbols: DataFrame, hard_only: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Edges rolled up per (source file, target file).

    Counts and kinds combine before the shuffle (there are 21 kinds at most);
    the examples are the first three edges of a pair, cut before the shuffle.
    """
    pairs = _file_pairs(edges, symbols, hard_only, hot_rows)
    keys = ["root", "source_path", "target_path"]
    totals = pairs.groupBy(*keys).agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.count(F.lit(1)).alias("evidence_count"),
    )
    heads = first_rows(
        pairs.select(
            *keys, "path", "hint_no",
            F.struct(
                "source_symbol_id", "target_symbol_id", "kind", "evidence"
            ).alias("example"),
        ),
        keys, ["path", "hint_no"], fv.FILE_EDGE_EXAMPLES,
    )
    examples = heads.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("_ranked")
    )
    return (
        totals.join(examples, keys)
        .withColumn("examples", F.transform("_ranked", lambda x: x["example"]))
        .drop("_ranked")
    )


def distinct_kinds(edges: DataFrame) -> DataFrame:
    """Distinct relationship kinds without regard to case, sorted."""
    return (
        edges.groupBy("root", F.lower("kind").alias("_key"))
        .agg(F.min("kind").alias("kind"))
        .orderBy("root", "_key")
        .drop("_key")
    )


def file_graph(file_deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the file dependency graph."""
    edges = file_deps.select(
        "root", F.col("source_path").alias("from_path"), F.col("target_path").alias("to_path"),
        F.array_join("kinds", ", ").alias("kind"),
    )
    nodes = (
        edges.select("root", F.explode(F.array("from_path", "to_path")).alias("path"))
        .distinct()
        .withColumn("kind", F.lit("file"))
    )
    return nodes, edges




def symbol_relationships(
    symbols: DataFrame, edges: DataFrame, limit: int | None = None
) -> DataFrame:
    """Children, references, dependencies and dependents with a section column."""
    children = symbols.filter(F.col("parent_symbol_id").isNotNull()).select(
        "root", F.col("parent_symbol_id").alias("symbol_id"),
        F.lit("children").alias("section"), F.col("symbol_id").alias("other_symbol_id"),
        F.col("kind").alias("rel_kind"),
        F.struct(
            F.lit(0).alias("part"), F.lower("name").alias("text"), F.lit(0).alias("number"),
            F.col("symbol_id").alias("tie"),
        ).alias("position"),
    )

    def edge_section(df, name, other, part=0):
        return df.select(
            "root", "symbol_id", F.lit(name).alias("section"),
            F.col(other).alias("other_symbol_id"), F.col("kind").alias("rel_kind"),
            F.struct(
                F.lit(part).alias("part"), F.col("path").alias("text"),
                F.col("hint_no").alias("number"), F.col("edge_id").alias("tie"),
            ).alias("position"),
        )

    rows = (
        children.unionByName(
            edge_section(references_out(edges, symbols), "references", "target_symbol_id")
        )
        .unionByName(
            edge_section(references_in(edges, symbols), "references", "source_symbol_id", 1)
        )
        .unionByName(
            edge_section(dependencies(edges, symbols), "dependencies", "target_symbol_id")
        )
        .unionByName(edge_section(dependents(edges, symbols), "dependents", "source_symbol_id"))
    )
    return section_limit(rows, limit) if limit else rows


def section_limit(rows: DataFrame, n: int = fv.SUMMARY_SECTION_ROWS) -> DataFrame:
    """First ``n`` rows of each section of each symbol."""
    return first_rows(rows, ["root", "symbol_id", "section"], ["position"], n)


def call_graph(
    symbols: DataFrame, edges: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each centre of ``ids(root, symbol_id)``."""
    centres = ids.select("root", "symbol_id").distinct()
    members = symbols.filter(F.col("parent_symbol_id").isNotNull()).select(
        "root", F.col("parent_symbol_id").alias("symbol_id"),
        F.col("symbol_id").alias("node_symbol_id"), "name", "kind",
    )
    # Keys of stored relations are cheap to count, so only hot ones are salted.
    nodes = request_join(members, centres, ["root", "symbol_id"], counted=members)
    both = edges.select(
        "root", "edge_id",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("source_symbol_id").alias("symbol_id"), F.lit("out").alias("d")),
                    F.struct(F.col("target_symbol_id").alias("symbol_id"), F.lit("in").alias("d")),
                ),
                lambda x: x["symbol_id"].isNotNull(),
            )
        ).alias("end"),
        F.coalesce("source_symbol_id", F.lit("")).alias("from_symbol_id"),
        F.coalesce("target_symbol_id", F.lit("")).alias("to_symbol_id"),
    ).select("root", "edge_id", "end.symbol_id", F.col("end.d").alias("direction"),
             "from_symbol_id", "to_symbol_id")
    graph_edges = request_join(both, centres, ["root", "symbol_id"], F.xxhash64("edge_id", "direction"), counted=both)
    return nodes, graph_edges
