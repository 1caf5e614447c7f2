"""Nodes to logical symbols and occurrences; look-ups over symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.columns import any_of, col, lookup, repo_scope
from codelake.functions.skew import lookup_join, request_join


def symbol_kind(language="language", kind="kind", subkind="subkind") -> Column:
    table = {"|".join(k): v for k, v in fv.SYMBOL_KINDS.items()}
    return lookup(F.concat_ws("|", col(language), col(kind), col(subkind)), table)


def kind_category(kind="kind") -> Column:
    return lookup(col(kind), fv.KIND_CATEGORY, fv.KIND_CATEGORY_DEFAULT)


def symbol_id(language, scope, category, qualified) -> Column:
    return F.concat_ws(":", col(language), col(scope), col(category), col(qualified))


def symbol_key(language, scope, category, qualified) -> Column:
    return F.concat_ws("|", col(scope), col(language), col(category), col(qualified))


def generic_params(display="display_name") -> Column:
    """Parameters between the first '<' and the last '>' of a display name."""
    inner = F.regexp_extract(col(display), "(?s)<(.*)>", 1)
    return F.filter(F.transform(F.split(inner, ",", -1), lambda p: F.trim(p)), lambda p: p != "")


def is_type(kind="kind") -> Column:
    return col(kind).isin(fv.TYPE_KINDS)


def _occurrence_id(file="file_id") -> Column:
    return F.concat(
        F.col("symbol_id"), F.lit("::occ::"), F.col(file), F.lit("::"),
        F.col("span.start_line").cast("string"), F.lit("-"),
        F.coalesce(F.col("span.start_col").cast("string"), F.lit("")),
        F.lit("::Declaration"),
    )


def _identified(nodes: DataFrame) -> DataFrame:
    """Nodes that are symbols, with id, key and occurrence id."""
    return (
        nodes.withColumn("symbol_kind", symbol_kind())
        .filter(F.col("symbol_kind").isNotNull())
        .withColumn("scope", repo_scope())
        .withColumn("category", kind_category("symbol_kind"))
        .withColumn("symbol_id", symbol_id("language", "scope", "category", "qualified_path"))
        .withColumn("occurrence_id", _occurrence_id())
    )


def _parent_symbol() -> Column:
    """Symbol id of the parent node.

    Its path is the own path without the own name; its category follows from
    the kind the parser noted, so no self join is needed.
    """
    parent_path = F.left(
        F.col("qualified_path"), F.length("qualified_path") - F.length("name") - 1
    )
    category = (
        F.when((F.col("parent_kind") == "Container") & (F.col("language") == "csharp"), "ns")
        .when(F.col("parent_kind") == "Container", "mod")
        .when(F.col("parent_kind") == "Declaration", "type")
        .when(F.col("parent_kind") == "Callable", "callable")
    )
    return F.when(
        category.isNotNull(),
        symbol_id("language", "scope", category, parent_path),
    )


def _declarations(nodes: DataFrame) -> DataFrame:
    """One row per declaring node with all that a symbol takes from it; the rest follows by ``_completed``."""
    plain = F.filter("modifiers", lambda m: ~m.isin(fv.VISIBILITY_WORDS))
    return _identified(nodes).select(
        "root",
        "symbol_id",
        "name",
        F.col("qualified_path").alias("qualified_name"),
        "display_name",
        F.col("symbol_kind").alias("kind"),
        "subkind",
        "language",
        F.col("file_id").alias("primary_file_id"),
        F.col("path").alias("primary_path"),
        _parent_symbol().alias("parent_symbol_id"),
        F.when(F.col("language") == "csharp", plain).otherwise(_none()).alias("modifiers"),
        "visibility",
        F.col("span"),
        "confidence",
        (
            F.lit(fv.FLAG_HAS_DECLARATIONS)
            + F.when(F.col("has_children"), fv.FLAG_HAS_MEMBERS).otherwise(0)
        ).alias("flags"),
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def _completed(rows: DataFrame) -> DataFrame:
    """Adds the columns that follow from others, after the shuffle of the others."""
    parts = F.split("qualified_name", r"\.", -1)
    key = symbol_key("language", "scope", "category", "qualified_name")
    return rows.withColumn("scope", repo_scope()).withColumn("category", kind_category("kind")).select(
        "root",
        "symbol_id",
        key.alias("symbol_key"),
        "name",
        "qualified_name",
        "display_name",
        "kind",
        "subkind",
        "language",
        "primary_file_id",
        "primary_path",
        _occurrence_id("primary_file_id").alias("primary_occurrence_id"),
        "parent_symbol_id",
        F.slice(parts, F.lit(1), F.size(parts) - 1).alias("container_path"),
        "modifiers",
        F.when(F.col("language") == "csharp", generic_params()).otherwise(_none()).alias("generic_params"),
        "visibility",
        "span",
        "confidence",
        "flags",
    )


def symbol_candidates(nodes: DataFrame) -> DataFrame:
    """One row per declaring node, before declarations of one id are merged."""
    return _completed(_declarations(nodes))


def project_symbols(nodes: DataFrame) -> DataFrame:
    """One row per symbol id; the last declaration by (path, line, column) wins."""
    rows = _declarations(nodes)
    # The order comes first in the row itself, so it is not shuffled beside it. A file id follows from root and path.
    order = ["primary_path", F.col("span.start_line").alias("_line"), F.col("span.start_col").alias("_col"), "primary_file_id"]
    rest = [c for c in rows.columns if c not in ("root", "symbol_id", "primary_path", "primary_file_id")]
    # max combines before the shuffle, so copies of one id do not pile up.
    merged = rows.groupBy("root", "symbol_id").agg(F.max(F.struct(*order, *rest)).alias("s"))
    return _completed(merged.select("root", "symbol_id", "s.*"))


def py_project_symbols(nodes: DataFrame) -> DataFrame:
    return project_symbols(nodes.filter(F.col("language") == "python"))


def symbol_occurrences(nodes: DataFrame) -> DataFrame:
    """Declaration occurrences; nodes that agree on the id are one occurrence."""
    return (
        _identified(nodes)
        .select(
            "root", "occurrence_id", "symbol_id", "file_id", "path",
            F.lit("Declaration").alias("role"), "span",
            F.lit(True).alias("is_primary"), "confidence",
        )
        .dropDuplicates(["root", "occurrence_id"])
    )


# ---- look-ups ---------------------------------------------------------------


def find_symbols(symbols: DataFrame, query: str, mode: str = "prefix") -> DataFrame:
    """exact looks at the simple name; prefix and contains also at the qualified one."""
    q = query.lower()
    name, qualified = F.lower("name"), F.lower("qualified_name")
    if mode == "exact":
        hit = name == q
    elif mode == "contains":
        hit = name.contains(q) | qualified.contains(q)
    else:
        hit = name.startswith(q) | qualified.startswith(q)
    return symbols.filter(hit)


def filter_symbols(
    symbols: DataFrame,
    languages: list[str] | None = None,
    kinds: list[str] | None = None,
    containers: list[str] | None = None,
) -> DataFrame:
    if languages:
        symbols = symbols.filter(F.lower("language").isin([x.lower() for x in languages]))
    if kinds:
        symbols = symbols.filter(F.col("kind").isin(kinds))
    if containers:
        qualified = F.lower("qualified_name")
        symbols = symbols.filter(
            any_of(
                (qualified == c.lower()) | qualified.startswith(c.lower() + ".")
                for c in containers
            )
        )
    return symbols


def primary_locations(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each symbol with the place of its primary declaration."""
    places = occurrences.select(
        "root",
        F.col("occurrence_id").alias("primary_occurrence_id"),
        F.col("path").alias("file_path"),
        F.col("span").alias("occurrence_span"),
        "role",
        "is_primary",
    )
    return symbols.join(places, ["root", "primary_occurrence_id"], "left")


def resolve_locations(
    requests: DataFrame, symbols: DataFrame, occurrences: DataFrame
) -> DataFrame:
    """``requests(root, symbol_id, occurrence_id)``; the occurrence id wins."""
    primary = symbols.select("root", "symbol_id", "primary_occurrence_id")
    by_symbol = requests.join(primary, ["root", "symbol_id"], "left")
    wanted = by_symbol.withColumn(
        "wanted_id", F.coalesce("occurrence_id", "primary_occurrence_id")
    ).withColumn(
        "resolved_by",
        F.when(F.col("occurrence_id").isNotNull(), F.lit("occurrenceId"))
        .when(F.col("symbol_id").isNotNull(), F.lit("symbolId")),
    )
    places = occurrences.select(
        "root", F.col("occurrence_id").alias("wanted_id"), F.col("path").alias("file_path"),
        "span", "role", "is_primary",
    )
    return (
        wanted.drop("primary_occurrence_id")
        .join(places, ["root", "wanted_id"], "left")
        .withColumn(
            "error",
            F.when(
                F.col("resolved_by").isNull(),
                F.lit("Either symbolId or occurrenceId must be provided."),
            ).when(F.col("file_path").isNull(), F.lit("Symbol or occurrence not found.")),
        )
        .drop("wanted_id")
    )


def symbol_occurrence_list(
    requests: DataFrame, occurrences: DataFrame, roles: list[str] | None = None
) -> DataFrame:
    """All occurrences of the requested ``(root, symbol_id)``."""
    if roles:
        occurrences = occurrences.filter(F.col("role").isin(roles))
    wanted = requests.select("root", "symbol_id").distinct()
    return request_join(occurrences, wanted, ["root", "symbol_id"])


def symbol_children(
    symbols: DataFrame, kinds: list[str] | None = None, nested_types: bool = True
) -> DataFrame:
    """Direct children of every symbol."""
    children = symbols.filter(F.col("parent_symbol_id").isNotNull())
    if kinds:
        children = children.filter(F.col("kind").isin(kinds))
    if not nested_types:
        children = children.filter(~is_type())
    parents = symbols.select("root", F.col("symbol_id").alias("parent_symbol_id"))
    return lookup_join(children, parents, ["root", "parent_symbol_id"], "inner")


def type_members(symbols: DataFrame, nested_types: bool = True) -> DataFrame:
    """Members of each type with the section they are listed in."""
    section = (
        F.when(F.col("kind") == "Constructor", "constructors")
        .when(F.col("kind") == "Method", "methods")
        .when(F.col("kind") == "Property", "properties")
        .when(F.col("kind") == "Field", "fields")
        .when(F.col("kind") == "Event", "events")
    )
    if nested_types:
        section = section.when(is_type(), "nested_types")
    types = symbols.filter(is_type()).select(
        "root", F.col("symbol_id").alias("parent_symbol_id")
    )
    members = symbols.withColumn("section", section).filter(
        F.col("section").isNotNull() & F.col("parent_symbol_id").isNotNull()
    )
    return lookup_join(members, types, ["root", "parent_symbol_id"], "inner")


def members_summary(symbols: DataFrame) -> DataFrame:
    """Member counts of every type, zero for types without members."""
    kinds = {
        "constructors": "Constructor", "methods": "Method", "properties": "Property",
        "fields": "Field", "events": "Event",
    }
    counts = (
        symbols.filter(F.col("parent_symbol_id").isNotNull())
        .groupBy("root", F.col("parent_symbol_id").alias("symbol_id"))
        .agg(
            *[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()],
            F.count_if(is_type()).alias("nested_types"),
        )
    )
    names = [*kinds, "nested_types"]
    return (
        symbols.filter(is_type())
        .select("root", "symbol_id", "qualified_name", "kind")
        .join(counts, ["root", "symbol_id"], "left")
        .na.fill(0, names)
    )


def occurrence_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("root", "symbol_id").agg(
        F.count(F.lit(1)).alias("occurrence_count")
    )


def container_counts(symbols: DataFrame) -> DataFrame:
    """Direct symbols and distinct files of each container."""
    return (
        symbols.filter(F.size("container_path") > 0)
        .groupBy("root", F.lower(F.array_join("container_path", ".")).alias("container_key"))
        .agg(
            F.count(F.lit(1)).alias("symbol_count"),
            F.countDistinct("primary_file_id").alias("file_count"),
        )
    )


def name_index(symbols: DataFrame, key: Column | None = None) -> DataFrame:
    """Per name: how many symbols carry it, and the id when there is only one.

    The candidate list itself stays a relation (``name_candidates``): a name
    such as ``get`` may belong to a large share of all symbols. ``key`` is the
    name without case, where a join has it already.
    """
    key = F.lower("name") if key is None else key
    return (
        symbols.groupBy("root", key.alias("name_key"))
        .agg(
            F.count(F.lit(1)).alias("candidate_count"),
            F.min("symbol_id").alias("_first"),
        )
        .select(
            "root", "name_key", "candidate_count",
            F.when(F.col("candidate_count") == 1, F.col("_first")).alias("only_symbol_id"),
        )
    )


def name_candidates(symbols: DataFrame) -> DataFrame:
    return symbols.select("root", F.lower("name").alias("name_key"), "symbol_id")


def declared_last() -> Column:
    """The greatest of these names the symbol that a qualified name leads to, in its field ``symbol_id``."""
    return F.struct("primary_path", "span.start_line", "span.start_col", "symbol_id")


def qualified_index(symbols: DataFrame, key: Column | None = None) -> DataFrame:
    """Qualified name (no case) to the last symbol that carries it; ``key`` as in ``name_index``."""
    key = F.lower("qualified_name") if key is None else key
    return symbols.groupBy("root", key.alias("qualified_key")).agg(
        F.max(declared_last())["symbol_id"].alias("symbol_id")
    )


def unknown_ids(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Requested ids that do not exist, as error rows."""
    return requests.join(
        symbols.select("root", "symbol_id"), ["root", "symbol_id"], "left_anti"
    ).withColumn("error", F.concat(F.lit("Symbol not found: "), F.col("symbol_id")))
