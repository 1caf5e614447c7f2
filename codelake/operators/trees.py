"""Directory trees, namespace trees and file outlines as flat relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.columns import base_name, parent_path, unnest_values
from codelake.functions.skew import first_rows, lookup_join
from codelake.functions.storage import stored
from codelake.operators.symbols import container_counts


def _ancestors(path: str = "path") -> Column:
    """Paths of all folders above a file, outermost first."""
    parts = F.split(F.col(path), "/", -1)
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _hidden(path: str = "path") -> Column:
    return F.exists(F.split(F.col(path), "/", -1), lambda p: p.startswith("."))


def dir_tree(
    files: DataFrame, max_depth: int | None = None, show_hidden: bool = False,
    include_blocked: bool = True,
) -> DataFrame:
    """``(root, path, name, parent, kind, depth, has_children, size_bytes)``.

    ``max_depth`` counts levels below the root, so 1 keeps the top level only.
    """
    rows = files.select("root", "path", "size_bytes")
    if not show_hidden:
        rows = rows.filter(~_hidden())
    if not include_blocked:
        blocked = F.array(*[F.lit(f.lower()) for f in fv.BLOCKED_FOLDERS])
        rows = rows.filter(~F.arrays_overlap(F.split(F.lower("path"), "/", -1), blocked))
    # Folders of one file are short; distinct combines before the shuffle.
    folders = (
        unnest_values(rows, ["root"], _ancestors(), "path")
        .distinct()
        .select(
            "root", "path", F.lit("directory").alias("kind"),
            F.lit(True).alias("has_children"), F.lit(None).cast("bigint").alias("size_bytes"),
        )
    )
    leaves = rows.select(
        "root", "path", F.lit("file").alias("kind"),
        F.lit(None).cast("boolean").alias("has_children"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
    )
    tree = folders.unionByName(leaves).select(
        "root", "path", base_name("path").alias("name"), parent_path("path").alias("parent"),
        "kind", (F.size(F.split("path", "/", -1)) - 1).alias("depth"), "has_children", "size_bytes",
    )
    if max_depth is not None:
        # Folders on the last level are shown but not opened.
        tree = tree.filter(F.col("depth") < max_depth).withColumn(
            "has_children",
            F.when(F.col("kind") == "directory", F.col("depth") < max_depth - 1),
        )
    return tree


def tree_entries(tree: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` entries of each root in path order."""
    return first_rows(tree, ["root"], ["path"], cap)


def tree_totals(files: DataFrame) -> DataFrame:
    """Files, directories and bytes in the subtree of every directory; '' is the root."""
    with_root = F.concat(F.array(F.lit("")), _ancestors())
    per_dir = (
        unnest_values(files, ["root", "size_bytes"], with_root, "directory")
        .groupBy("root", "directory")
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("size_bytes").cast("bigint").alias("total_bytes"),
        )
    )
    folders = unnest_values(files, ["root"], _ancestors(), "path").distinct()
    below = (
        unnest_values(folders, ["root"], with_root, "directory")
        .groupBy("root", "directory")
        .agg(F.count(F.lit(1)).alias("directory_count"))
    )
    return per_dir.join(below, ["root", "directory"], "left").na.fill(0, ["directory_count"])


# ---- outline ----------------------------------------------------------------


def ancestors(nodes: DataFrame) -> DataFrame:
    """``root, path, node_id``, ``ancestors`` (ids from the outermost inwards), ``depth`` and ``cyclic``, from parent ids alone.

    Pointer doubling among the nodes that are a parent: each round joins their
    chains of 1, 2, 4, ... ancestors to themselves, so the rounds grow with the
    logarithm of the depth; every other node then takes the chain of its parent.
    A parent that is not among the nodes ends a chain. Where parents go round in a circle
    the chain has no end: ``cyclic`` is true, depth and ancestors are null.
    Several nodes of one id count as one, with the least parent that is given.
    """
    one = _least_parents(nodes)
    return _with_chains(one, one).drop("up")


def _least_parents(nodes: DataFrame) -> DataFrame:
    """Each node id once, with the least parent ``up`` that is given."""
    return nodes.groupBy("root", "path", "node_id").agg(F.min("parent_node_id").alias("up"))


def _with_chains(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows(root, path, up, ...)`` with what is known of the chain that begins at ``up`` among the nodes ``one``."""
    heads = _parent_chains(one).select(
        "root", "path", F.col("node_id").alias("up"), "above", F.col("up").isNotNull().alias("_endless"), F.lit(True).alias("_there"),
    )
    chain = F.when(F.col("_there"), F.concat(F.array("up"), "above")).otherwise(F.array().cast("array<string>"))
    cyclic = F.coalesce("_endless", F.lit(False))
    return lookup_join(rows, heads, ["root", "path", "up"], counted=one).select(
        *rows.columns, F.when(~cyclic, F.reverse(chain)).alias("ancestors"),
        F.when(~cyclic, F.size(chain)).cast("int").alias("depth"), cyclic.alias("cyclic"),
    )


def _parent_chains(one: DataFrame) -> DataFrame:
    """The nodes of ``one`` that are a parent, with their ancestors ``above`` from the nearest; ``up`` stays where a chain has no end."""
    key = ["root", "path", "node_id"]
    parents = one.where("up is not null").select("root", "path", F.col("up").alias("node_id")).distinct()
    heads = stored(one.join(parents, key, "left_semi"), "heads")
    present = heads.select("root", "path", F.col("node_id").alias("up"), F.lit(True).alias("_there"))
    chains = stored(
        lookup_join(heads, present, ["root", "path", "up"]).select(
            *key, F.when(F.col("_there"), F.col("up")).alias("up"),
            F.when(F.col("_there"), F.array("up")).otherwise(F.array().cast("array<string>")).alias("above"),
        ),
        "chains",
    )
    most = chains.groupBy("root", "path").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= most and not chains.where("up is not null").isEmpty():
        further = chains.select(
            "root", "path", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("above").alias("_above")
        )
        chains = stored(
            lookup_join(chains, further, ["root", "path", "up"]).select(
                *key, F.col("_up").alias("up"),
                F.concat("above", F.coalesce("_above", F.array().cast("array<string>"))).alias("above"),
            ),
            "chains",
        )
        reach *= 2
    return chains


def outline_depth(nodes: DataFrame) -> DataFrame:
    """Depth of each node and the chain of nodes around it, from parent ids (see ``ancestors``)."""
    key = ["root", "path", "node_id"]
    one = _least_parents(nodes)
    rows = nodes.select(*key, "parent_node_id", "qualified_path").join(one.withColumn("_keyed", F.lit(True)), key, "left")
    # A node with a null in its key is no node of a tree.
    found = [F.when(F.col("_keyed"), F.col(c)).alias(c) for c in ("ancestors", "depth", "cyclic")]
    return _with_chains(rows, one).select(*key, "parent_node_id", "qualified_path", *found)


def file_outline(
    nodes: DataFrame, max_depth: int | None = None, include_non_semantic: bool = True
) -> DataFrame:
    """Outline rows of each file, in order of appearance, roots at depth 0.

    Without non-semantic nodes a nested container goes, and all below it with
    it; root nodes always stay.
    """
    rows = nodes
    if max_depth is not None:
        rows = rows.filter(F.col("depth") <= max_depth)
    if not include_non_semantic:
        rows = rows.filter(
            (F.col("depth") == 0)
            | (F.col("kind").isin(fv.SEMANTIC_NODE_KINDS) & ~F.col("inside_container"))
        )
    shown_children = (
        F.col("has_children") & (F.col("depth") < max_depth)
        if max_depth is not None else F.col("has_children")
    )
    return rows.select(
        "root", "path", "node_id", "parent_node_id", "kind", "subkind", "name",
        "display_name", "depth", F.col("span.start_line").alias("start_line"),
        F.col("span.end_line").alias("end_line"), shown_children.alias("expanded"),
        "confidence",
    )


# ---- namespaces -------------------------------------------------------------


def namespace_tree(
    symbols: DataFrame, root_container: str | None = None, max_depth: int | None = None,
    languages: list[str] | None = None,
) -> DataFrame:
    """Containers with parent, depth and direct counts.

    A container whose direct parent is absent hangs on its nearest present
    ancestor; depth 1 is the top level.
    """
    boxes = symbols.filter(F.col("kind").isin(fv.CONTAINER_KINDS))
    if languages:
        boxes = boxes.filter(F.lower("language").isin([x.lower() for x in languages]))
    key = F.lower("qualified_name")
    if root_container:
        r = root_container.lower()
        boxes = boxes.filter((key == r) | key.startswith(r + "."))
    boxes = boxes.select("root", "name", "qualified_name", "kind", key.alias("container_key"))
    parts = F.split("container_key", r"\.", -1)
    prefixes = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))
    present = boxes.select(
        "root", F.col("container_key").alias("ancestor_key"),
        F.col("qualified_name").alias("ancestor"),
    ).dropDuplicates(["root", "ancestor_key"])
    # A name has few dots, so this is one look-up per prefix, not a tree walk.
    above = lookup_join(
        unnest_values(boxes, ["root", "container_key"], prefixes, "ancestor_key"),
        present, ["root", "ancestor_key"], "inner",
    ).groupBy("root", "container_key").agg(
        F.max_by("ancestor", F.length("ancestor_key")).alias("parent"),
        F.countDistinct("ancestor_key").alias("_above"),
    )
    counts = container_counts(symbols)
    tree = (
        boxes.join(above, ["root", "container_key"], "left")
        .join(counts, ["root", "container_key"], "left")
        .na.fill(0, ["_above", "symbol_count", "file_count"])
        .withColumn("depth", (F.col("_above") + 1).cast("int"))
    )
    if max_depth is not None:
        tree = tree.filter(F.col("depth") <= max_depth)
    return tree.select(
        "root", "name", "qualified_name", "kind", "parent", "depth", "symbol_count", "file_count"
    )
