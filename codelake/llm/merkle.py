"""A Merkle manifest of a table, folded with retained hash states.

The leaf of a row is the digest of its columns, each ``-`` if null, else its
UTF-8 byte count, ``:`` and the value. The leaves of a tree (one per language)
stand in order of their id; while several nodes remain, every eight consecutive
ones become the digest of their digests as text. The roots of all trees, in
order of their language (null first), form the tree of the table.

A parent feeds its children to one hash, and keeps a copy of the hash state
before each child. To prove another leaf, a copy of the state before its slot
takes the replacement and the siblings to the right, and nothing else; the same
happens at every parent up to the root.

Leaves get their places from a range partition by language and id and a table
of counts per part, so one language may hold any share of all rows. Eight to the
fourth consecutive nodes are one chunk and one group of a shuffle: a pass builds
four levels and leaves one node per chunk, and passes repeat until each tree has
one node. The way back hands each chunk the siblings of its own path, from which
a task makes the states above the chunk once for all its leaves. So no group is
larger than a chunk and its path, and the passes grow with the logarithm of the
largest tree. Leaves are written to the shared folder, texts are read once.

Several rows with one id stand in order of their leaves; equal rows in any
order, as they have equal leaves. A null id counts as least, and as empty text
where ids are hashed. Null and empty values differ in a leaf. An empty table gives
an empty result. Other columns are not read, whatever they are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.skew import request_join
from codelake.functions.storage import Stored
from codelake.llm.spread import plain, remainder

FAN, LEVELS = 8, 4
CHUNK = FAN**LEVELS
HASHED = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def _part(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: list[Column]) -> Column:
    """The digest of a row of values."""
    return F.sha2(F.concat(*[_part(v) for v in values]), 256)


class Parent:
    """A node whose hash keeps a copy of its state before each child."""

    def __init__(self, children: list[str]) -> None:
        self.right = ["".join(children[i + 1 :]) for i in range(len(children))]
        self.left = ["".join(children[:i]) for i in range(len(children))]
        self.before = []
        state = hashlib.sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        """The digest with another child in one slot."""
        state = self.before[slot].copy()
        state.update((replacement + self.right[slot]).encode())
        return state.hexdigest()


class Above:
    """The parents above a chunk, of which only the state before its own slot is kept."""

    def __init__(self, path: list[dict]) -> None:
        self.steps = []
        for step in path:
            self.steps.append((hashlib.sha256(step["left"].encode()), step["right"].encode()))
        self.siblings = "".join(step["left"] + step["right"] for step in path)

    def fold(self, node: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update(node.encode())
            state.update(right)
            node = state.hexdigest()
        return node


def heights(total: int) -> int:
    """Levels of parents above a tree's chunk of nodes: all of a chunk's, or as many as the whole tree needs."""
    if total > CHUNK:
        return LEVELS
    levels, width = 0, 1
    while width < total:
        levels, width = levels + 1, width * FAN
    return levels


class Tree:
    """The nodes of one chunk, level by level."""

    def __init__(self, digests: list[str], total: int) -> None:
        self.levels: list[list[Parent]] = []
        nodes = digests
        for _ in range(heights(total)):
            parents = [Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
            self.levels.append(parents)
            nodes = [p.digest for p in parents]
        self.top = nodes[0]

    def path(self, at: int) -> list[dict]:
        """Siblings of one node of the chunk, up to its top."""
        steps = []
        for parents in self.levels:
            parent, slot = parents[at // FAN], at % FAN
            steps.append({"left": parent.left[slot], "right": parent.right[slot]})
            at //= FAN
        return steps

    def fold(self, at: int, node: str) -> str:
        for parents in self.levels:
            node = parents[at // FAN].fold(at % FAN, node)
            at //= FAN
        return node


def _numbered(df: DataFrame, order: list[str], store: Stored, name: str) -> DataFrame:
    """Adds ``place``, the number of each row within its ``tree`` by ``order``, and ``total``, the rows of that tree.

    A range partition by tree and order numbers its rows by itself; a table with
    one row per part and tree holds what the parts before it hold.
    """
    kind = df.schema
    keys = ["tree", *order]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, following = None, 0
        for batch in batches:
            places = []
            for t in batch.column("tree").to_pylist():
                if t != tree:
                    tree, following = t, 0
                places.append(following)
                following += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "inside"])

    parts = df.repartitionByRange(*[F.asc_nulls_first(k) for k in keys]).withColumn("part", F.spark_partition_id())
    parts = parts.sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields)
    parts = store.table(parts.mapInArrow(number, f"{fields}, part int, inside long"), name)
    counts = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("total"),
    )
    # One row per part and tree: broadcast if counted small, else the rows are salted.
    joined = request_join(parts, store.table(offsets, "offsets"), ["tree", "part"])
    return joined.withColumn("place", F.col("inside") + F.col("offset")).drop("part", "inside", "offset")


def _raise(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("place")
    total = int(nodes["total"].iat[0])
    top = Tree(nodes["digest"].tolist(), total).top
    return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "total": [-(-total // CHUNK)], "digest": [top]})


_NODES = "tree string, place long, total long, digest string"


def _chunked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("chunk", F.expr(f"place div {CHUNK}"))


class Forest:
    """Trees over numbered nodes (``tree``, ``place``, ``total``, ``digest``): passes upwards, then paths downwards."""

    def __init__(self, nodes: DataFrame, store: Stored) -> None:
        self.store = store
        self.passes = [nodes]
        most = nodes.agg(F.max("total")).first()[0] or 0
        while True:
            chunks = _chunked(self.passes[-1].select("tree", "place", "total", "digest")).groupBy("tree", "chunk")
            self.passes.append(store.table(chunks.applyInPandas(_raise, _NODES), "nodes"))
            most = -(-most // CHUNK)
            if most <= 1:
                break
        self.roots = self.passes[-1].select("tree", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """Per lowest chunk (``tree``, ``chunk``): the siblings above it, given those above each root (``tree``, ``path``).

        ``outer`` counts the steps that were given.
        """
        paths = above.select("tree", F.lit(0).cast("long").alias("chunk"), "path", F.size("path").alias("outer"))
        for nodes in self.passes[-2:0:-1]:
            together = _chunked(nodes).groupBy("tree", "chunk").cogroup(paths.groupBy("tree", "chunk"))
            paths = self.store.table(together.applyInPandas(_hand_down, f"tree string, chunk long, path {_PATH}, outer int"), "paths")
        return paths


def _steps(path) -> list[dict]:
    return [{"left": s["left"], "right": s["right"]} for s in path]


def _hand_down(nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
    """Each node of a chunk is a chunk of the pass below; its path is its own siblings and the chunk's path."""
    if nodes.empty:
        return pd.DataFrame(columns=["tree", "chunk", "path", "outer"])
    nodes = nodes.sort_values("place")
    tree = Tree(nodes["digest"].tolist(), int(nodes["total"].iat[0]))
    tail = _steps(path["path"].iat[0])
    rows = [tree.path(i) + tail for i in range(len(nodes))]
    return pd.DataFrame(
        {"tree": nodes["tree"].to_numpy(), "chunk": nodes["place"].to_numpy(), "path": rows, "outer": path["outer"].iat[0]}
    )


def _proofs(with_siblings: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def proofs(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree = Tree(rows["digest"].tolist(), int(rows["total"].iat[0]))
        steps_above = _steps(path["path"].iat[0])
        above = Above(steps_above)
        # Steps below the subroot come first; those of the tree of roots are the outer ones.
        inner = Above(steps_above[: len(steps_above) - int(path["outer"].iat[0])])
        subroot, root = inner.fold(tree.top), above.fold(tree.top)
        proof, folded, siblings = [], [], []
        for i, other in enumerate(rows["presented"]):
            steps = tree.path(i)
            text = "".join(s["left"] + s["right"] for s in steps) + above.siblings
            proof.append(hashlib.sha256(text.encode()).hexdigest())
            folded.append(above.fold(tree.fold(i, other)))
            if with_siblings:
                siblings.append(steps + steps_above)
        out = {"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": subroot, "root": root,
               "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]}
        if with_siblings:
            out["siblings"] = siblings
        return pd.DataFrame(out)

    return proofs


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.translate(text.cast("string"), _UPPER, _LOWER)


def proofs(
    docs: DataFrame, presented: Callable[[dict[str, Column]], Column] | None = None, siblings: bool = False
) -> DataFrame:
    """The manifest of ``docs`` and the proof of each row.

    ``presented`` gives the leaf that a verifier presents for each row, from the
    columns that are hashed; by default the row's own. One row per row of
    ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root`` and ``verified``, and the ``siblings`` themselves if asked,
    level by level.
    """
    store = Stored(docs.sparkSession)
    read = plain(docs, *HASHED)
    columns = {name: F.col(name) for name in HASHED}
    own = leaf([columns[n] for n in HASHED])
    # Trees are named so that names sort as languages do, null first.
    tree = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))
    leaves = read.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"),
        (presented(columns) if presented else own).alias("presented"),
    )
    # Written before they are ordered: texts are hashed once, and the salt of equal rows lasts.
    leaves = store.table(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    numbered = _numbered(leaves, ["doc_id", "digest", "salt"], store, "numbered")
    lower = Forest(numbered, store)
    trees = lower.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    names = store.table(_numbered(trees, ["name"], store, "trees"), "trees")
    upper = Forest(names, store)
    top = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"))
    chunks = upper.paths(top)
    roots = (
        _chunked(names).groupBy("tree", "chunk").cogroup(chunks.groupBy("tree", "chunk"))
        .applyInPandas(_root_paths, f"tree string, path {_PATH}")
    )
    above = store.table(roots, "roots")
    paths = lower.paths(above)
    kind = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    # Ids travel as text, as pandas turns numbers beside nulls into floats.
    rows = _chunked(numbered).select("tree", "chunk", "place", "total", F.col("doc_id").cast("string"), "digest", "presented")
    proved = rows.groupBy("tree", "chunk").cogroup(paths.groupBy("tree", "chunk")).applyInPandas(
        _proofs(siblings), f"{kind}, siblings {_PATH}" if siblings else kind
    )
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def _root_paths(nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
    """The path above each tree's root."""
    if nodes.empty:
        return pd.DataFrame(columns=["tree", "path"])
    nodes = nodes.sort_values("place")
    tree = Tree(nodes["digest"].tolist(), int(nodes["total"].iat[0]))
    tail = _steps(path["path"].iat[0])
    return pd.DataFrame({"tree": nodes["name"].to_numpy(), "path": [tree.path(i) + tail for i in range(len(nodes))]})


def tampered_leaf(columns: dict[str, Column]) -> Column:
    """The leaf of a row whose text is lower-cased where 3 divides the hash of its id."""
    text = columns["text"]
    changed = F.when(remainder(columns["doc_id"], 3) == 0, lowered(text)).otherwise(text.cast("string"))
    return leaf([changed if n == "text" else columns[n] for n in HASHED])


def tamper_report(docs: DataFrame) -> DataFrame:
    """The proofs of all rows, where a third of them present a lower-cased text."""
    return proofs(docs, tampered_leaf)
