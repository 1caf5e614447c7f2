"""Python declarations, imports and base-class hints.

Read line by line in Python workers (see ``py_syntax``), one file at a time: no
shuffle, and near-linear cost in the number of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.columns import file_id, unnest
from codelake.functions.parsing import RELATIONS, parsed
from codelake.operators.py_syntax import Source


def _parsed(files: DataFrame, keep: list[str] | None = None, wanted: tuple[str, ...] = tuple(RELATIONS)) -> DataFrame:
    """Only the relations ``wanted`` are worked out."""
    given = files.select("root", "path", file_id().alias("file_id"), *(keep or []), F.lit("python").alias("language"), "content")
    return parsed(given, {"python": Source}, wanted)


def parse_python(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``files(root, path, content)`` -> one row per file with nodes, imports, hints.

    The columns ``keep`` come along.
    """
    return _parsed(files, keep)


def inline_nodes(parsed: DataFrame) -> DataFrame:
    return unnest(parsed, ["root", "path", "file_id"], F.col("nodes"), "node_id")


def inline_imports(parsed: DataFrame) -> DataFrame:
    return unnest(parsed, ["root", "path", "file_id", "language"], F.col("imports"), "kind")


def inline_hints(parsed: DataFrame) -> DataFrame:
    return unnest(parsed, ["root", "path", "file_id", "language"], F.col("hints"), "hint_no")


def py_declarations(files: DataFrame) -> DataFrame:
    return inline_nodes(_parsed(files, wanted=("nodes",)))


def py_block_span(files: DataFrame) -> DataFrame:
    """Start and end line of every declaration block."""
    return py_declarations(files).select(
        "root", "path", "node_id", "qualified_path",
        F.col("span.start_line").alias("start_line"),
        F.col("span.end_line").alias("end_line"),
    )


def py_imports(files: DataFrame) -> DataFrame:
    return inline_imports(_parsed(files, wanted=("imports",)))


def py_base_hints(files: DataFrame) -> DataFrame:
    return inline_hints(_parsed(files, wanted=("hints",)))
