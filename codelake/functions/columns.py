"""Small column helpers shared by the operators (JVM expressions only)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\n|\r"


def once(build: Callable):
    """Builds a constant expression once per JVM.

    Large expressions over named columns take thousands of calls into the JVM;
    the built columns are values and serve every frame that has those names.
    """
    kept: dict = {}

    @functools.wraps(build)
    def built():
        gateway = SparkContext._gateway
        if "value" not in kept or kept["gateway"] is not gateway:
            kept.update(gateway=gateway, value=build())
        return kept["value"]

    return built


def with_all(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    """Adds columns one after another, so that each may name those before it."""
    for name, column in columns:
        df = df.withColumn(name, column)
    return df


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_id(root="root", path="path") -> Column:
    """128-bit content-free key of a file; stable across snapshots."""
    return F.md5(F.concat(col(root), F.lit("/"), col(path)))


def path_key(path="path") -> Column:
    """Paths compare without case and with forward slashes."""
    return F.lower(F.replace(col(path), F.lit("\\"), F.lit("/")))


def base_name(path="path") -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_path(path="path") -> Column:
    p = col(path)
    return F.when(
        p.contains("/"), F.left(p, F.length(p) - F.length(base_name(p)) - 1)
    ).otherwise(F.lit(""))


def extension(path="path") -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    name = base_name(path)
    ext = F.substring_index(name, ".", -1)
    return F.when(
        name.contains(".") & (F.length(ext) > 0), F.lower(F.concat(F.lit("."), ext))
    ).otherwise(F.lit(""))


def any_of(tests: Iterable[Column]) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return F.lit(False) if out is None else out


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """Constant map lookup; the map is a folded literal, so no join is needed."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*entries), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def escape_regex(text: str) -> str:
    r"""Literal text as a regex; \Q..\E would break on an embedded \E."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-&~#" else c for c in text)


def escape_regex_column(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\$1")


def glob_regex(pattern: str) -> str:
    """Whole-path glob: ``*`` crosses folders, ``?`` is one character, no case."""
    p = pattern.replace("\\", "/")
    body = "".join(
        ".*" if c == "*" else "." if c == "?" else escape_regex(c) for c in p
    )
    return f"(?isu)\\A{body}\\z"


def wildcard_regex(pattern: str, ignore_case: bool = True) -> str:
    body = "".join(
        ".*" if c == "*" else "." if c == "?" else escape_regex(c) for c in pattern
    )
    return f"{'(?iu)' if ignore_case else ''}^{body}$"


def wildcard_regex_column(pattern: Column) -> Column:
    quoted = escape_regex_column(pattern)
    quoted = F.replace(quoted, F.lit("\\*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("\\?"), F.lit(".")), F.lit("$"))


def physical_lines(content="content") -> Column:
    """Lines on CRLF, LF or CR; a final terminator opens no further line.

    Empty content gives one empty line, so callers drop empty content first.
    """
    c = col(content)
    body = (
        F.when(c.endswith("\r\n"), F.left(c, F.length(c) - 2))
        .when(c.endswith("\n") | c.endswith("\r"), F.left(c, F.length(c) - 1))
        .otherwise(c)
    )
    return F.split(body, LINE_BREAK, -1)


def physical_line_array(content="content") -> Column:
    c = col(content)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(physical_lines(c))


def lf_lines(content="content") -> Column:
    """Lines on LF only, trailing empty piece kept."""
    return F.split(col(content), "\n", -1)


def span(start_line, end_line, start_col=None, end_col=None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        col(start_line).cast("int").alias("start_line"),
        (none if start_col is None else col(start_col).cast("int")).alias("start_col"),
        col(end_line).cast("int").alias("end_line"),
        (none if end_col is None else col(end_col).cast("int")).alias("end_col"),
    )


def repo_scope(root="root") -> Column:
    """Last path segment, lower case, other characters than letters/digits to '-'."""
    trimmed = F.regexp_replace(col(root), r"[/\\]+$", "")
    last = F.regexp_extract(trimmed, r"([^/\\]*)$", 1)
    return F.btrim(F.regexp_replace(F.lower(last), r"[^\p{L}\p{Nd}]", "-"), F.lit("-"))


def unnest(df: DataFrame, keep: list, array: Column, present: str) -> DataFrame:
    """``inline`` without the optimizer's extra filter on the array size.

    Spark adds ``size(array) > 0`` below a plain generator and pushes it down
    by substitution, which evaluates a derived array twice and copies its whole
    expression tree. The outer form has no such filter; ``present`` names a
    field that is never null, to drop the row of an empty array.
    """
    return df.select(*keep, F.inline_outer(array)).filter(F.col(present).isNotNull())


def unnest_values(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """``explode`` / ``posexplode`` in the same manner, for arrays without nulls."""
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(
        F.col(pos).isNotNull()
    )
