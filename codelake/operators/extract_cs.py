"""Declarations, imports and reference hints of C#-like sources.

Read without a compiler front end, file by file in Python workers (see
``cs_syntax``): no shuffle, and a file costs little more than its lines. One
pass over the whole content cuts comments, strings (verbatim and raw ones too),
characters and directives and leaves their line breaks, so lines keep their
numbers. The code lines are gathered into statements, each from its first line
to the line of its ``{``, ``}`` or ``;``, so heads, parameter lists and base
lists may run over several lines; attributes that stand before it are statements
of their own. Scopes come from one pass with a stack. Limits: holes of
interpolated strings count as text, both branches of ``#if`` count as code, and
of several declarations on one line only the first is read. Confidence is 0.75
throughout so that nobody takes it for compiler output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.arrays import let
from codelake.functions.columns import file_id, physical_lines
from codelake.functions.parsing import RELATIONS, parsed
from codelake.operators.cs_syntax import NOISE, Source
from codelake.operators.extract_py import inline_hints, inline_imports, inline_nodes


def code_text(content="content") -> Column:
    """The content without strings, comments and directives; their line breaks stay."""
    text = F.col(content) if isinstance(content, str) else content
    suspect = text.rlike("[\"'/#]")
    tokens = F.regexp_extract_all(text, F.lit(NOISE), F.lit(0))
    breaks = F.transform(tokens, lambda t: F.regexp_replace(t, r"[^\r\n]+", ""))
    pieces = F.split(text, NOISE, -1)
    joined = F.array_join(
        F.transform(
            F.arrays_zip(pieces.alias("piece"), breaks.alias("breaks")),
            lambda z: F.concat(z["piece"], F.coalesce(z["breaks"], F.lit(""))),
        ),
        "",
    )
    return F.when(suspect, joined).otherwise(text)


def code_lines(content="content") -> Column:
    """Code line by line, one for each physical line."""
    text = F.col(content) if isinstance(content, str) else content
    # The text is cut once; without ``let`` every mention of it in the line split would cut it again.
    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(code_text(text), physical_lines))


def _parsed(
    files: DataFrame, keep: list[str] | None = None, wanted: tuple[str, ...] = tuple(RELATIONS), hint_parts: tuple[str, ...] | None = None
) -> DataFrame:
    """Only the relations ``wanted`` and the named parts of the hints are worked out."""
    given = files.select("root", "path", file_id().alias("file_id"), *(keep or []), F.lit("csharp").alias("language"), "content")
    return parsed(given, {"csharp": Source}, wanted, hint_parts)


def parse_csharp(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``files(root, path, content)`` -> one row per file with nodes, imports, hints.

    The columns ``keep`` come along.
    """
    return _parsed(files, keep)


def cs_declarations(files: DataFrame) -> DataFrame:
    return inline_nodes(_parsed(files, wanted=("nodes",)))


def cs_imports(files: DataFrame) -> DataFrame:
    return inline_imports(_parsed(files, wanted=("imports",)))


def _only(files: DataFrame, part: str) -> DataFrame:
    return inline_hints(_parsed(files, wanted=("hints",), hint_parts=(part,)))


def cs_hints(files: DataFrame) -> DataFrame:
    """Hints of every kind."""
    return inline_hints(_parsed(files, wanted=("hints",)))


def cs_base_hints(files: DataFrame) -> DataFrame:
    return _only(files, "base")


def cs_field_hints(files: DataFrame) -> DataFrame:
    return _only(files, "field")


def cs_property_hints(files: DataFrame) -> DataFrame:
    return _only(files, "property")


def cs_method_hints(files: DataFrame) -> DataFrame:
    return _only(files, "method")


def cs_ctor_hints(files: DataFrame) -> DataFrame:
    return _only(files, "constructor")


def cs_creation_hints(files: DataFrame) -> DataFrame:
    return _only(files, "creation")


def cs_attribute_hints(files: DataFrame) -> DataFrame:
    return _only(files, "attribute")
