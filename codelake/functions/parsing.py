"""Parsing contents in Python workers, with the relations of each file in its row.

A syntax is a class over one content: ``structure()`` gives it back ready to
answer ``nodes(file_id)``, ``imports()`` and ``hints(parts)`` as tuples, of which
nodes have the 18 values of ``_node_array`` and the others end in their line.
Memory is bounded by steps: their rows go out before the next contents are parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Contents of so many bytes and rows are parsed before their rows go out, so memory stays bounded.
STEP_BYTES, STEP_ROWS = 1 << 20, 256

_SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
RELATIONS = {
    "nodes": (
        "array<struct<node_id:string,parent_node_id:string,parent_kind:string,kind:string,subkind:string,language:string,"
        f"name:string,display_name:string,qualified_path:string,span:{_SPAN},modifiers:array<string>,visibility:string,"
        "depth:int,inside_container:boolean,has_children:boolean,confidence:double>>"
    ),
    "imports": f"array<struct<kind:string,raw_text:string,target:string,alias:string,span:{_SPAN}>>",
    "hints": f"array<struct<hint_no:int,source_path:string,kind:string,target_name:string,evidence:string,span:{_SPAN}>>",
}


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def _ints(values: list) -> pa.Array:
    return pa.array(values, pa.int32())


def _structs(**fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def _spans(start: list, start_col: list | None, end: list) -> pa.Array:
    none = pa.nulls(len(start), pa.int32())
    return _structs(start_line=_ints(start), start_col=none if start_col is None else _ints(start_col), end_line=_ints(end), end_col=none)


def _columns(rows: list[list[tuple] | None], width: int) -> tuple[list[list], pa.Array]:
    """The rows of all files column by column, and where the rows of each file begin; None is no array."""
    flat, offsets = [], []
    for own in rows:
        offsets.append(None if own is None else len(flat))
        flat += own or ()
    offsets.append(len(flat))
    return list(zip(*flat, strict=True)) or [()] * width, _ints(offsets)


def _node_array(rows: list[list[tuple] | None]) -> pa.Array:
    c, offsets = _columns(rows, 18)
    words, starts = [], [0]
    for own in c[12]:
        words += own
        starts.append(len(words))
    texts = ["node_id", "parent_node_id", "parent_kind", "kind", "subkind", "language", "name", "display_name", "qualified_path"]
    return pa.ListArray.from_arrays(offsets, _structs(
        **{name: _strings(c[i]) for i, name in enumerate(texts)},
        span=_spans(c[9], c[10], c[11]),
        modifiers=pa.ListArray.from_arrays(_ints(starts), _strings(words)),
        visibility=_strings(c[13]),
        depth=_ints(c[14]),
        inside_container=pa.array(c[15], pa.bool_()),
        has_children=pa.array(c[16], pa.bool_()),
        confidence=pa.array(c[17], pa.float64()),
    ))


def _import_array(rows: list[list[tuple] | None]) -> pa.Array:
    kind, raw_text, target, alias, line = (c := _columns(rows, 5))[0]
    return pa.ListArray.from_arrays(c[1], _structs(
        kind=_strings(kind), raw_text=_strings(raw_text), target=_strings(target), alias=_strings(alias), span=_spans(line, None, line),
    ))


def _hint_array(rows: list[list[tuple] | None]) -> pa.Array:
    source, kind, target, evidence, line = (c := _columns(rows, 5))[0]
    number = [i for own in rows for i in range(1, len(own or ()) + 1)]
    return pa.ListArray.from_arrays(c[1], _structs(
        hint_no=_ints(number), source_path=_strings(source), kind=_strings(kind), target_name=_strings(target),
        evidence=_strings(evidence), span=_spans(line, None, line),
    ))


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, of bounded bytes and number."""
    start = held = 0
    sizes = pc.binary_length(batch.column("content")).to_pylist()
    for i, size in enumerate(sizes):
        if i > start and (held + (size or 0) > STEP_BYTES or i - start == STEP_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)


def _parser(
    syntaxes: Mapping[str, type], wanted: tuple[str, ...], hint_parts: tuple[str, ...] | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with ``file_id``, ``language`` and the bytes of ``content`` -> the same with the wanted relations in place of the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _steps(batch):
                found: dict[str, list] = {name: [] for name in wanted}
                for own_id, language, content in zip(*(rows.column(n).to_pylist() for n in ("file_id", "language", "content")), strict=True):
                    source = None if content is None else syntaxes[language](content.decode("utf-8", "replace")).structure()
                    for name, out in found.items():
                        if source is None:
                            out.append(None)
                        elif name == "nodes":
                            out.append(source.nodes(own_id))
                        elif name == "imports":
                            out.append(source.imports())
                        else:
                            out.append(source.hints(hint_parts))
                made = {"nodes": _node_array, "imports": _import_array, "hints": _hint_array}
                keep = [n for n in rows.schema.names if n != "content"]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(n) for n in keep] + [made[n](found[n]) for n in wanted], names=[*keep, *wanted]
                )

    return run


def parsed(
    files: DataFrame, syntaxes: Mapping[str, type], wanted: tuple[str, ...] = tuple(RELATIONS), hint_parts: tuple[str, ...] | None = None
) -> DataFrame:
    """``files`` with ``file_id``, ``language`` and ``content`` -> the relations ``wanted`` in place of the content.

    A null content has null relations, whatever its language. ``hint_parts`` names the kinds of hints to work out, where not all.
    """
    given = files.withColumn("content", F.col("content").cast("binary"))
    added = StructType.fromDDL(", ".join(f"{name} {RELATIONS[name]}" for name in wanted))
    out = StructType([f for f in given.schema.fields if f.name != "content"] + added.fields)
    return given.mapInArrow(_parser(syntaxes, wanted, hint_parts), out)
