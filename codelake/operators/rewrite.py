"""Bulk rewriting of file content, with preview."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.alignment import common_lines
from codelake.functions.columns import escape_regex, physical_line_array
from codelake.functions.skew import lookup_join
from codelake.functions.storage import stored


def replace_text(
    files: DataFrame, old: str, new: str, ignore_case: bool = False, max_n: int = 0
) -> DataFrame:
    """Literal replacement per file; ``replaced`` is 0 where the text is absent."""
    if not old:
        raise ValueError("old text must not be empty")
    pattern = ("(?iu)" if ignore_case else "") + escape_regex(old)
    content = F.col("content")
    if ignore_case:
        count = F.regexp_count("content", F.lit(pattern))
    else:
        count = (
            (F.length(content) - F.length(F.replace(content, F.lit(old), F.lit(""))))
            / F.lit(len(old))
        ).cast("int")
    if max_n > 0:
        changed = F.array_join(F.split("content", pattern, max_n + 1), new)
        count = F.least(count, F.lit(max_n))
    elif ignore_case:
        changed = F.array_join(F.split("content", pattern, -1), new)
    else:
        changed = F.replace(content, F.lit(old), F.lit(new))
    return files.withColumn("replaced", count).withColumn(
        "content", F.when(F.col("replaced") > 0, changed).otherwise(content)
    )


def _ordered(edits: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """The edits of each file in order.

    An edit list is applied one after the other to one content, so it has to
    meet in one row; it is as long as somebody wrote edits for that file.
    """
    return edits.groupBy(*(keys or ["root", "path"])).agg(
        F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("_edits")
    )


def edit_sequence(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(root, path, ord, old, new)``: exact replacements in order.

    Each text must be present when its turn comes; otherwise the file is left
    as it was and ``failed_ord`` names the edit.
    """
    start = F.struct(
        F.col("content").alias("c"), F.lit(None).cast(edits.schema["ord"].dataType).alias("bad")
    )

    def step(acc: Column, e: Column) -> Column:
        missing = ~acc["c"].contains(e["old"]) | (e["old"] == "")
        return F.struct(
            F.when(acc["bad"].isNotNull() | missing, acc["c"])
            .otherwise(F.replace(acc["c"], e["old"], e["new"]))
            .alias("c"),
            F.coalesce(acc["bad"], F.when(missing, e["ord"])).alias("bad"),
        )

    rows = files.join(_ordered(edits, ["old", "new"]), ["root", "path"]).withColumn(
        "_r", F.aggregate("_edits", start, step)
    )
    failed = F.col("_r.bad").isNotNull()
    return (
        rows.withColumn("ok", ~failed)
        .withColumn("failed_ord", F.col("_r.bad"))
        .withColumn("edit_count", F.size("_edits"))
        .withColumn("content", F.when(failed, F.col("content")).otherwise(F.col("_r.c")))
        .drop("_r", "_edits")
    )


def _lines_replaced(content: Column, start: Column, end: Column, new: Column) -> Column:
    """Content with lines start..end replaced; every line ends in LF."""
    lines = physical_line_array(content)
    fresh = F.when(new == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(new, "\r\n|\r", "\n"), "\n", -1)
    )
    merged = F.concat(
        F.slice(lines, F.lit(1), start - 1),
        fresh,
        F.slice(lines, F.least(end, F.size(lines)) + 1, F.size(lines)),
    )
    return F.array_join(F.transform(merged, lambda t: F.concat(t, F.lit("\n"))), "")


def replace_line_range(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(root, path, start, end, new)``: one line range per file; end is clipped."""
    joined = files.join(edits.select("root", "path", "start", "end", "new"), ["root", "path"])
    total = F.size(physical_line_array())
    bad = (F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("start") > total)
    return (
        joined.withColumn("ok", ~bad)
        .withColumn(
            "affected",
            F.when(bad, 0).otherwise(F.least("end", total) - F.col("start") + 1),
        )
        .withColumn(
            "content",
            F.when(bad, F.col("content")).otherwise(
                _lines_replaced(F.col("content"), F.col("start"), F.col("end"), F.col("new"))
            ),
        )
        .drop("start", "end", "new")
    )


def _appended(content: Column, text: Column, ensure_newline: bool = True) -> Column:
    if not ensure_newline:
        return F.concat(content, text)
    gap = F.when(
        (content != "") & ~content.endswith("\n") & ~content.endswith("\r"), "\n"
    ).otherwise("")
    return F.concat(content, gap, text)


def append_content(files: DataFrame, text: str, ensure_newline: bool = True) -> DataFrame:
    return files.withColumn(
        "content", _appended(F.col("content"), F.lit(text), ensure_newline)
    )


def normalize_line_endings(files: DataFrame, style: str = "auto") -> DataFrame:
    """lf, crlf or cr; auto keeps CRLF or CR where the file has one, else LF."""
    content = F.col("content")
    lf = F.regexp_replace("content", "\r\n|\r", "\n")
    crlf, cr = F.replace(lf, F.lit("\n"), F.lit("\r\n")), F.replace(lf, F.lit("\n"), F.lit("\r"))
    fixed = {"lf": lf, "crlf": crlf, "cr": cr}
    style = style.lower()
    if style in fixed:
        return files.withColumn("content", fixed[style])
    return files.withColumn(
        "content",
        F.when(content.contains("\r\n"), crlf).when(content.contains("\r"), cr).otherwise(lf),
    )


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True)
        counts = [(len(a), len(b), common_lines(a, b)) for a, b in pairs]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("root"), batch.column("path"),
                pa.array([n - same for _, n, same in counts], pa.int64()), pa.array([m - same for m, _, same in counts], pa.int64()),
            ],
            names=["root", "path", "lines_added", "lines_removed"],
        )


def preview_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines added and removed per file: those outside a longest common subsequence, so moved lines count.

    Unchanged files leave after one comparison. Lines become hashes before the
    alignment (see ``common_lines``), which has no line limit. A missing or null
    file has no lines.
    """
    both = before.select("root", "path", F.col("content").alias("_old")).join(
        after.select("root", "path", F.col("content").alias("_new")), ["root", "path"], "full"
    )

    def hashes(content: str) -> Column:
        lines = F.coalesce(physical_line_array(content), F.array().cast("array<string>"))
        return F.transform(lines, lambda t: F.xxhash64(t))

    changed = both.filter(~F.col("_old").eqNullSafe(F.col("_new")))
    lines = changed.select("root", "path", hashes("_old").alias("_a"), hashes("_new").alias("_b"))
    return lines.mapInArrow(_aligned, "root string, path string, lines_added bigint, lines_removed bigint")


def batch_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(root, path, ord, op, old, new, start, end)`` of mixed kinds.

    Operations: replace_text, replace_lines, append_file, write_file. A file is
    changed by all of its edits or by none; an edit on an unknown path fails.
    """
    return _edited(files, edits, ["root", "path"]).drop("original")


def _edited(files: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Each file of ``keys`` with its edits applied, and its ``original`` content."""
    start = F.struct(
        F.col("content").alias("c"), F.lit(None).cast(edits.schema["ord"].dataType).alias("bad")
    )

    def step(acc: Column, e: Column) -> Column:
        total = F.size(physical_line_array(acc["c"]))
        possible = (
            F.when(e["op"] == "replace_text", acc["c"].contains(e["old"]) & (e["old"] != ""))
            .when(
                e["op"] == "replace_lines",
                (e["start"] >= 1) & (e["end"] >= e["start"]) & (e["start"] <= total),
            )
            .otherwise(e["op"].isin("append_file", "write_file"))
        )
        done = (
            F.when(e["op"] == "replace_text", F.replace(acc["c"], e["old"], e["new"]))
            .when(
                e["op"] == "replace_lines",
                _lines_replaced(acc["c"], e["start"], e["end"], e["new"]),
            )
            .when(e["op"] == "append_file", _appended(acc["c"], e["new"]))
            .otherwise(e["new"])
        )
        fails = ~F.coalesce(possible, F.lit(False))
        return F.struct(
            F.when(acc["bad"].isNotNull() | fails, acc["c"]).otherwise(done).alias("c"),
            F.coalesce(acc["bad"], F.when(fails, e["ord"])).alias("bad"),
        )

    grouped = _ordered(edits, ["op", "old", "new", "start", "end"], keys)
    rows = grouped.join(files.select("root", "path", "content"), ["root", "path"], "left")
    first = F.element_at("_edits", 1)["ord"]
    rows = rows.withColumn("_r", F.when(F.col("content").isNotNull(), F.aggregate("_edits", start, step)))
    failed = F.col("content").isNull() | F.col("_r.bad").isNotNull()
    return rows.select(
        *keys,
        (~failed).alias("ok"),
        F.when(F.col("content").isNull(), first).otherwise(F.col("_r.bad")).alias("failed_ord"),
        F.size("_edits").alias("edit_count"),
        F.when(failed, F.col("content")).otherwise(F.col("_r.c")).alias("content"),
        F.col("content").alias("original"),
    )


def batches(files: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits`` as for ``batch_edits`` with a column ``batch``: each batch as a whole or not at all.

    First every file of a batch is edited by itself; then the batches with a
    failure are told to all of their files, which go back to what they were.
    First frame: per batch and file ``ok`` (of the file itself), ``committed`` (of
    its batch), ``failed_ord``, ``edit_count`` and ``content``. Second: per batch
    ``succeeded_files``, ``failed_files``, ``applied_edits`` (0 unless committed) and
    ``committed``. Batches start from the same files and do not see each other.
    A null batch is a batch of its own.
    """
    named = edits.withColumn("_batch", F.struct(F.col("batch").isNull().alias("none"), F.coalesce(F.col("batch").cast("string"), F.lit("")).alias("name")))
    done = stored(_edited(files, named, ["_batch", "root", "path"]), "edited")
    counts = done.groupBy("_batch").agg(
        F.count_if("ok").alias("succeeded_files"), F.count_if(~F.col("ok")).alias("failed_files"), F.sum("edit_count").alias("_edits")
    ).withColumn("committed", F.col("failed_files") == 0)
    batch = F.when(~F.col("_batch.none"), F.col("_batch.name")).cast(edits.schema["batch"].dataType).alias("batch")
    # A batch may hold most files: its flag reaches them by a join that salts hot keys.
    flagged = lookup_join(done, counts.select("_batch", "committed"), ["_batch"], "inner", spread=F.xxhash64("root", "path"))
    rows = flagged.select(
        batch, "root", "path", "ok", "committed", "failed_ord", "edit_count",
        F.when(F.col("committed"), F.col("content")).otherwise(F.col("original")).alias("content"),
    )
    applied = F.when(F.col("committed"), F.col("_edits")).otherwise(F.lit(0)).cast("bigint")
    return rows, counts.select(batch, "succeeded_files", "failed_files", applied.alias("applied_edits"), "committed")


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("ok").alias("succeeded_files"),
        F.count_if(~F.col("ok")).alias("failed_files"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("edit_count"))), F.lit(0)).alias("applied_edits"),
    )
