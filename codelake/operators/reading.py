"""Bulk reads of file content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.columns import file_id, lf_lines, path_key, physical_line_array


def content_hash(files: DataFrame, algo: str = "sha256", column: str = "raw") -> DataFrame:
    """Lower-case hex digest of the bytes."""
    data = F.col(column).cast("binary")
    digest = {
        "sha256": lambda: F.sha2(data, 256), "sha1": lambda: F.sha1(data),
        "md5": lambda: F.md5(data),
    }[algo.lower()]()
    return files.withColumn("content_hash", digest)


def read_many_files(
    files: DataFrame, paths: DataFrame, max_bytes: int | None = None
) -> DataFrame:
    """Content for ``paths(root, path)``; a missing path is a row with an error.

    Content beyond ``max_bytes``, where given, is cut and marked ``truncated``.
    """
    wanted = paths.select("root", F.col("path").alias("requested_path"), path_key().alias("_key"))
    known = files.select("root", path_key().alias("_key"), "content")
    data = F.col("content").cast("binary")
    size = F.octet_length("content")
    long = F.lit(False) if max_bytes is None else F.coalesce(size > max_bytes, F.lit(False))
    cut = F.make_valid_utf8(F.substring(data, 1, max_bytes or 0).cast("string"))
    return wanted.join(known, ["root", "_key"], "left").select(
        "root",
        F.col("requested_path").alias("path"),
        F.col("content").isNotNull().alias("success"),
        F.when(long, cut).otherwise(F.col("content")).alias("content"),
        size.alias("size_bytes"),
        long.alias("truncated"),
        F.when(
            F.col("content").isNull(), F.concat(F.lit("File not found: "), F.col("requested_path"))
        ).alias("error"),
    )


def read_line_range(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines of ``ranges(root, path, start_line, end_line)``; end < 1 means to the end.

    The lines are cut from the array of the file row: nothing outside the
    range is exploded. A start beyond the file gives one row with an error.
    """
    texts = files.select("root", "path", physical_line_array().alias("_lines"))
    rows = (
        ranges.join(texts, ["root", "path"])
        .withColumn("total_lines", F.size("_lines"))
        .withColumn("_from", F.greatest(F.col("start_line"), F.lit(1)))
        .withColumn(
            "_to",
            F.when(F.col("end_line") < 1, F.col("total_lines")).otherwise(
                F.least("end_line", "total_lines")
            ),
        )
        .withColumn(
            "_cut",
            F.slice("_lines", F.col("_from"), F.greatest(F.col("_to") - F.col("_from") + 1, F.lit(0))),
        )
    )
    return rows.select(
        "root", "path", "start_line", "end_line", "total_lines",
        F.when(
            F.col("_from") > F.col("total_lines"),
            F.format_string(
                "StartLine %d exceeds file length (%d lines).", "_from", "total_lines"
            ),
        ).alias("error"),
        "_from",
        F.posexplode_outer("_cut").alias("_pos", "text"),
    ).select(
        "root", "path", "start_line", "end_line", "total_lines",
        (F.col("_from") + F.col("_pos")).cast("int").alias("line"), "text", "error",
    )


def head_tail(files: DataFrame, head: int | None = None, tail: int | None = None) -> DataFrame:
    """First or last lines of each file; asking for both is an error."""
    if head is not None and tail is not None:
        raise ValueError("head and tail cannot be combined")
    if head is None and tail is None:
        return files
    if head is not None:
        # One limited split: the rest of a long file is not cut into lines.
        if head <= 0:
            return files.withColumn("content", F.lit(""))
        return files.withColumn("content", F.substring_index("content", "\n", head))
    if tail <= 0:
        return files.withColumn("content", F.lit(""))
    return files.withColumn("content", F.substring_index("content", "\n", -tail))


def number_lines(files: DataFrame) -> DataFrame:
    """Content with ``N: `` before every line; empty content stays empty."""
    numbered = F.transform(
        lf_lines(), lambda t, i: F.concat((i + 1).cast("string"), F.lit(": "), t)
    )
    return files.withColumn(
        "content",
        F.when(F.col("content") == "", F.lit("")).otherwise(F.array_join(numbered, "\n")),
    )


def with_file_id(files: DataFrame) -> DataFrame:
    return files.withColumn("file_id", file_id())
