"""Scanning source trees and decoding their bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.operators.inventory import encoding_label, eligibility, looks_binary


def scan_files(
    spark: SparkSession, root: str, glob: str | None = None, eligible_only: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """``(root, path, size_bytes, modified_at, raw)`` of every file below ``root``.

    The bytes are a column of their own: plans that do not use ``raw`` never
    open the files. Files above ``max_bytes``, where given, are listed without
    bytes; the length test is pushed into the reader, so they are never opened.
    ``eligible_only`` drops what the eligibility ladder drops.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    folder = base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")
    at = F.instr("_p", folder + "/")

    def listed(rows: DataFrame, raw) -> DataFrame:
        return rows.select(
            F.lit(base).alias("root"),
            F.col("path").alias("_p"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
            raw.alias("raw"),
        )

    tree = reader.load(base)
    if max_bytes is None:
        found = listed(tree, F.col("content"))
    else:
        found = listed(tree.filter(F.col("length") <= max_bytes), F.col("content")).unionByName(
            listed(tree.filter(F.col("length") > max_bytes), F.lit(None).cast("binary"))
        )
    files = found.select(
        "root",
        F.substring("_p", at + len(folder) + 1, F.length("_p")).alias("path"),
        "size_bytes", "modified_at", "raw",
    )
    if eligible_only:
        files = files.filter(eligibility(is_binary=looks_binary()) == "Eligible")
    return files


@F.pandas_udf(T.StringType())
def _utf16(raw: pd.Series, codec: pd.Series) -> pd.Series:
    """Bytes after the BOM; broken code units become U+FFFD instead of an error."""
    return pd.Series(
        [
            None if b is None or c is None else bytes(b[2:]).decode(c, "replace")
            for b, c in zip(raw, codec)
        ],
        dtype="object",
    )


def decode_content(files_raw: DataFrame) -> DataFrame:
    """Adds ``content`` and ``encoding`` by byte-order mark, UTF-8 by default.

    Only bytes with a UTF-16 mark are decoded in Python, because ``decode`` fails
    the job on a broken code unit; of other rows a null is sent there.
    """
    label = encoding_label()
    rows = files_raw.withColumn(
        "encoding", F.when(label == "utf-32", "utf-8").otherwise(label)
    )
    wide = F.col("encoding").startswith("utf-16")
    codec = F.when(F.col("encoding") == "utf-16-le", "utf-16-le").when(
        F.col("encoding") == "utf-16-be", "utf-16-be"
    )
    rows = rows.withColumn("_wide", _utf16(F.when(wide, F.col("raw")), codec))
    body = F.when(
        F.col("encoding") == "utf-8-bom", F.expr("substring(raw, 4)")
    ).otherwise(F.col("raw"))
    return rows.withColumn(
        "content",
        F.when(wide, F.col("_wide")).otherwise(F.make_valid_utf8(body.cast("string"))),
    ).drop("_wide")
