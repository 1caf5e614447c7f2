"""Carry-forward over long ordered row sequences.

A window over a whole dump would sort it in one task. Here the sequence is cut
into chunks of the order column; the carry into each chunk comes from a table
with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.storage import stored

CHUNK = 50_000


def carry_last(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Adds ``out``: the latest non-null ``value`` at or before each row.

    ``order`` is a unique whole number per key. The chunk table holds one row
    per ``chunk`` order values and is written, so the rows are read twice in
    all; its window is itself chunked once more.
    """
    parts = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk}"))
    heads = stored(
        parts.groupBy(*keys, "_chunk").agg(
            F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
        ),
        "chunks",
    )
    coarse = heads.withColumn("_super", F.expr(f"_chunk div {chunk}"))
    tops = coarse.groupBy(*keys, "_super").agg(
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_chunk"))).alias("_top")
    )
    before = Window.partitionBy(*keys).orderBy("_super").rowsBetween(
        Window.unboundedPreceding, -1
    )
    tops = tops.select(
        *keys, "_super", F.last("_top", ignorenulls=True).over(before).alias("_carry_top")
    )
    inside = Window.partitionBy(*keys, "_super").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carries = (
        coarse.withColumn("_in", F.last("_last", ignorenulls=True).over(inside))
        .join(tops, [*keys, "_super"])
        .select(*keys, "_chunk", F.coalesce("_in", "_carry_top").alias("_carry"))
    )
    upto = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        parts.join(carries, [*keys, "_chunk"])
        .withColumn(
            out, F.coalesce(F.last(value, ignorenulls=True).over(upto), F.col("_carry"))
        )
        .drop("_chunk", "_carry")
    )
