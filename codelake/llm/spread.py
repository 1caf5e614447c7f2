"""Spark helpers of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def plain(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, even if ``df`` has other columns that clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap of the low bits of a bigint column, built by Spark.

    Its size is ``2**bits`` bits whatever the table's size, which bounds what
    reaches the driver. Rows that miss it are surely absent from the table.
    """
    words = 1 << (bits - 6)
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        df.where(F.col(key).isNotNull())
        .groupBy(F.shiftrightunsigned(slot, 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
        .toArrow()
    )
    out = np.zeros(words, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def small_or_spread(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, right_bytes: int, spread: str
) -> DataFrame:
    """Joins a table to a lookup table: broadcast if its measured size allows, else shuffled.

    In the shuffled form the rows of every key of ``left`` are spread over 16
    salts by the bigint column ``spread``, and the lookup rows are repeated as
    often, so that one key may hold a third of all rows.
    """
    if right_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    salts = 16
    left = left.withColumn("_salt", F.pmod(F.col(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
