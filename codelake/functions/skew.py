"""Joins and ranked caps that hold up when one key owns a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 100_000
HOT_KEYS = 1_000
SALTS = 64


def _some_null(keys: list[str]) -> Column:
    return F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))


def hot_keys(left: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The most frequent keys above ``hot_rows``.

    At most ``HOT_KEYS`` rows come out whatever the input, which is what makes
    the broadcast in ``lookup_join`` safe. A key that misses the list is joined
    unsalted, so the bound never changes a result; as ``HOT_KEYS`` keys have at
    least as many rows, it holds less than one row in ``HOT_KEYS``.
    """
    return (
        left.where(~_some_null(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"))
        .limit(HOT_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark itself would broadcast ``df``, by its own size estimate."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    spread: Column | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Joins many left rows to a lookup table with salt on the hot left keys.

    A lookup table that Spark estimates below its broadcast threshold is left
    to Spark: no shuffle, so no skew. Otherwise, rows of a hot key are spread over
    ``SALTS`` tasks and the matching lookup rows are repeated as often; every other
    key is shuffled once, unsalted. Rows with a null key meet nothing, so they are
    spread as well, with no lookup rows for them.
    ``counted`` names the frame to count keys on when ``left`` is itself the
    result of a join, so that the join is not run again for the counts.
    """
    if fits_broadcast(right):
        return left.join(right, keys, how)
    return _salted_join(left, right, keys, how, hot_keys(left if counted is None else counted, keys, hot_rows), spread)


def _salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame, spread: Column | None,
    hint: str | None = None,
) -> DataFrame:
    """Rows of the keys ``hot(..., _hot)`` are spread on the left and repeated on the right."""
    hot = F.broadcast(hot)
    spread = spread if spread is not None else F.xxhash64(*[F.col(c) for c in left.columns])
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.coalesce("_hot", _some_null(keys)), F.pmod(spread, F.lit(SALTS))).otherwise(F.lit(0)).cast("int"),
    ).drop("_hot")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    ).drop("_hot")
    salted_right = salted_right.hint(hint) if hint else salted_right
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


REQUEST_ROWS = 100_000
REQUEST_BYTES = 32 << 20


def request_join(
    left: DataFrame, requests: DataFrame, keys: list[str], spread: Column | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner join of a corpus to a table of requests.

    The rows and bytes of the request table are counted first, up to a bound.
    Within the bound it is broadcast and the corpus is not shuffled at all.
    Beyond it the join is a sort-merge join whatever Spark estimates: its size
    estimate knows nothing of the repeated requests, and a broadcast passes the
    driver. All left rows are salted, as counting the keys of a whole corpus would
    cost a second pass; where ``counted`` names a frame that is cheap to count
    keys on, only the hot ones are.
    """
    written = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in requests.columns])))
    size = requests.limit(REQUEST_ROWS + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(written), F.lit(0)).alias("bytes")).first()
    if size["rows"] <= REQUEST_ROWS and size["bytes"] <= REQUEST_BYTES:
        return left.join(F.broadcast(requests), keys)
    if counted is not None:
        return _salted_join(left, requests, keys, "inner", hot_keys(counted, keys), spread, "merge")
    spread = spread if spread is not None else F.xxhash64(*[F.col(c) for c in left.columns])
    salts = 16
    repeated = requests.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int")).join(
        repeated.hint("merge"), [*keys, "_salt"]
    ).drop("_salt")


def first_rows(df: DataFrame, keys: list, order: list, n: int | None, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key, all of them where ``n`` is null.

    Spark turns the rank filter into a per-task group limit before the shuffle,
    so a hot key ships at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)
