"""Pages with the bounds and fields of a paged answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.skew import first_rows


def page_bounds(page: int, size: int) -> tuple[int, int]:
    if page < 1 or size < 1:
        raise ValueError("pages and page sizes count from 1")
    return page, size


def paginate(
    df: DataFrame, order: list, page: int = 1, size: int = fv.DEFAULT_PAGE_SIZE
) -> DataFrame:
    """One page of the ordered rows; pages count from 1.

    Offset and page go through one task, so deep pages cost what they skip;
    ``paginate_after`` starts at a key instead.
    """
    page, size = page_bounds(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def paginate_after(
    df: DataFrame, keys: list[str], after: tuple | None = None, size: int = fv.DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The page after the key values ``after`` in ascending order of ``keys``.

    The range test is pushed to the scan; no row before the page is sorted.
    """
    page_bounds(1, size)
    if after is not None:
        beyond = F.lit(False)
        for i, value in reversed(list(enumerate(after))):
            beyond = (F.col(keys[i]) > value) | ((F.col(keys[i]) == value) & beyond)
        df = df.filter(beyond)
    return df.orderBy(*keys).limit(size)


def page_info(df: DataFrame, page: int = 1, size: int = fv.DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: total, page, size, has_more."""
    page, size = page_bounds(page, size)
    return df.agg(F.count(F.lit(1)).alias("total_items")).select(
        "total_items", F.lit(page).alias("page"), F.lit(size).alias("page_size"),
        (F.col("total_items") > page * size).alias("has_more"),
    )


def paginate_groups(
    df: DataFrame, keys: list[str], order: list, page: int = 1,
    size: int = fv.DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """The same page within every group."""
    page, size = page_bounds(page, size)
    return first_rows(df, keys, order, page * size).filter(F.col("rank") > (page - 1) * size)
