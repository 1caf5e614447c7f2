"""Linear-cost array expressions for per-file work that needs no shuffle.

A file is one row, so scans over its lines stay inside the row. Spark's
higher-order functions have no prefix sum and no early exit; both are rebuilt
here on blocks so the cost stays near linear in the number of lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def blocks(arr: Column, size: int = BLOCK) -> Column:
    """Cuts an array into consecutive pieces of ``size`` elements."""
    count = F.ceil(F.size(arr) / F.lit(size)).cast("int")
    return F.when(F.size(arr) == 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
            lambda b: F.slice(arr, b * size + 1, F.lit(size)),
        )
    )


def block_minima(arr: Column) -> Column:
    return F.transform(blocks(arr), lambda b: F.array_min(b))


def _prefix(values: Column, start: Column) -> Column:
    """Inclusive running sums of a short array, shifted by ``start``."""
    return F.aggregate(
        values,
        F.array().cast("array<int>"),
        lambda acc, v: F.concat(
            acc,
            F.array(
                (v + F.coalesce(F.try_element_at(acc, F.lit(-1)), start)).cast("int")
            ),
        ),
    )


def running_sum(block_arr: Column) -> Column:
    """Inclusive prefix sum of an int array given as ``blocks(arr)``.

    Arrays are only ever grown up to one block (or one entry per block), so the
    copying that ``aggregate`` does is O(n * block) instead of O(n * n).
    """
    zero = F.lit(0).cast("int")
    totals = F.transform(
        block_arr, lambda b: F.aggregate(b, zero, lambda a, v: (a + v).cast("int"))
    )
    ends = _prefix(totals, zero)
    return F.flatten(
        F.transform(
            F.arrays_zip(block_arr.alias("b"), ends.alias("e"), totals.alias("t")),
            lambda z: _prefix(z["b"], z["e"] - z["t"]),
        )
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_at_most(arr: Column, minima: Column | list[Column], start: Column, limit: Column) -> Column:
    """1-based index of the first element at or after ``start`` that is <= limit.

    ``minima`` are the block minima of ``arr``, or a list of levels, each the
    block minima of the one before. A probe searches one block of each level and
    the rest of the last, so with two levels it costs n/4096 + 4*BLOCK steps.
    """
    levels = [arr, *(minima if isinstance(minima, list) else [minima])]

    def search(level: int, start: Column) -> Column:
        def inside(first: Column, count: Column) -> Column:
            at = F.array_position(F.transform(F.slice(levels[level], first, count), lambda v: v <= limit), True)
            return let(at.cast("int"), lambda p: F.when(p > 0, first + p - 1))

        if level == len(levels) - 1:
            return inside(start, F.greatest(F.size(levels[level]), F.lit(1)))
        block = F.floor((start - 1) / F.lit(BLOCK)).cast("int")
        here = let(block, lambda b: inside(start, (b + 1) * BLOCK - start + 1))
        later = let(
            search(level + 1, block + 2),
            lambda b: F.when(b.isNotNull(), inside((b - 1) * BLOCK + 1, F.lit(BLOCK))),
        )
        return F.coalesce(here, later)

    return let(start, lambda s: search(0, s))


def fold(items: Column, state: Column, step: Callable[[Column, Column], Column], emitted: str) -> Column:
    """One value per item, in order, with a state carried from item to item.

    ``step(state, item)`` gives a struct of ``state`` and ``value``, of the types
    of ``state`` and ``emitted``. The values of a block of items are gathered
    before they are joined, so the copying that ``aggregate`` does stays small:
    n * BLOCK / 2 values and (n / BLOCK)^2 / 2 blocks.
    """
    def pieces(whole: Column) -> Column:
        count = F.ceil(F.size(whole) / F.lit(BLOCK)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(whole, b * BLOCK + 1, F.lit(BLOCK))
        )

    def within(before: Column, piece: Column) -> Column:
        return F.aggregate(
            piece,
            F.struct(before.alias("state"), F.array().cast(f"array<{emitted}>").alias("values")),
            lambda acc, x: let(
                step(acc["state"], x),
                lambda r: F.struct(
                    r["state"].alias("state"), F.concat(acc["values"], F.array(r["value"].cast(emitted))).alias("values")
                ),
            ),
        )

    folded = F.aggregate(
        let(items, pieces),
        F.struct(state.alias("state"), F.array().cast(f"array<array<{emitted}>>").alias("values")),
        lambda acc, piece: let(
            within(acc["state"], piece),
            lambda r: F.struct(r["state"].alias("state"), F.concat(acc["values"], F.array(r["values"])).alias("values")),
        ),
    )
    return F.flatten(folded["values"])
