"""Expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256  # lines whose offsets are added at once, so that no long array grows line by line


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used
    (what stands in a lambda is otherwise worked out for each element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column, base: Column) -> Column:
    return F.aggregate(sizes, F.array(base).cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def offsets(sizes: Column) -> Column:
    """array<bigint>: the sum of what stands before each of the ``sizes``."""

    def blocks(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(own) / _BLOCK).cast("int") - 1)), lambda b: F.slice(own, b * _BLOCK + 1, F.lit(_BLOCK)))

    def added(cut: Column) -> Column:
        sums = _running(F.transform(cut, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: acc + x)), F.lit(0).cast("bigint"))
        return let(sums, lambda s: F.flatten(F.transform(cut, lambda b, k: F.slice(_running(b, F.get(s, k)), F.lit(1), F.size(b)))))

    return let(sizes, lambda own: let(blocks(own), added))
