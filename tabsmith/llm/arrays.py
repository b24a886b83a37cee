"""Work along long arrays inside one row, in Spark expressions only.

An array that grows by one element at each step of an aggregation is copied at
each step, so a row of n elements costs n * n.  The helpers here work in blocks
of ``BLOCK`` elements: only a block grows step by step, then the blocks' totals
do, so a row of n elements costs n * BLOCK + (n / BLOCK) ** 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are worked on step by step.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def blocks(array: Column, size: int = BLOCK) -> Column:
    """``array`` in consecutive slices of ``size`` elements; an empty array gives no slice."""
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(array, i * size + 1, F.lit(size)))


def _steps(array: Column, join: Callable[[Column, Column], Column], first: Column) -> Column:
    return F.aggregate(array, first, lambda acc, x: F.concat(acc, F.array(
        join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x))))


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running results of ``join`` (sums; ``F.greatest`` for maxima) over an array of integers from 0 up."""
    none = F.array().cast("array<int>")

    def placed(own: Column) -> Column:
        totals = F.transform(own, lambda b: F.try_element_at(b, F.lit(-1)))
        return let(_steps(totals, join, F.array(F.lit(0))), lambda before: F.flatten(F.transform(
            own, lambda b, i: F.transform(b, lambda x: join(F.get(before, i), x)))))

    return let(values.cast("array<int>"), lambda a: let(
        F.transform(blocks(a), lambda b: _steps(b, join, none)), placed))


def texts_at(text: Column, spans: Column) -> Column:
    """The text under each span (start, stop in code points, stop exclusive).

    Spans come in order and do not overlap.  The text is walked once for a block
    of spans, then only the block's own stretch for each of them.
    """
    def of_block(text: Column, block: Column) -> Column:
        first = F.get(block, F.lit(0))["start"]
        stretch = text.substr(first + 1, F.try_element_at(block, F.lit(-1))["stop"] - first)
        return let(stretch, lambda s: F.transform(block, lambda x: s.substr(
            x["start"] - F.get(block, F.lit(0))["start"] + 1, x["stop"] - x["start"])))

    return let(text, lambda t: let(spans, lambda a: F.flatten(F.transform(blocks(a), lambda b: of_block(t, b)))))
