"""Running values over long arrays and pieces of long texts, as SQL expressions whose work grows in proportion.

An array that is grown one by one inside an aggregate is copied at every step, and a substring is found by counting
from the start of the text. Both are kept to short stretches here: values run inside chunks first, then over the
chunks, and a text is cut into blocks of code points once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grown(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running values of a short array of bigint."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(values, none, lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(join(F.element_at(a, -1), x)))))


def _chunks(values: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK))
    return F.transform(starts, lambda k: F.slice(values, k + 1, F.lit(CHUNK)))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For an array of bigint, ``join`` of each element with all before it (a sum, or the greatest)."""

    def over(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.element_at(c, -1))
        return let(_long(ends, join), lambda whole: F.flatten(F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda x: join(F.get(whole, i - 1), x))))))

    some = let(F.transform(_chunks(values), lambda c: _grown(c, join)), over)
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(some)


def _long(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The same over the ends of the chunks, chunk by chunk once more: three levels hold 16 million values in short stretches."""

    def over(chunks: Column) -> Column:
        ends = _grown(F.transform(chunks, lambda c: F.element_at(c, -1)), join)
        return let(ends, lambda whole: F.flatten(F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda x: join(F.get(whole, i - 1), x))))))

    return let(F.transform(_chunks(values), lambda c: _grown(c, join)), over)


def sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def greatest(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def blocks(text: Column) -> Column:
    """A text as an array of pieces of BLOCK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of the text that ``cut`` holds in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    inside = F.array_join(F.slice(cut, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(inside, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")
