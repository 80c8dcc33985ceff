"""Text and number functions with the data model's semantics, as Column expressions.

White space is the 29 code points of Unicode's str.isspace, spelled out so that every regex engine agrees.
Comparisons are made in doubles. A missing value is NULL and compares as false, never as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white-space class, for Java and RE2 alike.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same code points as one string, for functions that take a set of characters instead of a regex.
WS_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Line ends as str.splitlines sees them.
LINE_END = r"\r\n|[\n\x{b}\x{c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def compact(value: Column | str) -> Column:
    """The text without white space; NULL is the empty text."""
    return F.translate(F.coalesce(_col(value), F.lit("")), WS_CHARS, "")


def normalized(value: Column | str) -> Column:
    """The compact text in lower case, for names."""
    return F.lower(compact(value))


def normalize_name(value: str | None) -> str:
    """``normalized`` for a constant on the driver."""
    return "".join((value or "").split()).lower()


def strip(value: Column | str) -> Column:
    """The text without white space at either end (NULL stays)."""
    return F.btrim(_col(value), F.lit(WS_CHARS))


def close(expected: Column, actual: Column, tolerance: float = 0.5) -> Column:
    """Both numbers are there and differ by at most the tolerance, in doubles."""
    return F.coalesce(F.abs(expected.cast("double") - actual.cast("double")) <= F.lit(float(tolerance)), F.lit(False))


def starts_with_pattern(value: Column | str, pattern: str) -> Column:
    """The pattern matches at the start of the text."""
    return _col(value).rlike(f"^(?:{pattern})")


def rounded(value: Column, digits: int = 2) -> Column:
    """Half-even rounding; off binary ties by at most one unit of the last digit."""
    return F.bround(value.cast("double"), digits)


def number_text(value: Column) -> Column:
    """A double as text, NULL as ``None``."""
    return F.coalesce(value.cast("double").cast("string"), F.lit("None"))


def preview(value: Column | str, length: int) -> Column:
    return F.substring(_col(value), 1, length)


def line_count(value: Column | str) -> Column:
    """Lines of a text; a line end at the very end opens none."""
    text = F.coalesce(_col(value), F.lit(""))
    parts = F.split(text, LINE_END)
    return F.when(text == "", F.lit(0)).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def lines(value: Column | str) -> Column:
    """Lines of a text, as an array in order, without their ends."""
    whole = F.split(F.coalesce(_col(value), F.lit("")), LINE_END)
    # the split is bound once: an array of one, transformed
    return F.get(F.transform(F.array(whole), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)), F.lit(0))


def heading_level(line: Column | str) -> Column:
    """1 to 6 for a Markdown heading, else NULL."""
    hashes = F.regexp_extract(_col(line), f"^(#{{1,6}}){WS}+(.+?){WS}*$", 1)
    return F.when(hashes != "", F.length(hashes))


def heading_text(line: Column | str) -> Column:
    return F.when(heading_level(line).isNotNull(), F.regexp_extract(_col(line), f"^(#{{1,6}}){WS}+(.+?){WS}*$", 2))


def page_range(spec: Column, total: Column) -> Column:
    """0-based pages of a text such as ``1-5,8``: clamped, in order, each once. Parts that are no numbers are skipped."""
    parts = F.transform(F.split(spec, ","), lambda p: F.transform(F.split(strip(p), "-"), lambda x: strip(x).try_cast("int")))

    def pages(p: Column) -> Column:
        first = F.greatest(F.lit(1), F.get(p, F.lit(0)))
        last = F.least(total, F.get(p, F.size(p) - 1))
        whole = F.get(p, F.lit(0)).isNotNull() & F.get(p, F.size(p) - 1).isNotNull() & (first <= last)
        single = (F.size(p) == 1) & ((F.get(p, F.lit(0)) < 1) | (F.get(p, F.lit(0)) > total))
        return F.when(whole & ~single, F.sequence(first - 1, last - 1)).otherwise(F.array().cast("array<int>"))

    every = F.sequence(F.lit(0), total - 1)
    picked = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
    return F.when(total < 1, F.array().cast("array<int>")).when(spec.isNull(), every).otherwise(picked)


def bounded_id(value: Column, base: int, limit: int) -> Column:
    """Whether an identifier in the base (10 or 16) lies under the limit, whatever its leading zeros; NULL if it is no number."""
    digits = "[0-9]" if base == 10 else "[0-9A-Fa-f]"
    plain = F.regexp_replace(value, "^0+(?=.)", "")
    small = F.length(plain) <= (18 if base == 10 else 15)
    number = plain.try_cast("bigint") if base == 10 else F.conv(plain, 16, 10).try_cast("bigint")
    return F.when(value.rlike(f"^{digits}+$"), F.when(small, number < F.lit(limit)).otherwise(F.lit(False)))
