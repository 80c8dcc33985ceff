"""Font sizes and font names in format specifications, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import WS, compact

#: Traditional Chinese size names in points.
NAMED_SIZES = {
    "初号": 42.0,
    "小初": 36.0,
    "一号": 26.0,
    "小一": 24.0,
    "二号": 22.0,
    "小二": 18.0,
    "三号": 16.0,
    "小三": 15.0,
    "四号": 14.0,
    "小四": 12.0,
    "五号": 10.5,
    "小五": 9.0,
    "六号": 7.5,
    "小六": 6.5,
    "七号": 5.5,
    "八号": 5.0,
}
#: Font names that a specification may give.
CHINESE_FONTS = ("宋体", "黑体", "楷体", "仿宋", "华文宋体", "华文黑体", "华文楷体", "华文仿宋")
WESTERN_FONTS = ("Times New Roman", "Arial", "Calibri", "Helvetica", "Georgia", "Verdana")

#: The order in which names are looked for: the small sizes first.
SIZE_ORDER = [n for n in NAMED_SIZES if n[0] == "小"] + [n for n in NAMED_SIZES if n[0] != "小"]


def explicit_points(value: Column | str) -> Column:
    """Numbers followed by ``pt``, as doubles in order."""
    text = F.col(value) if isinstance(value, str) else value
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)([0-9]+(?:\.[0-9]+)?){WS}*pt"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def _named(text: Column, name: str) -> Column:
    """Whether a size name stands in a compact text, outside the first place of its small namesake."""
    if name[0] == "小" or "小" + name[0] not in NAMED_SIZES:
        return F.contains(text, F.lit(name))
    return F.contains(F.regexp_replace(text, f"(?s)^(.*?)小{name[0]}号?", "$1#"), F.lit(name))


def named_sizes(value: Column | str) -> Column:
    """Array of (name, pt) of the size names in a text, each at most once, in SIZE_ORDER."""
    text = compact(value)
    hits = [F.when(_named(text, n), F.struct(F.lit(n).alias("name"), F.lit(NAMED_SIZES[n]).alias("pt"))) for n in SIZE_ORDER]
    return F.array_compact(F.array(*hits))


def size_signals(value: Column | str, tolerance: float = 0.2) -> Column:
    """struct(named, explicit, conflicts, resolved): what a line says about a font size, and whether it agrees.

    explicit: the different numbers, sorted. conflicts: codes of several different names' sizes, several different
    numbers, and names against numbers (the least of each). resolved: without a conflict the number, else the name's size.
    """
    named, explicit = named_sizes(value), explicit_points(value)
    name_pts = F.sort_array(F.array_distinct(F.transform(named, lambda x: x["pt"])))
    pts = F.sort_array(F.array_distinct(explicit))
    first_name, first_point = F.get(name_pts, F.lit(0)), F.get(pts, F.lit(0))
    apart = F.coalesce(F.abs(first_name - first_point) > F.lit(float(tolerance)), F.lit(False))
    codes = [(F.size(name_pts) > 1, "several_named_sizes"), (F.size(pts) > 1, "several_explicit_sizes"), (apart, "named_and_explicit_differ")]
    conflicts = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in codes]))
    return F.struct(named.alias("named"), pts.alias("explicit"), conflicts.alias("conflicts"), F.when(F.size(conflicts) == 0, F.coalesce(first_point, first_name)).alias("resolved"))
