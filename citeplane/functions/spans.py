"""Span functions: fragments, hulls, overlap of intervals, id lists, single values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fragments_error(start: Column, end: Column, fragments: Column) -> Column:
    """Why fragments (array of struct start, end) are no canonical discontinuous span; null if they are, or there are none."""
    n = F.size(fragments)
    empty = F.exists(fragments, lambda f: f["end"] <= f["start"])
    gaps = F.zip_with(F.slice(fragments, 1, F.greatest(n - 1, F.lit(0))), F.slice(fragments, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b["start"] <= a["end"])
    hull = (F.element_at(fragments, 1)["start"] != start) | (F.element_at(fragments, -1)["end"] != end)
    return (
        F.when(fragments.isNull() | (n <= 0), F.lit(None).cast("string"))
        .when(n == 1, "single_fragment")
        .when(empty, "empty_fragment")
        .when(F.exists(gaps, lambda x: x), "unordered_fragments")
        .when(hull, "not_the_hull")
    )


def pieces(start: Column, end: Column, fragments: Column) -> Column:
    """The fragments of a span, or its hull."""
    hull = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
    return F.when(F.coalesce(F.size(fragments), F.lit(0)) > 0, fragments.cast("array<struct<start:bigint,end:bigint>>")).otherwise(hull)


def overlap(a: Column, b: Column) -> Column:
    """Whether any interval of one array overlaps any of the other; touching is no overlap."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def excluded(start: Column, end: Column, intervals: Column) -> Column:
    """Whether a span overlaps an excluded interval."""
    return F.exists(intervals, lambda x: (start < x["end"]) & (x["start"] < end))


def well_formed(intervals: Column, length: Column) -> Column:
    """Excluded intervals are in range, nonempty, sorted and without overlap."""
    n = F.size(intervals)
    inside = F.forall(intervals, lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= length))
    later = F.zip_with(F.slice(intervals, 1, F.greatest(n - 1, F.lit(0))), F.slice(intervals, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b["start"] >= a["end"])
    return inside & F.forall(later, lambda x: x)


def distinct_ids(ids: Column) -> Column:
    """Ids are nonblank and none is repeated."""
    return (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda x: F.length(F.trim(x)) > 0)


def permitted(value: Column, values: Column) -> Column:
    """Membership with the type: value and values are struct(type, value)."""
    return F.exists(values, lambda x: (x["type"] == value["type"]) & x["value"].eqNullSafe(value["value"]))


def single(values: Column) -> Column:
    """The only value of an array, else null."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))
