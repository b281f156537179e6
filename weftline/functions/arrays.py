"""Array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text


def distinct_ignoring_case(a: Column) -> Column:
    """The first of values that differ in case only, in order."""
    low = F.transform(a, F.lower)
    return F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def join_names(a: Column) -> Column:
    """A; A and B; A, B, and C."""
    n = F.size(a)
    longer = F.concat(F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(a, F.lit(-1)))
    return F.when(n == 0, F.lit("")).when(n <= 2, F.array_join(a, " and ")).otherwise(longer)


def split_hint(c: Column) -> Column:
    """Cleaned, non-blank lines of a multi-valued hint."""
    return F.filter(F.transform(F.split(c, "\n"), clean_text), lambda x: x != "")


def first_wins(first: Column, second: Column) -> Column:
    """Both maps' entries, the first's where keys meet."""
    return F.map_concat(first, F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)))


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def first_source(candidates: list[tuple[str, Column]]) -> Column:
    """struct(value, source) of the first candidate that is neither null nor empty."""
    return F.coalesce(*[F.when(v.isNotNull() & (v != ""), F.struct(v.alias("value"), F.lit(name).alias("source"))) for name, v in candidates])


def provenance(fields: dict[str, Column]) -> Column:
    """Map of field to winning source, without fields that have none."""
    entries = [x for k, v in fields.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())
