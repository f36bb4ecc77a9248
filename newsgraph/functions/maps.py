"""Literal lookups and small map expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def lookup(values: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(literal_map(values), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def weight_of(weights: Column, key: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(weights, F.lit(key) if isinstance(key, str) else key), F.lit(default))


def ranked_entries(weights: Column) -> Column:
    """Entries by weight descending, then name."""
    keyed = F.transform(
        F.map_entries(weights),
        lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("name"), e["value"].alias("weight")),
    )
    return F.array_sort(keyed)


def total(weights: Column) -> Column:
    """Sum of the values, added in key order so that equal maps give equal sums."""
    ordered = F.array_sort(F.map_entries(weights))
    return F.aggregate(ordered, F.lit(0.0), lambda acc, e: acc + e["value"])


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda acc, v: acc * v)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a lambda variable is never recomputed)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round_half_even(value: Column, places: int) -> Column:
    """Half-even rounding of the scaled double, as the check statements do."""
    scale = 10.0**places
    return F.rint(value * scale) / scale


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column as a one-element explode: filters and later columns that use it then read the
    value instead of getting a copy of the expression."""
    return df.withColumn(name, F.explode_outer(F.array(value)))
