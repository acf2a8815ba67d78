"""Joins of the big order table with reference tables.

Spark chooses how each join runs from the size of the table that is joined: a small one is broadcast, a large one
is shuffled, and adaptive execution then splits the partitions of hot keys. No job runs while a query is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame


def match(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of key pairs in which a missing key matches a missing key."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def lookup(
    big: DataFrame,
    reference: DataFrame,
    pairs: Sequence[tuple[str, str]],
    *,
    how: str = "inner",
    also=None,
) -> DataFrame:
    """Join big with a reference table and drop the reference's key columns.

    `also` builds a further condition from the two frames, from columns that are no keys of the reference.
    """
    # keys under names of their own, as several references of one join may come from the same table
    names = {b: f"_{i}_{b}" for i, (_, b) in enumerate(pairs)}
    reference = reference.withColumnsRenamed(names)
    on = match(big, reference, [(a, names[b]) for a, b in pairs])
    if also is not None:
        on = on & also(big, reference)
    return big.join(reference, on, how).drop(*names.values())
