"""Missing-value rules of the data model, as Spark columns.

Spark aggregates skip nulls; several measures here must instead become null as soon as one input is
null ("strict"), and others must be 0 when nothing is left to add ("lenient").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict(agg: Callable[[Column], Column], c: Column | str) -> Column:
    """Aggregate that is null when any input row is null."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def strict_sum(c: Column | str) -> Column:
    """Sum that is null when any input row is null, and 0 over no rows."""
    return strict(lambda x: F.coalesce(F.sum(x), F.lit(0.0)), c)


def strict_mean(c: Column | str) -> Column:
    return strict(F.avg, c)


def lenient_sum(c: Column | str) -> Column:
    """Sum that ignores nulls and is 0 when nothing is left."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 (there is no infinite or not-a-number result)."""
    return F.try_divide(col(a), col(b))


def percent(a: Column | str, b: Column | str) -> Column:
    return ratio(a, b) * 100


def both_greatest(a: Column | str, b: Column | str) -> Column:
    """The larger value, null when either is null."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that stays null when the condition is null."""
    return F.when(condition, yes).when(~condition, no)


def fails(rule: Column) -> Column:
    """True where a rule does not hold; a null counts as not holding."""
    return ~F.coalesce(rule, F.lit(False))
