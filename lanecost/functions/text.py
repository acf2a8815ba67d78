"""Labels and display text, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col

ARROW = " → "


def number_text(c: Column | str) -> Column:
    """A number as short text: 250 rather than 250.0, 99.99 unchanged."""
    return F.regexp_replace(col(c).cast("string"), r"\.0$", "")


def band_text(low: Column | str, high: Column | str) -> Column:
    """Weight-band text such as '100 - 249.99 kg'; a missing bound reads NA."""
    low, high = (F.coalesce(number_text(c), F.lit("NA")) for c in (low, high))
    return F.concat(low, F.lit(" - "), high, F.lit(" kg"))


def replace_first(c: Column | str, old: str, new: str) -> Column:
    """Replace only the first occurrence of a literal."""
    return F.regexp_replace(col(c), "(?s)^(.*?)" + re.escape(old), "$1" + new)


def band_label(c: Column | str) -> Column:
    """Band text without its unit and outer blanks."""
    return F.trim(replace_first(c, " kg", ""))


def port_to_plant(c: Column | str) -> Column:
    return replace_first(c, "PORT", "PLANT")


def title(c: Column | str) -> Column:
    """'unit_cost' as 'Unit Cost'; only the first underscore becomes a blank."""
    return F.initcap(replace_first(c, "_", " "))


def route_text(origin: Column | str, destination: Column | str) -> Column:
    return F.concat(col(origin), F.lit(ARROW), col(destination))


def snapped(c: Column | str) -> Column:
    """The number without the noise of summation order, so that a half always rounds the same way."""
    return F.round(col(c), 6)


def fixed_text(c: Column | str, decimals: int) -> Column:
    """Rounded half-even, with thousands separators and a fixed number of decimals."""
    return F.format_number(F.bround(snapped(c), decimals), decimals)


def comma_text(c: Column | str) -> Column:
    return fixed_text(c, 0)


def dollar_text(c: Column | str, decimals: int = 2) -> Column:
    c = col(c)
    sign = F.when(c < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(sign, fixed_text(F.abs(c), decimals))


def dollar_text_auto(c: Column | str) -> Column:
    """Dollars with cents only for fractional amounts below 100,000."""
    c = snapped(c)
    cents = (F.abs(c) < 100000) & (c != F.floor(c))
    return F.when(cents, dollar_text(c, 2)).otherwise(dollar_text(c, 0))


def percent_text(c: Column | str) -> Column:
    """A percentage rounded half-even to one decimal, e.g. '33.3%' or '50%', never with an exponent."""
    digits = F.bround(snapped(c), 1).cast("decimal(38,1)").cast("string")
    return F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit("%"))


def share_text(c: Column | str) -> Column:
    """A share of 1 as a percentage with one decimal, e.g. '75.0%'."""
    return F.concat(fixed_text(col(c) * 100, 1), F.lit("%"))
