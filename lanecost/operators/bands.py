"""Weight bands: fixed domain, clean text, sort order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import col
from ..functions.text import band_label
from ..sources.schemas import WEIGHT_BANDS


def band_position(c: Column | str) -> Column:
    """1-based position of a clean band in the fixed order, null outside the domain."""
    domain = F.array(*[F.lit(b) for b in WEIGHT_BANDS])
    return F.nullif(F.array_position(domain, col(c)), F.lit(0).cast("long")).cast("int")


def normalize_weight_bands(df: DataFrame, column: str = "weight_band") -> DataFrame:
    """Strip the unit and blanks from the band text and add <column>_ord for sorting."""
    return df.withColumn(column, band_label(column)).withColumn(f"{column}_ord", band_position(column))


def by_band_order(column: str = "weight_band") -> Column:
    return F.asc_nulls_last(f"{column}_ord")
