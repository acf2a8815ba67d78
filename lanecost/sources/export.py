"""CSV exports of summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import both_greatest, col


class ExportError(Exception):
    """The export was refused."""


def export_name(name: str, now: datetime, *, with_time: bool = False) -> str:
    """<name>_YYYYMMDD.csv, or <name>_YYYYMMDD_HHMMSS.csv."""
    return f"{name}_{now:%Y%m%d_%H%M%S}.csv" if with_time else f"{name}_{now:%Y%m%d}.csv"


def export_csv(df: DataFrame | None, path: str) -> None:
    """Write a non-empty frame as CSV with a header; missing values become empty fields.

    The path becomes a directory with one file per partition, as Spark writes it, and replaces an
    earlier export of the same name.
    """
    if df is None:
        raise ExportError("Export failed: there is no frame to write.")
    if not isinstance(df, DataFrame):
        raise ExportError("Export failed: this is not a frame.")
    # The plan runs once: the test for rows and the write share what it gave. An earlier export is replaced only
    # by one with rows.
    df = df.persist()
    try:
        if df.isEmpty():
            raise ExportError("Export failed: the filters left nothing.")
        _write(df, path, missing="")
    finally:
        df.unpersist()


def export_csv_plain(df: DataFrame, path: str) -> None:
    """Write without the guards; missing values become NA."""
    _write(df, path, missing="NA")


def _write(df: DataFrame, path: str, missing: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", missing).csv(path)


def validate_export_data(df: DataFrame, required_cols: list[str]) -> bool | str:
    """True, or the reason why the frame cannot be exported."""
    missing = [c for c in required_cols if c not in df.columns]
    if df.isEmpty():
        return "There is no row to export"
    if missing:
        return f"Required columns are not there: {', '.join(missing)}"
    return True


def stamp_export(df: DataFrame, filters: str, at: Column | None = None) -> DataFrame:
    """Add the export time and the filters that were applied."""
    at = F.current_timestamp() if at is None else at
    return df.withColumns({"timestamp": at, "filters_applied": F.lit(filters)})


def clip_negative_costs(df: DataFrame) -> DataFrame:
    """Columns whose name starts with "cost", negative values shown as 0; a null stays null."""
    costs = [c for c in df.columns if c.startswith("cost")]
    return df.withColumns({c: both_greatest(F.lit(0.0), col(c)) for c in costs})
