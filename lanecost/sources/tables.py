"""Load the four source tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import SCHEMAS


class LoadError(Exception):
    """A source table is missing or does not have the expected columns."""


@dataclass(frozen=True)
class SupplyTables:
    """The four source tables, lazily read."""

    order_list: DataFrame
    freight_rates: DataFrame
    wh_costs: DataFrame
    wh_capacities: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def snake(name: str) -> str:
    """A column or table name in lower snake case."""
    text = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower() or "x"
    return "x" + text if text[0].isdigit() else text


def snake_all(names: Iterable[str]) -> list[str]:
    """Snake-case names; a repeated name gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in map(snake, names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_all(df.columns))


def conform(df: DataFrame, schema: StructType, table: str) -> DataFrame:
    """Clean the column names and cast to the declared types; a missing column is an error."""
    df = clean_names(df)
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise LoadError(f"Error loading data: {table} lacks columns: {', '.join(missing)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def require_tables(present: Iterable[str]) -> None:
    missing = [t for t in SCHEMAS if t not in set(present)]
    if missing:
        raise LoadError(f"Error loading data: Missing required tables: {', '.join(missing)}")


def from_frames(frames: Mapping[str, DataFrame]) -> SupplyTables:
    """Tables from named DataFrames; names are cleaned first."""
    named = dict(zip(snake_all(frames), frames.values()))
    require_tables(named)
    return SupplyTables(**{t: conform(named[t], schema, t) for t, schema in SCHEMAS.items()})


def from_path(spark: SparkSession, path: str, fmt: str = "parquet") -> SupplyTables:
    """Tables from <path>/<table> or <path>/<table>.<fmt>, as Parquet, ORC or CSV with a header."""
    frames = {}
    for table in SCHEMAS:
        frames[table] = _read_table(spark, path, table, fmt)
    return from_frames(frames)


def _read_table(spark: SparkSession, path: str, table: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    for candidate in (f"{path}/{table}.{fmt}", f"{path}/{table}"):
        try:
            return reader.load(candidate)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise LoadError(f"Error loading data: Data file not found for {table} under {path}")


def from_catalog(spark: SparkSession, database: str) -> SupplyTables:
    """Tables registered in one database of the session catalog."""
    names = [t.name for t in spark.catalog.listTables(database)]
    by_clean_name = dict(zip(snake_all(names), names))
    require_tables(by_clean_name)
    return from_frames({t: spark.table(f"`{database}`.`{by_clean_name[t]}`") for t in SCHEMAS})
