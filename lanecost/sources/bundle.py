"""Marts published together: all of a bundle become visible at one moment, or none.

A bundle is written to a folder of its own below `runs`, mart by mart. Its manifest, one small file below `manifests`,
is written last and names the marts, their places, schemas and row counts. Readers take the newest manifest and nothing
else, so a run that fails half way leaves the bundle before it in place, and what a reader has begun to read is not
overwritten by the next run. `prune` removes old bundles.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import LoadError

MANIFEST = "number bigint, run_id string, published_at string, mart string, place string, columns string, n_rows bigint"


@dataclass(frozen=True)
class Mart:
    place: str
    columns: StructType
    n_rows: int


@dataclass(frozen=True)
class Bundle:
    """A published bundle: its number (1 for the first), the run that wrote it, and its marts by name."""

    number: int
    run_id: str
    published_at: str
    marts: dict[str, Mart]


def bundles(spark: SparkSession, path: str) -> list[Bundle]:
    """All published bundles, the newest first. One row for each mart of each bundle is read on the driver."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found: dict[tuple[int, str], Bundle] = {}
    for r in rows:
        key = (r["number"], r["run_id"])
        bundle = found.setdefault(key, Bundle(*key, r["published_at"], {}))
        bundle.marts[r["mart"]] = Mart(r["place"], StructType.fromJson(json.loads(r["columns"])), r["n_rows"])
    return [found[key] for key in sorted(found, reverse=True)]


def current(spark: SparkSession, path: str) -> Bundle:
    newest = bundles(spark, path)
    if not newest:
        raise LoadError(f"Error loading data: no bundle of marts is published under {path}")
    return newest[0]


def publish(marts: Mapping[str, DataFrame], path: str) -> Bundle:
    """Write the marts and then their manifest; the bundle is current from then on.

    Marts may be derived from the bundle that is current while this runs. Of two runs at the same time, each publishes a
    whole bundle; the one of the larger (number, run_id) is current afterwards.
    """
    if not marts:
        raise ValueError("a bundle needs a mart")
    spark = next(iter(marts.values())).sparkSession
    before = bundles(spark, path)
    run_id, number = uuid.uuid4().hex, 1 + (before[0].number if before else 0)
    rows = []
    for name, df in marts.items():
        seen = Observation(f"{name}_{run_id}")
        place = f"runs/{run_id}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{place}")
        rows.append((name, place, df.schema.json(), seen.get["rows"]))
    at = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    manifest = spark.createDataFrame([(number, run_id, at, *r) for r in rows], MANIFEST)
    manifest.coalesce(1).write.parquet(f"{path}/manifests/{run_id}")
    return Bundle(number, run_id, at, {n: Mart(p, marts[n].schema, k) for n, p, _, k in rows})


def read(spark: SparkSession, path: str, names: Iterable[str] | None = None, bundle: Bundle | None = None) -> dict[str, DataFrame]:
    """The marts of the current bundle, or of a given one. All come from one run, whatever is published meanwhile."""
    bundle = current(spark, path) if bundle is None else bundle
    names = list(bundle.marts if names is None else names)
    if missing := [n for n in names if n not in bundle.marts]:
        raise LoadError(f"Error loading data: the bundle lacks marts: {', '.join(missing)}")
    return {n: spark.read.schema(bundle.marts[n].columns).parquet(f"{path}/{bundle.marts[n].place}") for n in names}


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all bundles but the newest `keep`, manifests first, and return their run ids.

    Keep as many as readers may still be reading. Folders of runs that published nothing are left alone, as they may
    belong to a run that is still writing.
    """
    if keep < 1:
        raise ValueError("at least the current bundle stays")
    old = bundles(spark, path)[keep:]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in [f"manifests/{b.run_id}" for b in old] + [f"runs/{b.run_id}" for b in old]:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        place.getFileSystem(conf).delete(place, True)
    return [b.run_id for b in old]
