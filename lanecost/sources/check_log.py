"""A log of failed checks, by day and run."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.quality import enforce

LOG = "check string, severity string, column string, n_bad bigint, detail string, logged_at timestamp"


def log_checks(results: DataFrame, path: str, *, run_id: str | None = None, day: date | None = None) -> list[str]:
    """Store the failed checks of a run with a time stamp, then raise on ERROR and warn on WARN.

    A run that is repeated under its run id and day replaces what it stored, also by nothing; every run without an id is
    one of its own. A run has its own folder, so runs do not disturb each other. The stored rows are read back for the
    verdict, so the checks run once.
    """
    day = date.today() if day is None else day
    run_id = uuid.uuid4().hex if run_id is None else run_id
    if not run_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a run id consists of letters, digits, - and _")
    failed = results.where(F.col("n_bad") > 0).withColumn("logged_at", F.lit(datetime.now()))
    own = f"{path}/logged_on={day.isoformat()}/run_id={run_id}"
    failed.write.mode("overwrite").parquet(own)
    return enforce(results.sparkSession.read.schema(failed.schema).parquet(own))


def read_log(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The log with its columns logged_on and run_id; with a period, only the folders of its days are read."""
    log = spark.read.schema(f"{LOG}, logged_on date, run_id string").parquet(path)
    if first is not None:
        log = log.where(F.col("logged_on") >= F.lit(first))
    return log if last is None else log.where(F.col("logged_on") <= F.lit(last))
