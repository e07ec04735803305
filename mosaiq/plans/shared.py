"""Tables written where driver and executors can read them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one under /tmp only where the session names none and is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "file:///tmp/checkpoints/mosaiq"


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts lineage, survives the loss of any
    executor, and lets Spark delete the shuffle files that made it."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {}
    for key in _CLEANUP:
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
