"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Hot keys in the large joins are split at run time by adaptive skew handling;
# forcing it keeps the split when the next operator would reuse the partitioning.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def decided_settings(spark: SparkSession) -> set[str]:
    """Names of the settings that the application or the session has a value of its own for."""
    return {row["key"] for row in spark.sql("SET").collect()}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs on this machine alone may do without: it gets a folder of its own, once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paraspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` where neither the application nor the session has decided otherwise."""
    decided = decided_settings(spark)
    for key, value in RUNTIME_CONF.items():
        if key not in decided:
            spark.conf.set(key, value)
    return spark
