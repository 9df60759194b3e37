"""Storage layout of the peak table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paraspark.schema import BATCH


def store_peaks(peaks: DataFrame, table: str, buckets: int) -> None:
    """Save peaks bucketed by injection.

    The standard's area and the join to injections both work per injection, so
    neither shuffles the peaks of a table stored like this.
    """
    # Dealt by injection first, so each bucket is one file and not one for each task.
    dealt = peaks.repartition(buckets, BATCH, "replicate")
    dealt.write.bucketBy(buckets, BATCH, "replicate").sortBy(BATCH, "replicate").saveAsTable(table)


def stored_peaks(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
