"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Work per byte is high here: let small shuffles keep all cores busy.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Buffers arrive sorted by session: aggregate them as a stream instead of
    # filling a hash map of arrays that gives up after 128 sessions.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # Push row_number limits of larger buffers below the shuffle, too.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
