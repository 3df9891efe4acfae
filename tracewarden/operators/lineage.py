"""Cutting lineage through a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below the warehouse, which a session shares, too.

    A warehouse on a local disk is shared only if the session runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        where = spark._jvm.org.apache.hadoop.fs.Path(base)
        scheme = where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file" and not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there."""
    spark = df.sparkSession
    place = shared_folder(spark)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def remove(spark: SparkSession, place: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(place)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
