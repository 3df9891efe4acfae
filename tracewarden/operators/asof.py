"""As-of join: each row meets the nearest row in time before or after it.

Both sides are put into one order and cut into ranges of about equal size. Inside a range the other side's last row is
carried forward; what a range inherits is the last row of the ranges before it, one row for each range. The work is a
sort of both sides, whatever gaps lie between the times, and neither a busy key nor a busy moment stays in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tracewarden.operators.lineage import cut


def _names(columns) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: tuple[str, ...] = (), after: bool = False) -> DataFrame:
    """All rows of ``left``, with the struct ``match``: the row of ``right`` that is the last at or before ``left_at``, or
    with ``after`` the first at or after it; null where there is none.

    Rows meet only if the columns ``by``, which both sides have, are equal; null is equal to null. Of several rows of
    ``right`` with one key and time the greatest counts, by its columns in order, so they must be orderable. Rows of
    ``left`` without a time meet nothing, and stay; repeated rows stay. Either side may be empty.
    """
    spark = left.sparkSession

    def order(at: str) -> Column:
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        return -micros if after else micros

    keys = F.struct(*(F.col(c).alias(f"k{n}") for n, c in enumerate(by))) if by else F.lit(0)
    row, match = F.struct(*_names(left.columns)), F.struct(*_names(right.columns))
    # At one time the rows to be found come first. Rows that look are spread by their content.
    plain = [f.name for f in left.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    looking = left.select(keys.alias("key"), order(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.select(match.alias("m")).schema["m"].dataType).alias("match"), F.xxhash64(*_names(plain)).alias("salt"), row.alias("row"))
    given = right.where(F.col(right_at).isNotNull()).select(keys.alias("key"), order(right_at).alias("at"), F.lit(0).alias("side"), match.alias("match"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("row"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_by = ["key", "at", "side", "match", "salt"]
    # Written, so that a row keeps its range if a task is repeated.
    placed = cut(looking.unionByName(given).repartitionByRange(ranges, *sorted_by).withColumn("range", F.spark_partition_id()))
    found = F.when(F.col("side") == 0, F.struct("key", "match"))
    inside = placed.withColumn("last", F.last(found, ignorenulls=True).over(Window.partitionBy("range").orderBy(*sorted_by).rowsBetween(Window.unboundedPreceding, 0)))
    ends = placed.groupBy(F.col("range").alias("of")).agg(F.max(F.when(F.col("side") == 0, F.struct("key", "at", "match"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each range, as many as there are shuffle partitions.
    carried = ends.select("of", before.alias("end")).select("of", F.when(F.col("end").isNotNull(), F.struct("end.key", "end.match")).alias("carried"))
    joined = inside.where("side = 1").join(F.broadcast(carried), F.col("range") == F.col("of"))
    nearest = joined.select("row", "key", "at", F.coalesce("last", "carried").alias("nearest"))
    same = F.col("at").isNotNull() & F.col("nearest.key").eqNullSafe(F.col("key"))
    return nearest.select(*(F.col("row").getField(c).alias(c) for c in left.columns), F.when(same, F.col("nearest.match")).alias("match"))
