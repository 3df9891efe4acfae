"""What the operators share: tables in the cluster's shared folder, document columns, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands in for a missing doc_id inside operators: sorts after every id.
NO_ID = 2**63 - 1
WHITE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below the warehouse, which a session shares as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more: it does so when they are collected."""
    gc.collect()
    spark._jvm.System.gc()


def saved(df: DataFrame, name: str = "table", tidy: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there: cuts the lineage and survives lost executors.

    Plans written before are garbage by then and are released first if ``tidy`` (not worth it between small tables).
    Tables are packed tightly: they are read once or twice and count as disk until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    if tidy:
        release(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame) -> DataFrame:
    """doc_id long and text string; all else, clashing names included, is left aside."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    text = F.col("text") if isinstance(fields["text"], T.StringType) else F.col("text").cast("string")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def smallest(df: DataFrame, order: Column, rows: int) -> DataFrame:
    """About the ``rows`` rows of ``df`` with the smallest ``order`` (a hash), never more, for the driver to collect.

    Rows that cannot be among them go before the sort, so that tasks send it little more than it keeps, however many
    tasks there are.
    """
    share = (1.2 * rows + 1000) / max(1, df.count())
    place = F.pmod(order, F.lit(1 << 40))
    return df.withColumn("place", place).where(F.col("place") < F.lit(int(min(1.0, share) * (1 << 40)))).orderBy("place").limit(rows)


def keyed(df: DataFrame) -> DataFrame:
    """The whole row as the struct ``doc``, beside its key: ``id`` (NO_ID where missing) and ``row`` (hash of the text).

    Columns of ``df`` keep their names inside the struct, whatever the names are; unkeyed() brings them back.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    whole = F.struct(*("`" + c.replace("`", "``") + "`" for c in df.columns))
    return df.select(whole.alias("doc"), id_.alias("id"), F.xxhash64(text).alias("row"))


def unkeyed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    return df.select(*(changed.get(c, F.col("doc").getField(c)).alias(c) for c in columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z only: other letters stay as they are in every locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def looked_up(rows: DataFrame, key: str, table: DataFrame, of: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` beside their ``key`` (null where it has none).

    ``table`` has each key ``of`` once, and in ``n`` how many of the ``total`` rows have it. Keys of more than a 1024th of
    all rows, so fewer than 1024, are broadcast; rows that met one get keys of their own for the join with the others.
    """
    most = max(1000, total // 1024)
    more = [c for c in table.columns if c not in (of, n)]
    few = table.where(F.col(n) > most).select(F.col(of).alias("few"), *(F.col(c).alias(f"few_{c}") for c in more))
    rest = table.where(F.col(n) <= most).select(of, *more)
    near = rows.join(F.broadcast(few), F.col(key) == F.col("few"), "left")
    # No key in common: null joins with nothing, and the left side's rows stay where they are only if salted.
    near = near.withColumn("by", F.when(F.col("few").isNull(), F.col(key))).withColumn("salt", F.when(F.col("few").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    joined = near.join(rest.withColumn("of_salt", F.lit(-1).cast("long")), (F.col("by") == F.col(of)) & (F.col("salt") == F.col("of_salt")), "left")
    return joined.select(*rows.columns, *(F.when(F.col("few").isNull(), F.col(c)).otherwise(F.col(f"few_{c}")).alias(c) for c in more))


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return seen.where("up > 1 or up = 1 and root = 1").isEmpty()


def components(edges: DataFrame, tidy: bool = True) -> DataFrame:
    """(node, component) of an undirected graph: component is the smallest node reachable; nodes without edges are absent.

    ``edges`` has two columns of one ordered type. Alternating large-star and small-star steps (Kiveris et al. 2014)
    take O(log^2 n) rounds; every step is a join and an aggregation, and each round is written to the shared folder.
    Edges with a null end or equal ends link nothing.
    """
    a, b = edges.columns
    # (u, v) with v < u
    now = saved(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", tidy)
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("x")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.union(down).distinct(), "edges", tidy)
    pairs = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.union(roots)
