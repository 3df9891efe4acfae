"""Embedding whitening with MLlib's block matrices.

Centred rows are indexed into distributed blocks; the transpose times the blocks gives the scatter matrix, whose
eigenvectors are found on the driver (its size is the dimension squared, however many rows there are); the blocks times
the whitening matrix are the projected rows. Products are cut along the rows, so no task sees more than its share.
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import partitions, saved

COMPONENTS = 32
#: Rows of a block, and its columns at most.
BLOCK, COLUMNS = 1024, 1024
SCALE, SHIFT = 64, 1_000_000
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """What the fit list gives: rows, sums of each dimension, falling eigenvalues and their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray


def whole(entry: Column) -> Column:
    return (F.floor(F.lit(float(SCALE)) * entry.cast("double")) + F.lit(SHIFT)).cast("long")


def usable(df: DataFrame) -> DataFrame:
    """vec_id and the vector ``x`` of longs; vectors that are null or empty, or hold null or non-finite entries, go.

    So do vectors whose length is not the most frequent one (of equally frequent ones the greatest).
    """
    plain = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("v is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(math.inf)))
    kept = plain.where(finite).select("vec_id", F.transform("v", whole).alias("x"))
    return kept


def indexed(df: DataFrame) -> tuple[DataFrame, int, int]:
    """The usable rows with a dense ``index``, their number and their dimension.

    Each task writes its rows with their places in it; offsets follow from one count for each task.
    """
    placed = usable(df).withColumn("at", F.monotonically_increasing_id()).select(
        "vec_id", "x", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth"))
    table = saved(placed, "vectors")
    lengths = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not lengths:
        return table, 0, 0
    dimension = lengths[0].d
    if len(lengths) > 1:
        return indexed(table.where(F.size("x") == dimension).select("vec_id", back(F.col("x")).alias("embedding")))
    counts = table.groupBy("part").count().orderBy("part").collect()
    starts, n = [], 0
    for part, count in counts:
        starts.append((part, n))
        n += count
    offsets = df.sparkSession.createDataFrame(starts, "part long, start long")
    return table.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("nth")).alias("index"), "vec_id", "x"), n, dimension


def back(x: Column) -> Column:
    """Entries that whole() maps to ``x`` again."""
    return F.transform(x, lambda c: (c - F.lit(SHIFT)).cast("double") / F.lit(float(SCALE)))


def sums(rows: DataFrame) -> list[int]:
    """The exact sum of each dimension."""
    each = rows.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    return [int(r.s) for r in each.orderBy("pos").collect()]


def centred(n: int, totals: list[int]) -> Column:
    """n * x - S, exact."""
    return F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in totals)), lambda c, s: F.lit(n).cast("long") * c - s)


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, added up over ``splits`` groups of the blocks that meet."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock, left.numRows(), right.numCols())


def scatter(rows: BlockMatrix, splits: int) -> np.ndarray:
    """The transpose times the rows; it has the rows' columns squared."""
    found = times(rows.transpose(), rows, splits).toLocalMatrix().toArray()
    return (found + found.T) / 2


def fitted(blocks: BlockMatrix, n: int, totals: list[int], components: int, splits: int) -> tuple[Fit, float]:
    """The components that hold any variance, ``components`` at most, and the trace of the covariance."""
    covariance = scatter(blocks, splits) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = values > max(values[0], 0.0) * len(values) * np.finfo(float).eps
    count = min(components, int(held.sum()))
    return Fit(n, totals, values[:count], vectors[:, :count]), float(np.trace(covariance))


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``embeddings`` and component: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Rows go whose vector is null or empty, holds null or non-finite entries, or has another length than most. Repeated
    rows and a missing vec_id stay, each row by itself; other columns are left aside. Components without variance (an
    eigenvalue of zero but for rounding) cannot be whitened and are left out, so a single row, or equal ones, give no
    rows, as does an empty table. Equal eigenvalues share a plane, in which any right-angled pair of directions serves.
    An entry that leaves the range of a long, or such a deviation, is an error.
    """
    spark = df.sparkSession
    rows, n, dimension = indexed(df)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    totals = sums(rows)
    far = centred(n, totals)
    squares = F.aggregate(far, F.lit(Decimal(0)).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    vector = array_to_vector(F.transform(far, lambda c: c.cast("double") / F.lit(float(n))))
    matrix = MLUtils.convertVectorColumnsFromML(rows.select("index", vector.alias("vector")), "vector")
    blocks = IndexedRowMatrix(matrix, n, dimension).toBlockMatrix(BLOCK, min(dimension, COLUMNS))
    splits = max(1, min(partitions(spark), -(-n // BLOCK)))
    fit, trace = fitted(blocks, n, totals, components, splits)
    count = len(fit.values)
    if not count:
        return spark.createDataFrame([], SCHEMA)
    turn = fit.vectors / np.sqrt(fit.values)
    steps = range(0, dimension, COLUMNS)
    parts = [((k, 0), Matrices.dense(len(turn[a : a + COLUMNS]), count, turn[a : a + COLUMNS].ravel(order="F"))) for k, a in enumerate(steps)]
    turned = BlockMatrix(spark.sparkContext.parallelize(parts, 1), min(dimension, COLUMNS), count, dimension, count)
    projected = times(blocks, turned, 1)
    error = float(np.abs(scatter(projected, splits) / n - np.eye(count)).max())
    found = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    each = found.select(F.col("index").alias("place"), vector_to_array("vector").alias("ys"))
    explained = F.array(*(F.lit(float(e / trace)) for e in fit.values))
    meta = rows.select("index", "vec_id", squares.cast("long").alias("deviation"))
    joined = meta.join(each, F.col("index") == F.col("place")).select("vec_id", "deviation", F.posexplode("ys").alias("pos", "whitened"))
    return joined.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"),
    )
