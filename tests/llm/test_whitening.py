"""Whitening against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm import whitening

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("x", "index", "part", "place.at")]
)


def expected(vectors, components=32):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    e, u = np.linalg.eigh((far / n).T @ (far / n) / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > e[0] * len(e) * np.finfo(float).eps).sum()))
    return far, (far / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(rows, ids, vectors, components=32):
    far, y, explained = expected(vectors, components)
    n, k = y.shape
    assert len(rows) == n * k
    got, seen = np.zeros((n, k)), {}
    at = {v: i for i, v in enumerate(ids)}
    for r in rows:
        i, j = at[r.vec_id], r.component - 1
        got[i, j] = r.whitened
        assert r.n == n and r.deviation == int((far[i].astype(object) ** 2).sum())
        assert math.isclose(r.explained, explained[j], rel_tol=1e-9)
        seen[r.identity_error] = True
    assert len(seen) == 1 and next(iter(seen)) < 1e-9
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    sign = np.sign((got * y).sum(axis=0))
    assert np.abs(got * sign - y).max() < 1e-6


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = whitening.whitened(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(7)).collect()
    check(got, [i for i, _ in rows], [v for _, v in rows])


def test_odd_vectors(spark, monkeypatch):
    """Many blocks in both directions; nulls, odd lengths, repeated rows, clashing names."""
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 3)
    random = np.random.default_rng(1)
    good = (random.normal(size=(150, 7)) * [5, 3, 1, 1, 0.5, 0.3, 100]).astype(np.float32).tolist()
    good += [good[0]] * 90
    rows = [(i, v, None, "x", None, "p", "q") for i, v in enumerate(good)]
    bad = [None, [], [1.0] * 6, [None] + [1.0] * 6, [math.nan] * 7, [math.inf] + [0.0] * 6, [-math.inf] * 7]
    df = spark.createDataFrame(rows + [(1000 + i, v, 1, None, "i", None, None) for i, v in enumerate(bad)], SCHEMA).repartition(5)
    check(whitening.whitened(df).collect(), list(range(len(good))), good)
    check(whitening.whitened(df, 2).collect(), list(range(len(good))), good, 2)


def test_directions_without_variance_are_left_out(spark):
    random = np.random.default_rng(2)
    flat = [[float(a), float(a), 3.0, float(b)] for a, b in random.integers(0, 50, (60, 2))]
    df = spark.createDataFrame([(i, v, None, *"xipq") for i, v in enumerate(flat)], SCHEMA)
    check(whitening.whitened(df).collect(), list(range(60)), flat)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None, []]])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame([(i, v, None, *"xipq") for i, v in enumerate(vectors)], SCHEMA)
    got = whitening.whitened(df)
    assert got.collect() == [] and got.columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]


def test_missing_ids_and_equal_ids_stay(spark):
    random = np.random.default_rng(4)
    vectors = random.normal(size=(30, 3)).tolist()
    df = spark.createDataFrame([(None if i < 3 else 5, v, None, *"xipq") for i, v in enumerate(vectors)], SCHEMA)
    got = whitening.whitened(df)
    assert got.count() == 90 and got.where("vec_id is null").count() == 9
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
