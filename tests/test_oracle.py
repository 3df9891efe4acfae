"""Every named query against its SQL on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: Queries in which the last bit decides also run on more data.
LARGER, EXACT = "/root/testdata/sf0.01", ["rot_smoothing", "rot_replay", "stream_smoothing"]
TABLES = ["events", "documents", "conversations", "pages"]
NAMES = list(entry.QUERIES)
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def connected(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


@pytest.fixture(scope="module")
def duck():
    return connected(FOLDER)


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_an_oracle():
    assert set(NAMES) <= ORACLES.keys()


def compare(spark, duck, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    positions = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(positions) == columns
    expected = [tuple(row[positions[c]] for c in columns) for row in result.fetchall()]
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    assert ordered(got) == ordered(expected)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, duck, name):
    compare(spark, duck, name, FOLDER)


@pytest.mark.parametrize("name", EXACT)
def test_query_matches_its_oracle_on_more_data(spark, name):
    compare(spark, connected(LARGER), name, LARGER)


def test_entry(spark):
    assert entry.entry(spark).count() == 15
