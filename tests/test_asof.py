"""The as-of join against brute force, and what is built on it."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import T0, read, sessions

from tracewarden.operators import agents as ag, buffer as b
from tracewarden.operators.asof import as_of


def nearest(row, right, after):
    key, at = row[0], row[1]
    fits = [r for r in right if at is not None and r[1] is not None and r[0] == key and (r[1] >= at if after else r[1] <= at)]
    if not fits:
        return None
    best = (min if after else max)(r[1] for r in fits)
    return max(r for r in fits if r[1] == best)


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_as_of_equals_brute_force(spark, after, hot):
    r = random.Random(4)
    at = lambda: None if r.random() < 0.05 else T0 + timedelta(seconds=7 if hot and r.random() < 0.6 else r.randrange(200), days=365 * r.randrange(3))
    key = lambda: None if r.random() < 0.1 else "a" if hot and r.random() < 0.6 else r.choice("abc")
    left = [(key(), at(), n % 150) for n in range(300)]
    right = [(key(), at(), r.randrange(5)) for _ in range(120)]
    # Both sides have a column of one name, and names used inside.
    l_df = spark.createDataFrame(left, "k string, at timestamp, side int").repartition(3)
    r_df = spark.createDataFrame(right, "k string, at timestamp, side int").repartition(3)
    found = as_of(l_df, r_df, "at", "at", by=("k",), after=after)
    assert found.columns == ["k", "at", "side", "match"]
    got = [((x.k, x.at, x.side), tuple(x.match) if x.match else None) for x in found.collect()]
    expected = [(x, nearest(x, right, after)) for x in left]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_as_of_without_keys_and_with_empty_sides(spark):
    left = spark.createDataFrame([(1, T0), (1, T0), (2, None)], "n int, at timestamp")
    right = spark.createDataFrame([(9, T0 - timedelta(days=400))], "m int, seen timestamp")
    got = sorted((x.n, x.match.m if x.match else None) for x in as_of(left, right, "at", "seen").collect())
    assert got == [(1, 9), (1, 9), (2, None)]
    assert [x.match for x in as_of(left, right.limit(0), "at", "seen").collect()] == [None] * 3
    assert as_of(left.limit(0), right, "at", "seen").collect() == []


def test_a_gap_adds_no_rows(spark):
    later = datetime(2027, 1, 1)
    snapshots = spark.createDataFrame([(1, T0), (2, T0 + timedelta(seconds=30)), (3, later)], "snapshot_no int, taken_at timestamp")
    sightings = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3)], "agent_key string, snapshot_no int")
    told = ag.presence(sightings, snapshots, 60.0)
    assert "sequence(" not in told._jdf.queryExecution().optimizedPlan().toString()
    events = sorted((x.agent_key, x.snapshot_no, x.event) for x in told.collect())
    assert events == [("a", 1, "new"), ("a", 2, "stopped"), ("a", 3, "reaped"), ("b", 1, "new")]


def test_replay_by_time(spark):
    year = 365 * 86400
    actions = sessions(spark, {"s": [read("f0", at=0), read("f1", at=10), read("f2", at=10), read("f3", at=year)], "t": [read("g", at=5)]})
    times = {0: -1, 1: 0, 2: 9, 3: 10, 4: 5000, 5: year + 1}
    ticks = spark.createDataFrame([(s, k, T0 + timedelta(seconds=x)) for s in ("s", "t", "u") for k, x in times.items()], "session_id string, snapshot_id long, tick_at timestamp")
    rows = b.replay_by_time(actions, ticks, max_size=2).select("session_id", "snapshot_id", "pos", "file_path").collect()
    shown = {}
    for x in sorted(rows, key=lambda x: x.pos):
        shown.setdefault((x.session_id, x.snapshot_id), []).append(x.file_path)
    assert shown == {
        ("s", 1): ["f0"], ("s", 2): ["f0"], ("s", 3): ["f1", "f2"], ("s", 4): ["f1", "f2"], ("s", 5): ["f2", "f3"],
        ("t", 2): ["g"], ("t", 3): ["g"], ("t", 4): ["g"], ("t", 5): ["g"],
    }
