"""Buffer, replay and statistics, with and without hot sessions, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import edit, fail, ok, read, sessions
from tracewarden.operators import buffer as b, score, turns as t
from tracewarden.model import as_actions


@pytest.fixture(scope="module")
def uneven(spark):
    """One session holds most rows; its seq has gaps, clusters and ties; one session is null."""
    random.seed(5)
    rows = []
    for session, size in (("hot", 6000), ("warm", 700), ("cold", 20), (None, 40)):
        seq = 0
        for i in range(size):
            seq += random.choice([0, 1, 1, 5, 1000 if i % 500 == 0 else 2])
            rows.append((session, seq, i, "f%d" % (i % 7)))
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, seq bigint, sub bigint, file_path string")
    return as_actions(df.withColumn("tool_name", F.lit("Read")).withColumn("tool_type", F.lit("read"))), rows


def ordered(rows):
    by = {}
    for session, seq, sub, _ in rows:
        by.setdefault(session, []).append((seq, sub))
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("hot_rows", [50, b.HOT_ROWS])
def test_buffer_keeps_exactly_the_last_rows(uneven, hot_rows):
    actions, rows = uneven
    got = {}
    for r in b.buffer(actions, max_size=500, hot_rows=hot_rows).collect():
        got.setdefault(r.session_id, []).append((r.pos, r.rd, r.n, r.seq, r.sub))
    for session, expected in ordered(rows).items():
        kept = expected[-500:]
        n = len(kept)
        assert sorted(got[session]) == [(i + 1, n - i, n, *kept[i]) for i in range(n)]


@pytest.mark.parametrize("hot_rows", [50, b.HOT_ROWS])
def test_numbering_is_dense(uneven, hot_rows):
    actions, rows = uneven
    got = {(r.session_id, r.seq, r.sub): r.idx for r in b.numbered(actions, hot_rows=hot_rows).collect()}
    for session, expected in ordered(rows).items():
        assert [got[session, *key] for key in expected] == list(range(1, len(expected) + 1))


def test_hot_list_is_bounded_and_bounds_are_below_the_cut(spark, uneven):
    actions, rows = uneven
    assert {r.session_id for r in b.hot_sessions(actions, hot_rows=500).collect()} == {"hot", "warm"}
    bounds = {r.session_id: r.from_seq for r in b.recent_bounds(actions, 300, hot_rows=500).collect()}
    for session, seq in bounds.items():
        assert seq <= ordered(rows)[session][-300][0]


@pytest.mark.parametrize("hot_rows", [50, b.HOT_ROWS])
def test_replay_matches_prefixes(uneven, hot_rows):
    actions, rows = uneven
    replayed = b.replay(actions.where("session_id <> 'hot'"), every=7, max_size=50, hot_rows=hot_rows)
    got = {}
    for r in replayed.collect():
        got.setdefault((r.session_id, r.snapshot_id), []).append((r.pos, r.rd, r.n, r.seq, r.sub))
    expected = {}
    for session, seqs in ordered(rows).items():
        if session in (None, "hot"):
            continue
        for k in range(1, -(-len(seqs) // 7) + 1):
            kept = seqs[: k * 7][-50:]
            expected[session, k] = [(i + 1, len(kept) - i, len(kept), *x) for i, x in enumerate(kept)]
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_replay_at_given_points(spark, uneven):
    actions, rows = uneven
    points = spark.createDataFrame(
        [("hot", 1, 5999), ("hot", 2, 10), ("cold", 1, 20), ("cold", 2, 100)],
        "session_id string, snapshot_id bigint, as_of_idx bigint",
    )
    got = {}
    for r in b.replay_at(actions, points, max_size=50, hot_rows=100).collect():
        got.setdefault((r.session_id, r.snapshot_id), []).append((r.seq, r.sub))
    hot, cold = ordered(rows)["hot"], ordered(rows)["cold"]
    assert sorted(got["hot", 1]) == hot[5949:5999]
    assert sorted(got["hot", 2]) == hot[:10]
    assert sorted(got["cold", 1]) == cold
    assert sorted(got["cold", 2]) == cold


def test_statistics(spark):
    case = [read("a", tokens_in=10, tokens_out=5, cache_read_tokens=100), edit("a", tokens_in=1), fail(error="x"), fail(error="")]
    row = b.with_duration(b.session_stats(sessions(spark, {"s": case}))).first()
    assert (row.action_count, row.total_tokens, row.peak_context_tokens, row.error_count, row.files_touched) == (4, 16, 110, 1, 1)
    assert row.duration_minutes == 3 / 60


def test_windows_and_maturity(spark):
    sizes = {"w20": 20, "w200": 200, "w500": 500}
    rows = {r.session_id: r for r in t.session_shape(
        b.buffer(sessions(spark, {k: [ok("x")] * n for k, n in sizes.items()}))).collect()}
    assert [rows[k].action_window for k in sizes] == [20, 30, 75]
    assert rows["w20"].maturity == 0.1


EFFICIENCY = {
    "light": [read("a", tokens_in=100, tokens_out=50, at=i * 10) for i in range(6)],
    "burn": [read("a", tokens_in=39000, tokens_out=5000, at=i * 30) for i in range(10)],
    "pressure": [read("a", tokens_in=170000, tokens_out=6000, at=i) for i in range(10)],
    "miss": [read("a", tokens_in=100, tokens_out=50, cache_creation_tokens=1000, at=i) for i in range(6)],
    "reuse": [read("a", tokens_in=100, tokens_out=50, cache_creation_tokens=100, cache_read_tokens=900, at=i) for i in range(6)],
    "long": [read("a", tokens_in=100, tokens_out=50, at=i * 1080) for i in range(6)],
    "costly": [read("a", tokens_in=100, tokens_out=50, cost_usd=0.5, at=i * 12) for i in range(6)],
}


def test_efficiency(spark):
    actions = sessions(spark, EFFICIENCY)
    rows = {r.session_id: r for r in score.session_efficiency(actions, b.buffer(actions)).collect()}
    assert rows["light"].score >= 90
    assert rows["burn"].token_burn_rate > 30000 and rows["burn"].score < 95
    assert rows["pressure"].context_usage_pct == 88.0 and rows["pressure"].score < 85
    assert rows["miss"].penalty_cache == 1 and rows["miss"].score <= 90
    assert rows["reuse"].cache_hit_rate >= 0.8
    assert rows["long"].duration_minutes == 90.0 and rows["long"].score < 95
    assert rows["costly"].cost_velocity > 0.3
