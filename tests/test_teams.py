import pytest
from pyspark.sql import functions as F

from tracewarden.operators import agents as ag, history, score

TEAMS = {
    # root score, sub-agent scores -> overall, signals
    1: ([75], 75, []),
    2: ([80, 70, 90], 80, []),
    3: ([90, 30, 25], None, ["team_cascade_failure", "subagent_distress"]),
    4: ([90, 30], 45, ["subagent_distress"]),
    5: ([90, 85, 95], 90, []),
    6: ([10, 5, 5], 0, ["team_cascade_failure"]),
    7: ([None, 50, 70], 80, ["team_cascade_failure"]),
}


def test_team_scores(spark):
    rows = []
    for team, (scores, _, _) in TEAMS.items():
        for i, s in enumerate(scores):
            if s is not None:
                rows.append((team * 100, "t", team * 100 + i, s))
    df = spark.createDataFrame(rows, "team_id bigint, team_name string, pid bigint, overall_score int")
    got = {r.team_id // 100: r for r in score.team_health(df).collect()}
    for team, (_, overall, signals) in TEAMS.items():
        assert [w.signal for w in got[team].cross_agent_warnings] == signals
        if team == 7:
            # An absent root counts as 100: 100/2 + 60/2 = 80, minus 30 for half of the sub-agents below 60.
            assert got[team].overall_score == 50
        elif overall is not None:
            assert got[team].overall_score == overall
    assert got[3].overall_score < 58


@pytest.fixture(scope="module")
def forest(spark):
    # (pid, ppid, command): 1 -> 2(shell) -> 3; 3 -> 4; a loop 10 <-> 11; 20 under a missing parent
    rows = [
        (1, None, "claude"), (2, 1, "bash"), (3, 2, "aider x"), (4, 3, "codex"), (5, 1, "claude"), (10, 11, "claude"),
        (11, 10, "sh"), (20, 999, "claude"), (30, 1, "Claude.app claude"), (31, 1, "claudette"),
    ]
    return spark.createDataFrame(
        [(p, q, a, 1.0, 2048, "0:01", "/home/u/proj/", "s%d" % p) for p, q, a in rows],
        "pid bigint, ppid bigint, args string, cpu double, rss_kb bigint, etime string, cwd string, session_id string",
    )


def test_hierarchy(forest):
    found = ag.find_agents(forest)
    kinds = {r.pid: (r.agent_type, r.project, r.memory_mb) for r in found.collect()}
    assert kinds[3] == ("aider", "proj", 2.0) and 30 not in kinds and 31 not in kinds
    linked = ag.nearest_ancestors(found, forest)
    assert {r.pid: r.parent_agent_pid for r in linked.collect()} == {1: None, 3: 1, 4: 3, 5: 1, 10: None, 20: None}
    placed = ag.agent_tree(linked)
    rows = ag.tree_order(placed).collect()
    assert [(r.pid, r.depth, r.team_id) for r in rows] == [(1, 0, 1), (3, 1, 1), (4, 2, 1), (5, 1, 1), (10, 0, 10), (20, 0, 20)]
    teams = {r.team_id: r for r in ag.teams(placed).collect()}
    assert (teams[1].team_name, teams[1].member_count, teams[1].subagent_count, teams[1].max_depth) == ("claude-code:proj", 4, 3, 2)


def test_hop_limit(forest):
    found = ag.find_agents(forest)
    near = {r.pid: r.parent_agent_pid for r in ag.nearest_ancestors(found, forest, max_hops=1).collect()}
    assert near[3] is None and near[4] == 3


def test_orphans_become_roots(spark):
    agents = spark.createDataFrame(
        [(1, 7, "aider", "p"), (2, 1, "aider", "p"), (3, None, "aider", "p")],
        "pid bigint, parent_agent_pid bigint, agent_type string, project string",
    )
    rows = {r.pid: (r.parent_agent_pid, r.depth) for r in ag.agent_tree(agents).collect()}
    assert rows == {1: (None, 0), 2: (None, 0), 3: (None, 0)}


def test_history_equals_single_snapshots(spark, forest):
    """Each snapshot has the hierarchy it has alone, though pids are the same in all of them."""
    other = forest.where("pid <> 3").withColumn("ppid", F.when(F.col("pid") == 4, 5).otherwise(F.col("ppid")))
    snapshots = {7: forest, 8: other}
    both = None
    for no, processes in snapshots.items():
        numbered = processes.withColumn("snapshot_no", F.lit(no).cast("long"))
        both = numbered if both is None else both.unionByName(numbered)
    # Repeated rows and rows without pid or snapshot change nothing.
    both = both.unionByName(both.where("pid = 4")).unionByName(both.where("pid = 1").withColumn("pid", F.lit(None).cast("long")))
    both = both.unionByName(both.where("pid = 5").withColumn("snapshot_no", F.lit(None).cast("long")))
    agents = both.where(ag.agent_type(F.col("args")).isNotNull())
    for hops in (1, 50):
        near = history.nearest_ancestors(agents, both, hops)
        trees = {(r.snapshot_no, r.pid): (r.parent_agent_pid, r.depth, r.team_id) for r in history.agent_trees(near).collect()}
        expected = {}
        for no, processes in snapshots.items():
            alone = ag.agent_tree(ag.nearest_ancestors(ag.find_agents(processes), processes, hops))
            expected |= {(no, r.pid): (r.parent_agent_pid, r.depth, r.team_id) for r in alone.collect()}
        assert trees == expected


def test_history_of_deep_chains_and_circles(spark):
    chain = spark.range(1, 20_001).select(
        F.lit(0).cast("long").alias("snapshot_no"), F.col("id").alias("pid"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_agent_pid")
    )
    # In snapshot 1: a circle, agents below it, one below a missing parent, its child, one root with a child.
    odd = [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 3), (1, 5, 4), (1, 6, 99), (1, 7, 6), (1, 8, None), (1, 9, 8), (1, 10, 10)]
    rows = chain.unionByName(spark.createDataFrame(odd, chain.schema))
    found = history.agent_trees(rows)
    deep = found.where("snapshot_no = 0")
    assert deep.where("depth <> pid - 1 or team_id <> 1").isEmpty() and deep.count() == 20_000
    rest = {r.pid: (r.parent_agent_pid, r.depth, r.team_id) for r in found.where("snapshot_no = 1").collect()}
    assert rest == {n: (None, 0, n) for n in range(1, 11)} | {9: (8, 1, 8)}
    assert history.agent_trees(rows.limit(0)).isEmpty()


def test_presence(spark):
    seen = {"a": [0, 1, 2, 5], "b": [0, 1, 9], "c": [8, 9]}
    sightings = spark.createDataFrame([(k, n) for k, v in seen.items() for n in v], "agent_key string, snapshot_no bigint")
    snapshots = spark.range(10).select(
        F.col("id").alias("snapshot_no"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 25).alias("taken_at")
    )
    rows = sorted((r.agent_key, r.snapshot_no, r.event) for r in ag.presence(sightings, snapshots, 60.0).collect())
    # 60 s after a stop at snapshot n is reached by snapshot n + 3.
    assert rows == [
        ("a", 0, "new"), ("a", 3, "stopped"), ("a", 5, "returned"), ("a", 6, "stopped"), ("a", 9, "reaped"),
        ("b", 0, "new"), ("b", 2, "stopped"), ("b", 5, "reaped"), ("b", 9, "returned"),
        ("c", 8, "new"),
    ]
