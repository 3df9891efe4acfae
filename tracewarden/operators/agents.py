"""Agent processes: classification, ancestry, teams and presence over time.

Input is a table of process snapshots. ``agents(pid, parent_pid, ...)`` holds the
rows that are agents, ``processes(pid, ppid)`` every process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewarden.functions import classify as c, fixed_values as fv
from tracewarden.operators.asof import as_of
from tracewarden.operators.lineage import cut

MAX_HOPS = 50


def agent_type(command: Column) -> Column:
    """First agent type whose pattern fits and whose exclusion does not."""
    expr = F.when(F.lit(False), "")
    for name, (pattern, exclude) in fv.AGENT_COMMANDS.items():
        fits = command.rlike(f"(?Ud){pattern}")
        if exclude:
            fits = fits & ~command.rlike(f"(?Ud){exclude}")
        expr = expr.when(fits, name)
    return expr


def find_agents(processes: DataFrame) -> DataFrame:
    """Agents among ``processes(pid, ppid, cpu, rss_kb, etime, args, cwd, session_id)``."""
    kind = agent_type(F.col("args"))
    return processes.where(kind.isNotNull()).select(
        "pid",
        F.col("ppid").alias("parent_pid"),
        kind.alias("agent_type"),
        c.project_name(F.col("cwd")).alias("project"),
        "session_id",
        F.col("cpu").alias("cpu_percent"),
        (F.col("rss_kb") / 1024.0).alias("memory_mb"),
        F.col("etime").alias("uptime"),
        F.col("args").alias("command"),
    )


def _recursive(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run recursive SQL over frames; lifts the session's limit on the rows it may produce."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(sql, **frames)


def nearest_ancestors(agents: DataFrame, processes: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Add ``parent_agent_pid``: the closest agent up the chain of parent processes.

    Only chains that have not met an agent yet go another step; chains that run
    in a circle never meet one and end with the hop limit.
    """
    parents = processes.select(F.col("pid").cast("long"), F.col("ppid").cast("long")).where("ppid is not null")
    flagged = parents.join(
        agents.select(F.col("pid").cast("long").alias("ppid"), F.lit(True).alias("is_agent")).distinct(), "ppid", "left"
    ).select("pid", "ppid", F.coalesce("is_agent", F.lit(False)).alias("is_agent"))
    start = agents.select(F.col("pid").cast("long").alias("pid"))
    # Every step of the recursion reads the edges again: compute them once.
    flagged = cut(flagged)
    walk = _recursive(
        agents.sparkSession,
        f"""
        WITH RECURSIVE walk(pid, at_pid, found, hops) MAX RECURSION LEVEL {max_hops + 2} AS (
          SELECT s.pid, p.ppid, p.is_agent, 1
          FROM {{start}} s JOIN {{parents}} p ON p.pid = s.pid
          UNION ALL
          SELECT w.pid, p.ppid, p.is_agent, w.hops + 1
          FROM walk w JOIN {{parents}} p ON p.pid = w.at_pid
          WHERE NOT w.found AND w.hops < {max_hops} AND w.at_pid <> w.pid
        )
        SELECT pid AS w_pid, at_pid AS parent_agent_pid FROM walk WHERE found AND at_pid <> pid
        """,
        start=start,
        parents=flagged,
    )
    return agents.join(walk, F.col("pid") == F.col("w_pid"), "left").drop("w_pid")


def agent_tree(agents: DataFrame) -> DataFrame:
    """Add ``depth``, ``team_id`` (the root's pid) and ``path`` (pids from the root).

    Agents that no root leads to become roots themselves. Ordering by ``path``
    gives parents before children and siblings by pid.
    """
    edges = cut(agents.select(F.col("pid").cast("long"), F.col("parent_agent_pid").cast("long").alias("parent")))
    placed = _recursive(
        agents.sparkSession,
        """
        WITH RECURSIVE tree(pid, depth, team_id, path) MAX RECURSION LEVEL 10000 AS (
          SELECT pid, 0, pid, array(pid) FROM {edges} WHERE parent IS NULL
          UNION ALL
          SELECT e.pid, t.depth + 1, t.team_id, concat(t.path, array(e.pid))
          FROM tree t JOIN {edges} e ON e.parent = t.pid
        )
        SELECT pid AS t_pid, depth, team_id, path FROM tree
        """,
        edges=edges,
    )
    joined = agents.join(placed, F.col("pid") == F.col("t_pid"), "left")
    orphan, pid = F.col("t_pid").isNull(), F.col("pid").cast("long")
    return (
        joined.withColumn("parent_agent_pid", F.when(~orphan, F.col("parent_agent_pid")))
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
        .withColumn("team_id", F.coalesce("team_id", pid))
        .withColumn("path", F.coalesce("path", F.array(pid)))
        .drop("t_pid")
    )


def tree_order(placed: DataFrame) -> DataFrame:
    return placed.orderBy("path")


def teams(placed: DataFrame) -> DataFrame:
    """One row per team: counts, depth and name; members stay rows of ``placed``."""
    is_root = F.col("depth") == 0
    return placed.groupBy("team_id").agg(
        F.max(F.when(is_root, c.team_name(F.col("agent_type"), F.col("project")))).alias("team_name"),
        F.count("*").alias("member_count"),
        F.count_if(~is_root).alias("subagent_count"),
        F.max("depth").alias("max_depth"),
    )


def team_members(placed: DataFrame, team_id: int) -> DataFrame:
    return placed.where(F.col("team_id") == team_id)


# --- presence over snapshots --------------------------------------------------------------

def presence(sightings: DataFrame, snapshots: DataFrame, reap_after_seconds: float = 60.0) -> DataFrame:
    """Life-cycle events of agents seen in periodic snapshots.

    ``sightings(agent_key, snapshot_no)``: who was there.
    ``snapshots(snapshot_no, taken_at)``: consecutive numbers and their times.

    Events: ``new`` (never seen before), ``returned``, ``stopped`` (first
    snapshot it is missing from) and ``reaped`` (first snapshot at least
    ``reap_after_seconds`` after the stop, if it has not returned by then).
    """
    seen = sightings.select("agent_key", "snapshot_no").distinct()
    before = seen.select("agent_key", (F.col("snapshot_no") + 1).alias("snapshot_no"))
    # Consecutive snapshots meet on equal keys, so one long-lived agent is no hot spot.
    started = seen.join(before, ["agent_key", "snapshot_no"], "left_anti")
    ended = before.join(seen, ["agent_key", "snapshot_no"], "left_anti")
    first = seen.groupBy("agent_key").agg(F.min("snapshot_no").alias("first_no"))
    starts = started.join(first, "agent_key").select(
        "agent_key",
        "snapshot_no",
        F.when(F.col("snapshot_no") == F.col("first_no"), "new").otherwise("returned").alias("event"),
    )
    stops = ended.select("agent_key", "snapshot_no", F.lit("stopped").alias("event"))
    changes = starts.unionByName(stops)
    # A stop is always followed by the agent's next change, its return.
    following = F.lead("snapshot_no").over(Window.partitionBy("agent_key").orderBy("snapshot_no"))
    dated = changes.withColumn("until_no", following).join(snapshots, "snapshot_no")
    due = _first_snapshot_after(dated.where(F.col("event") == "stopped"), snapshots, reap_after_seconds)
    reaped = due.where(F.col("until_no").isNull() | (F.col("reap_no") < F.col("until_no"))).select(
        "agent_key", F.col("reap_no").alias("snapshot_no"), F.lit("reaped").alias("event"),
        F.col("reap_at").alias("taken_at"),
    )
    return dated.select("agent_key", "snapshot_no", "event", "taken_at").unionByName(reaped)


def _first_snapshot_after(stops: DataFrame, snapshots: DataFrame, seconds: float) -> DataFrame:
    """For every stop the first snapshot at or after its time + ``seconds``, if there is one; a long gap costs nothing."""
    due = stops.withColumn("due_at", F.col("taken_at") + F.make_dt_interval(secs=F.lit(seconds)))
    found = as_of(due, snapshots.select("taken_at", "snapshot_no"), "due_at", "taken_at", after=True)
    return found.where("match is not null").select("*", F.col("match.snapshot_no").alias("reap_no"), F.col("match.taken_at").alias("reap_at"))
