"""Agent hierarchies of many process snapshots at once, by pointer doubling.

Every row is known by its snapshot and pid. A pointer leads some way up; each round lets it lead where the pointer of
its target leads, so the distance doubles and a chain of d processes takes log2(d) rounds, each one join on
(snapshot, pid). A target is one row, so a process with many children is a skewed key of one side only, which adaptive
execution splits.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, functions as F

from tracewarden.operators.agents import MAX_HOPS
from tracewarden.operators.lineage import cut

KEY = ["snapshot_no", "pid"]


def _keys(df: DataFrame, parent: str) -> DataFrame:
    """``snapshot_no, pid, up``, one row each; of repeated rows the one with the least parent, a missing one last."""
    rows = df.select("snapshot_no", F.col("pid").cast("long"), F.col(parent).cast("long").alias("up"))
    return rows.where("snapshot_no is not null and pid is not null").groupBy(*KEY).agg(F.min("up").alias("up"))


def _targets(pointers: DataFrame, *columns: str) -> DataFrame:
    return pointers.select("snapshot_no", F.col("pid").alias("up"), *[F.col(c).alias(f"next_{c}") for c in columns])


def nearest_ancestors(agents: DataFrame, processes: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """``snapshot_no, pid, parent_agent_pid`` of every agent: the closest agent at most ``max_hops`` parents up.

    ``agents(snapshot_no, pid)`` and ``processes(snapshot_no, pid, ppid)``. Chains that leave the snapshot's processes,
    run in a circle or come back to the agent itself give null. Rows without snapshot or pid are left out.
    """
    who = agents.select("snapshot_no", F.col("pid").cast("long")).where("snapshot_no is not null and pid is not null").distinct()
    pointers = _keys(processes, "ppid").join(who.withColumn("agent", F.lit(True)), KEY, "left")
    pointers = cut(pointers.select(*KEY, F.coalesce("agent", F.lit(False)).alias("agent"), "up", F.lit(1).alias("hops")))
    for _ in range(ceil(log2(max(max_hops, 2)))):
        # At an agent the way ends: its own pointer is not followed.
        on = pointers.join(_targets(pointers, "agent", "up", "hops"), ["snapshot_no", "up"], "left")
        follow = F.col("next_agent") == F.lit(False)
        pointers = cut(on.select(
            *KEY, "agent",
            F.when(follow, F.col("next_up")).when(F.col("next_agent"), F.col("up")).alias("up"),
            (F.col("hops") + F.when(follow, F.col("next_hops")).otherwise(0)).alias("hops"),
        ))
    ends = who.select("snapshot_no", F.col("pid").alias("up"), F.lit(True).alias("found"))
    found = pointers.where(F.col("agent") & (F.col("hops") <= max_hops) & (F.col("up") != F.col("pid"))).join(ends, ["snapshot_no", "up"])
    return who.join(found.select(*KEY, F.col("up").alias("parent_agent_pid")), KEY, "left")


def agent_trees(agents: DataFrame) -> DataFrame:
    """``snapshot_no, pid, parent_agent_pid, depth, team_id`` of ``agents(snapshot_no, pid, parent_agent_pid)``.

    As ``agents.agent_tree`` within each snapshot, without paths and without a limit of depth: agents that no root leads
    to (a missing parent, a circle) become roots themselves. Pids of different snapshots never meet.
    """
    edges = cut(_keys(agents, "parent_agent_pid"))
    # A root points to itself at no distance; ``done`` rows point to a root.
    root = F.col("up").isNull()
    pointers = cut(edges.select(
        *KEY, F.coalesce("up", "pid").alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done")
    ))
    largest = edges.groupBy("snapshot_no").count().agg(F.max("count")).first()[0] or 1
    # Whoever has gone further than a snapshot has agents is in a circle or below one.
    for _ in range(ceil(log2(max(largest, 2))) + 1):
        open_rows = pointers.where(~F.col("done"))
        if open_rows.isEmpty():
            break
        on = open_rows.join(_targets(pointers, "up", "depth", "done"), ["snapshot_no", "up"])
        moved = on.select(
            *KEY, F.col("next_up").alias("up"), (F.col("depth") + F.col("next_depth")).alias("depth"), F.col("next_done").alias("done")
        )
        # A missing parent drops out of the join: such rows are lost, and with them whoever points to them.
        pointers = cut(pointers.where("done").unionByName(moved))
    placed = pointers.where("done").select(*KEY, "depth", F.col("up").alias("team_id"))
    joined = edges.join(placed, KEY, "left")
    return joined.select(
        *KEY, F.when(F.col("depth") > 0, F.col("up")).alias("parent_agent_pid"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("team_id", "pid").alias("team_id"),
    )
