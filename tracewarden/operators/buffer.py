"""Session statistics, the rolling buffer and replay snapshots.

Every detector and metric looks at the last ``max_size`` actions of a session
only, so the one place where a session of any length has to be tamed is
:func:`buffer`. It never brings a long session into one task: sessions above
``hot_rows`` actions are found by a narrow hash aggregate, an exact lower bound
of their last ``max_size`` positions comes from a histogram of ``seq``, and all
older rows are dropped before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewarden.functions import classify as c, fixed_values as fv
from tracewarden.operators.asof import as_of
from tracewarden.operators.lineage import cut

SESSION = ["session_id"]
SNAPSHOT = ["session_id", "snapshot_id"]

# A session is hot above this many actions and above 1/MAX_HOT of all rows,
# so at most MAX_HOT sessions are: the bound that makes broadcasting them safe.
HOT_ROWS = 1 << 20
MAX_HOT = 4096
# Hot sessions are cut into cells of seq, in proportion to their share of all
# rows: at most CELLS + 2 * MAX_HOT cells in total, small enough to broadcast.
CELLS = 1 << 16


def newest_first(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(F.col("seq").desc(), F.col("sub").desc())


# --- whole-history statistics -------------------------------------------------

def session_stats(actions: DataFrame) -> DataFrame:
    """Cumulative statistics per session, plain hash aggregation only."""
    failed = ~F.col("success") & c.present(F.col("error_message")).isNotNull()
    context = F.col("tokens_in") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    command, incoming = c.present(F.col("command")), c.present(F.col("incoming_message"))
    return actions.groupBy("session_id").agg(
        F.count("*").alias("action_count"),
        F.sum("tokens_in").alias("total_input_tokens"),
        F.sum("tokens_out").alias("total_output_tokens"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"),
        F.sum("cache_creation_tokens").alias("total_cache_creation"),
        F.sum("cache_read_tokens").alias("total_cache_read"),
        F.sum("cost_usd").alias("total_cost"),
        F.greatest(F.max(context), F.lit(0)).alias("peak_context_tokens"),
        F.count_if(failed).alias("error_count"),
        # Actions of one line share their timestamp, so seq alone decides.
        F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("seq"))).alias("start_time"),
        F.max("timestamp").alias("last_time"),
        F.count_distinct(c.present(F.col("file_path"))).alias("files_touched"),
        F.count_if(c.is_sensitive_path(F.col("file_path")) | c.is_sensitive_path(command)).alias("credential_accesses"),
        F.count_if(command.rlike(fv.any_of(fv.PRIVILEGE_COMMANDS))).alias("privilege_commands"),
        F.count_if(c.is_network(F.col("network_host"), F.col("network_port"))).alias("network_connections"),
        F.count_if(incoming.rlike(fv.any_of(fv.INJECTION_PATTERNS))).alias("injection_attempts"),
    )


def micros(timestamp: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), timestamp)


def with_duration(stats: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Minutes from the first action to ``as_of`` (default: the session's last time)."""
    end = F.col("last_time") if as_of is None else as_of
    minutes = F.timestamp_diff("MICROSECOND", F.col("start_time"), end) / F.lit(60_000_000.0)
    return stats.withColumn("duration_minutes", F.coalesce(minutes, F.lit(0.0)))


def estimated_cost() -> Column:
    """Logged cost, else list prices per million tokens, else a blended rate."""
    by_kind = (
        F.col("total_input_tokens") * 3.0
        + F.col("total_output_tokens") * 15.0
        + F.col("total_cache_creation") * 3.75
        + F.col("total_cache_read") * 0.30
    ) / 1_000_000
    has_cache = (F.col("total_cache_creation") != 0) | (F.col("total_cache_read") != 0)
    return (
        F.when(F.col("total_cost") > 0, F.col("total_cost"))
        .when(has_cache, by_kind)
        .otherwise(F.col("total_tokens") / 1_000_000 * 5)
    )


def file_access_count(actions: DataFrame) -> DataFrame:
    path = c.present(F.col("file_path"))
    return (
        actions.where(path.isNotNull())
        .groupBy("session_id", "file_path")
        .agg(F.count("*").alias("access_count"))
    )


def recent_errors(actions: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` error messages per session over its whole history."""
    failures = actions.where(~F.col("success") & c.present(F.col("error_message")).isNotNull())
    return newest(failures, n).select("session_id", "rd", "error_message")


# --- buffer ---------------------------------------------------------------------

def hot_sessions(actions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """At most MAX_HOT sessions holding more than ``hot_rows`` actions, with their range of seq."""
    total = actions.select(F.count("*")).scalar()
    return (
        actions.groupBy("session_id")
        .agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .where((F.col("n") > hot_rows) & (F.col("n") * MAX_HOT > total))
        .withColumn("cells", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(CELLS)) / total)).cast("long"))
        .withColumn("width", F.expr("(hi - lo) div cells + 1"))
    )


def _cell() -> Column:
    return F.expr("(seq - lo) div width")


def recent_bounds(actions: DataFrame, n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per hot session the smallest seq that its last ``n`` actions can have.

    Exact: the cells from the returned one on hold at least ``n`` actions.
    """
    hot = hot_sessions(actions, hot_rows)
    narrow = actions.select("session_id", "seq")
    hot_side = F.broadcast(hot.withColumnRenamed("session_id", "hot_id"))
    cells = (
        narrow.join(hot_side, F.col("session_id").eqNullSafe(F.col("hot_id")))
        .groupBy("session_id", "lo", "width", _cell().alias("cell"))
        .agg(F.count("*").alias("rows"))
    )
    # No more rows here than there are cells.
    from_the_end = Window.partitionBy("session_id").orderBy(F.col("cell").desc())
    return (
        cells.withColumn("held", F.sum("rows").over(from_the_end))
        .where(F.col("held") >= n)
        .groupBy("session_id")
        .agg(F.max(F.col("lo") + F.col("cell") * F.col("width")).alias("from_seq"))
    )


def newest(actions: DataFrame, n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The last ``n`` rows per session with ``rd``, their rank from the end."""
    bounds = F.broadcast(recent_bounds(actions, n, hot_rows).withColumnRenamed("session_id", "bound_id"))
    kept = (
        actions.join(bounds, F.col("session_id").eqNullSafe(F.col("bound_id")), "left")
        .where(F.col("from_seq").isNull() | (F.col("seq") >= F.col("from_seq")))
        .drop("bound_id", "from_seq")
    )
    # A lone row_number under its filter: each map task already cuts to n rows per session.
    return kept.withColumn("rd", F.row_number().over(newest_first(SESSION))).where(F.col("rd") <= n)


def buffer(actions: DataFrame, max_size: int = 500, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The last ``max_size`` actions per session.

    Adds ``rd`` (1 = last), ``n`` (actions in the buffer) and ``pos`` (1 = first).
    """
    return _with_positions(newest(actions, max_size, hot_rows), SESSION)


def _with_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys)).cast("int")
    return df.withColumn("n", n).withColumn("pos", F.col("n") - F.col("rd") + 1)


def last(buffered: DataFrame, n: int) -> DataFrame:
    return buffered.where(F.col("rd") <= n)


def first(buffered: DataFrame, n: int) -> DataFrame:
    return buffered.where(F.col("pos") <= n)


def files_in_window(buffered: DataFrame, n: int, keys: list[str] = SESSION) -> DataFrame:
    return _files(last(buffered, n), keys)


def early_files(buffered: DataFrame, n: int, keys: list[str] = SESSION) -> DataFrame:
    return _files(first(buffered, n), keys)


def _files(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(c.present(F.col("file_path")).isNotNull()).select(*keys, "file_path").distinct()


def actions_by_file(buffered: DataFrame, path: str) -> DataFrame:
    return buffered.where(F.col("file_path") == path)


def bash_commands(buffered: DataFrame, n: int | None = None, keys: list[str] = SESSION) -> DataFrame:
    found = buffered.where(c.is_bash(F.col("tool_type")) & c.present(F.col("command")).isNotNull())
    if n is None:
        return found
    return found.withColumn("command_rd", F.row_number().over(newest_first(keys))).where(F.col("command_rd") <= n)


def network_actions(buffered: DataFrame) -> DataFrame:
    return buffered.where(c.is_network(F.col("network_host"), F.col("network_port")))


# --- replay -----------------------------------------------------------------------

def numbered(actions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``idx``, the dense 1-based position in the whole session.

    Hot sessions are numbered cell by cell: rows are ranked inside their cell
    and shifted by the number of rows in earlier cells.
    """
    hot = F.broadcast(hot_sessions(actions, hot_rows).select(F.col("session_id").alias("hot_id"), "lo", "width"))
    celled = actions.join(hot, F.col("session_id").eqNullSafe(F.col("hot_id")), "left").withColumn(
        "cell", F.coalesce(_cell(), F.lit(0))
    ).drop("hot_id", "lo", "width")
    before = Window.partitionBy("session_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # Only hot sessions have cells beyond the first, and their number is bounded.
    offsets = F.broadcast(
        celled.groupBy("session_id", "cell")
        .agg(F.count("*").alias("rows"))
        .withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select(F.col("session_id").alias("o_id"), F.col("cell").alias("o_cell"), "offset")
        .where(F.col("o_cell") > 0)
    )
    in_cell = Window.partitionBy("session_id", "cell").orderBy("seq", "sub")
    ranked = celled.withColumn("in_cell", F.row_number().over(in_cell))
    same = F.col("session_id").eqNullSafe(F.col("o_id")) & (F.col("cell") == F.col("o_cell"))
    return (
        ranked.join(offsets, same, "left")
        .withColumn("idx", F.col("in_cell") + F.coalesce(F.col("offset"), F.lit(0)))
        .drop("in_cell", "offset", "o_id", "o_cell", "cell")
    )


def _lengths(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("session_id").agg(F.max("idx").alias("total"))


def replay(actions: DataFrame, every: int, max_size: int = 500, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The buffer as it was after every ``every``-th action, and at the session's end.

    ``snapshot_id`` k is the state after action ``k * every``; the last one of a
    session shows its final state. An action is in the buffer of at most
    ``max_size / every + 2`` snapshots, so it is copied into just those, without
    a join: the work grows with the rows.
    """
    if every < 1:
        raise ValueError("every must be positive")
    indexed = numbered(actions, hot_rows)
    first_id = F.expr(f"(idx + {every} - 1) div {every}")
    # One further than a full snapshot would reach: the last one may end early.
    last_id = F.expr(f"(idx + {max_size} + {every} - 2) div {every}")
    copies = indexed.withColumn("snapshot_id", F.explode(F.sequence(first_id, last_id)))
    # The newest action a snapshot holds is the one it was taken after; beyond the
    # session's end it belongs to an earlier snapshot. This window is partitioned
    # like everything that follows, so it adds no shuffle.
    newest_idx = F.max("idx").over(Window.partitionBy(*SNAPSHOT))
    held = (
        copies.withColumn("newest", newest_idx)
        .where(F.col("newest") > (F.col("snapshot_id") - 1) * every)
        .where(F.col("idx") > F.col("newest") - max_size)
    )
    return _as_of(held, F.col("newest"), max_size).drop("newest")


def replay_at(actions: DataFrame, snapshots: DataFrame, max_size: int = 500, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The buffer at given points: ``snapshots(session_id, snapshot_id, as_of_idx)``.

    The range join runs on equal keys: a snapshot's buffer spans at most two
    blocks of ``max_size`` positions, so both sides meet on (session, block).
    """
    return _replay_at(numbered(actions, hot_rows), snapshots, max_size)


def replay_by_time(actions: DataFrame, ticks: DataFrame, max_size: int = 500, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The buffer at moments of a clock: ``ticks(session_id, snapshot_id, tick_at)``.

    A tick shows the session as it was when the latest action at or before it, by time, then position, had come. Ticks
    before a session's first action, or of sessions that are not there, show nothing; actions without a time are in the
    buffer, but no tick ends at one. A gap between actions costs nothing, however long.
    """
    indexed = cut(numbered(actions, hot_rows))
    moments = indexed.select("session_id", F.col("timestamp").alias("acted_at"), "idx")
    latest = as_of(ticks.select("session_id", "snapshot_id", "tick_at"), moments, "tick_at", "acted_at", by=("session_id",))
    points = latest.where("match is not null").select("session_id", "snapshot_id", F.col("match.idx").alias("as_of_idx"))
    return _replay_at(indexed, points, max_size)


def _replay_at(indexed: DataFrame, snapshots: DataFrame, max_size: int) -> DataFrame:
    lengths = _lengths(indexed).select(F.col("session_id").alias("l_id"), "total")
    # Beyond the session's end a snapshot shows its final state.
    clamped = snapshots.join(lengths, F.col("session_id").eqNullSafe(F.col("l_id"))).withColumn(
        "as_of_idx", F.least("as_of_idx", "total")
    )
    here = F.expr(f"as_of_idx div {max_size}")
    points = clamped.select(
        F.col("session_id").alias("s_id"), "snapshot_id", "as_of_idx", F.explode(F.array(here, here - 1)).alias("s_block")
    )
    match = (
        F.col("session_id").eqNullSafe(F.col("s_id"))
        & (F.col("block") == F.col("s_block"))
        & (F.col("idx") <= F.col("as_of_idx"))
        & (F.col("idx") > F.col("as_of_idx") - max_size)
    )
    joined = indexed.withColumn("block", F.expr(f"idx div {max_size}")).join(points, match)
    return _as_of(joined.drop("s_id", "s_block", "block"), F.col("as_of_idx"), max_size).drop("as_of_idx")


def _as_of(copies: DataFrame, as_of: Column, max_size: int) -> DataFrame:
    n = F.least(as_of, F.lit(max_size)).cast("int")
    return (
        copies.withColumn("n", n)
        .withColumn("rd", (as_of - F.col("idx") + 1).cast("int"))
        .withColumn("pos", F.col("n") - F.col("rd") + 1)
        .drop("idx")
    )
