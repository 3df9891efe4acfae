"""Turns: groups of actions between two model outputs, and adaptive windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewarden.functions import classify as c
from tracewarden.operators.buffer import SESSION, newest_first
from tracewarden.operators.detector import A


def _output() -> Column:
    return c.present(F.col("outgoing_data"))


def _file() -> Column:
    return c.present(F.col("file_path"))


def _starts_turn() -> Column:
    """An action with output opens a turn, unless it is the first of the buffer."""
    return (_output().isNotNull() & (F.col("pos") > 1)).cast("int")


def with_turns(buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Add ``turn_idx`` (0-based), counted in the buffer's own newest-first order."""
    later = newest_first(keys).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(_starts_turn()).over(Window.partitionBy(*keys))
    after = F.coalesce(F.sum(_starts_turn()).over(later), F.lit(0))
    return buffered.withColumn("turn_idx", (total - after).cast("int"))


def turn_aggregates() -> list[Column]:
    return [
        # Only the first action of a turn can carry its output.
        F.min_by(_output(), "pos").alias("model_output"),
        F.count("*").alias("action_count"),
        F.bool_or(A.edit).alias("has_edit"),
        F.bool_or(A.bash & F.col("success")).alias("has_successful_bash"),
        F.bool_or(F.col("tool_type").isin("read", "search")).alias("has_code_exploration"),
        F.collect_set(F.when(A.edit, _file())).alias("edited_files"),
    ]


def turns(buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """One row per turn. Grouping by (keys, turn) reuses the buffer's distribution."""
    return (
        with_turns(buffered, keys)
        .groupBy(*keys, "turn_idx")
        .agg(
            *turn_aggregates(),
            F.collect_set(_file()).alias("touched_files"),
            F.count_if(A.failed).alias("failed_actions"),
        )
        .withColumn("model_output", F.coalesce("model_output", F.lit("")))
    )


def turn_counts(buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    return buffered.groupBy(*keys).agg((F.sum(_starts_turn()) + 1).cast("int").alias("n_turns"))


def scaled_window(size: Column, base: int, fraction: float, cap: int) -> Column:
    return F.greatest(F.lit(base), F.least(F.lit(cap), F.floor(size * F.lit(fraction)))).cast("int")


def action_window(n: Column) -> Column:
    return scaled_window(n, 20, 0.15, 100)


def turn_window(n_turns: Column) -> Column:
    return scaled_window(n_turns, 8, 0.20, 30)


def maturity(n_turns: Column, any_edit: Column, exploration_turns: Column) -> Column:
    """Weight of progress penalties: full once coding or exploring has started."""
    return (
        F.when(n_turns == 0, 0.0)
        .when(any_edit | (exploration_turns >= 3), 1.0)
        .otherwise(F.least(n_turns / F.lit(10.0), F.lit(1.0)))
    )


def session_shape(buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Adaptive windows and maturity per session."""
    return (
        turns(buffered, keys)
        .groupBy(*keys)
        .agg(
            F.sum("action_count").alias("n"),
            F.count("*").alias("n_turns"),
            F.bool_or("has_edit").alias("any_edit"),
            F.count_if("has_code_exploration").alias("exploration_turns"),
        )
        .select(
            *keys,
            "n",
            "n_turns",
            action_window(F.col("n")).alias("action_window"),
            turn_window(F.col("n_turns")).alias("turn_window"),
            maturity(F.col("n_turns"), F.col("any_edit"), F.col("exploration_turns")).alias("maturity"),
        )
    )
