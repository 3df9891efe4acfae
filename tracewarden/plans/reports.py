"""End-to-end reports over an action table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewarden.functions import fixed_values as fv
from tracewarden.operators import score
from tracewarden.operators.buffer import buffer
from tracewarden.operators.registry import Registry, create_registry
from tracewarden.operators.rot import Constraints, rot_report


def check(actions: DataFrame, security: bool = False, max_size: int = 500, theme: str = fv.DEFAULT_THEME) -> DataFrame:
    """One-shot health check: detectors only."""
    evaluated = create_registry("all" if security else "health").evaluate(buffer(actions, max_size))
    return score.health_report(evaluated, include_security=security, theme=theme)


def security_scan(actions: DataFrame, max_size: int = 500) -> DataFrame:
    return score.security_report(create_registry("security").evaluate(buffer(actions, max_size)))


def session_health(
    actions: DataFrame,
    registry: Registry | None = None,
    rules: Constraints = Constraints(),
    max_size: int = 500,
    include_security: bool = False,
    weights: score.BlendWeights = score.BlendWeights(),
    as_of: Column | None = None,
    theme: str = fv.DEFAULT_THEME,
) -> DataFrame:
    """Detectors, efficiency and rot blended into one report per session."""
    registry = registry or create_registry("all" if include_security else "health")
    buffered = buffer(actions, max_size)
    eff = score.session_efficiency(actions, buffered, as_of, theme).select(
        F.col("session_id").alias("e_id"), F.col("score").alias("efficiency_score")
    )
    rot = rot_report(buffered, rules=rules, theme=theme).select(
        F.col("session_id").alias("r_id"), F.col("smoothed_score").alias("rot_score"), F.col("state_label").alias("rot_state"),
        "top_reasons",
    )
    same_e = F.col("session_id").eqNullSafe(F.col("e_id"))
    same_r = F.col("session_id").eqNullSafe(F.col("r_id"))
    joined = registry.evaluate(buffered).join(eff, same_e).join(rot, same_r)
    extra = ["efficiency_score", "rot_score", "rot_state", "top_reasons"]
    return score.health_report(
        joined, ["session_id", *extra], include_security, F.col("efficiency_score"), F.col("rot_score"), weights, theme
    )


def report_json(report: DataFrame, keys: list[str] = ["session_id"]) -> DataFrame:
    """Reports as one JSON document per row."""
    body = [c for c in report.columns if c not in keys]
    return report.select(*keys, F.to_json(F.struct(*body)).alias("report"))


def write_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(path)
