"""Table schemas and dimensions shared by every operator.

An *action* is one step of an agent session. Actions are ordered inside a
session by ``(seq, sub)``: ``seq`` only has to grow along the log (line order,
event time, ...) and need not be dense; ``sub`` breaks ties inside one line.
Nothing is ever ordered by the log's own timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ORDER = ("seq", "sub")

ACTION_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("sub", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_type", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("cache_creation_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("incoming_message", T.StringType()),
        T.StructField("outgoing_data", T.StringType()),
        T.StructField("network_host", T.StringType()),
        T.StructField("network_port", T.IntegerType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("skill_name", T.StringType()),
        # What the injection rules read from the raw log entry: its content
        # rendered as text, and the first of content/output that is a string.
        T.StructField("raw_content", T.StringType()),
        T.StructField("raw_external", T.StringType()),
    ]
)

ACTION_COLUMNS = [f.name for f in ACTION_SCHEMA]

_ZERO_WHEN_ABSENT = {
    "sub", "tokens_in", "tokens_out", "cache_creation_tokens", "cache_read_tokens",
    "duration_ms", "cost_usd",
}


def as_actions(df: DataFrame) -> DataFrame:
    """Complete ``df`` to the action schema: absent columns get their default."""
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        if field.name in have:
            # An explicit timestamp type (with or without zone) is kept.
            if field.name == "timestamp":
                return F.col("timestamp")
            value = F.col(field.name).cast(field.dataType)
            return F.coalesce(value, F.lit(0).cast(field.dataType)) if field.name in _ZERO_WHEN_ABSENT else value
        if field.name in _ZERO_WHEN_ABSENT:
            default = F.lit(0)
        elif field.name == "success":
            default = F.lit(True)
        else:
            default = F.lit(None)
        return default.cast(field.dataType)

    return df.select(*[column(f).alias(f.name) for f in ACTION_SCHEMA])


# Categories with their weight in the overall score.
HEALTH_WEIGHTS = {"progress": 0.35, "errors": 0.30, "context": 0.20, "goal": 0.15}
SECURITY_WEIGHTS = {
    "credential": 0.20,
    "injection": 0.25,
    "exfiltration": 0.20,
    "privilege": 0.15,
    "network": 0.10,
    "supply_chain": 0.10,
}
CATEGORIES = [*HEALTH_WEIGHTS, *SECURITY_WEIGHTS]

# Severity -> (points taken off a score, display symbol).
SEVERITIES = {"low": (5, "💡"), "medium": (15, "⚠️"), "high": (30, "🔴"), "critical": (50, "🚨")}
SEVERITY_ORDER = ["critical", "high", "medium", "low"]


def severity_impact(severity: Column) -> Column:
    expr = F.when(F.lit(False), 0)
    for name, (impact, _) in SEVERITIES.items():
        expr = expr.when(severity == name, impact)
    return expr


def severity_rank(severity: Column) -> Column:
    """0 for the worst severity."""
    expr = F.when(F.lit(False), 0)
    for rank, name in enumerate(SEVERITY_ORDER):
        expr = expr.when(severity == name, rank)
    return expr.otherwise(len(SEVERITY_ORDER))


def is_security_category(category: Column) -> Column:
    return category.isin(*SECURITY_WEIGHTS)


def dim_category(spark: SparkSession) -> DataFrame:
    rows = [(c, c in SECURITY_WEIGHTS, {**HEALTH_WEIGHTS, **SECURITY_WEIGHTS}[c]) for c in CATEGORIES]
    return spark.createDataFrame(rows, "category string, is_security boolean, weight double")


def dim_severity(spark: SparkSession) -> DataFrame:
    rows = [(s, SEVERITIES[s][0], SEVERITIES[s][1], i) for i, s in enumerate(SEVERITY_ORDER)]
    return spark.createDataFrame(rows, "severity string, impact int, emoji string, ord int")
