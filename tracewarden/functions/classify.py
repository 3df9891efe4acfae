"""Column functions that classify and normalise action fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from tracewarden.functions import fixed_values as fv


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column) -> Column:
    """Empty text counts as absent."""
    return F.nullif(value, F.lit(""))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def classify_tool(name: Column) -> Column:
    lowered = F.lower(name)
    expr = F.when(F.lit(False), "")
    for tool_type, parts in fv.TOOL_NAME_RULES.items():
        expr = expr.when(contains_any(lowered, parts), tool_type)
    return expr.otherwise("unknown")


def is_file_read(tool_type: Column) -> Column:
    return tool_type == "read"


def is_file_edit(tool_type: Column) -> Column:
    return tool_type.isin("write", "edit")


def is_bash(tool_type: Column) -> Column:
    return tool_type == "bash"


def is_network(host: Column, port: Column) -> Column:
    return host.isNotNull() | port.isNotNull()


def is_sensitive_path(path: Column) -> Column:
    return F.coalesce(path.rlike(fv.any_of(fv.SENSITIVE_PATHS)), F.lit(False))


def classify_error(message: Column) -> Column:
    expr = F.when(message.isNull(), F.lit(None).cast("string"))
    for pattern, error_class in fv.ERROR_CLASSES:
        expr = expr.when(message.rlike(fv.any_of([pattern])), error_class)
    return expr.otherwise(fv.UNKNOWN_ERROR_CLASS)


def strip(text: Column) -> Column:
    """Cut white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_error(message: Column) -> Column:
    """Error text without line numbers and Python paths, at most 200 characters."""
    text = F.regexp_replace(message, r"(?U)line \d+", "line N")
    text = F.regexp_replace(text, r"(?U):\d+:\d+", ":N:N")
    text = F.regexp_replace(text, r"(?U)/[\w/.-]+\.py", "FILE.py")
    return F.left(strip(text), F.lit(200))


def error_signature(message: Column) -> Column:
    """Error text with every volatile part (line, address, path, number) masked."""
    volatile = r"(?U)line \d+|0x[0-9a-f]+|/[\w./\-]+|\d{2,}"
    return strip(F.regexp_replace(F.lower(message), volatile, "<X>"))


def call_signature(tool: Column, path: Column, command: Column) -> Column:
    text = F.concat_ws("|", tool, F.coalesce(path, F.lit("")), F.coalesce(command, F.lit("")))
    return F.left(F.md5(text), F.lit(12))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def project_name(directory: Column) -> Column:
    """Last component of a directory, ignoring trailing slashes."""
    return basename(F.regexp_replace(directory, "/+$", ""))


def team_name(agent_type: Column, project: Column) -> Column:
    return F.concat_ws(":", agent_type, project)


def flatten_nested(value: Column, depth: int) -> Column:
    """Flatten an array nested ``depth`` times; the nesting is part of the schema."""
    for _ in range(depth):
        value = F.flatten(value)
    return value


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even, as Python's ``round`` does.

    The fraction behind the last digit is computed without rounding error: both
    halves of the split mantissa fit a double when scaled. For values whose
    scaled size stays below 2**53.
    """
    scale = F.lit(float(10**digits))

    def rounded(x: Column) -> Column:
        split = x * F.lit(134217729.0)
        high = split - (split - x)
        whole = F.floor(x * scale)
        over_half = ((high * scale - whole) - 0.5) + (x - high) * scale
        up = (over_half > 0) | ((over_half == 0) & (whole % 2 != 0))
        return (whole + F.when(up, 1).otherwise(0)) / scale

    return let(value, rounded)
