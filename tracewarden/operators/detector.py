"""What a detector is, and how any number of them runs in one pass.

A detector is a set of expressions over the buffer of :mod:`.buffer`:

* ``marks``: window columns added to the buffer rows, level by level,
* ``aggs``: aggregates per session over those rows,
* ``derive``: columns computed from the aggregates, level by level,
* ``warning``: a warning struct, or null when the detector stays quiet.

:func:`evaluate` puts the expressions of all given detectors into one grouped
aggregation. The buffer is already distributed and sorted by session, so running
thirty detectors costs no further shuffle or sort than running one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tracewarden.functions import classify as c
from tracewarden.model import SECURITY_WEIGHTS, is_security_category, severity_impact, severity_rank
from tracewarden.operators.buffer import SESSION

_TEXT_COLUMNS = ["file_path", "command", "error_message", "incoming_message", "outgoing_data", "skill_name"]
_OTHER_COLUMNS = [
    "tool_name", "tool_type", "success", "tokens_in", "tokens_out", "network_host", "network_port",
    "raw_content", "raw_external",
]


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    description: str
    aggs: dict[str, Column]
    warning: Column
    marks: list[Callable[[list[str]], dict[str, Column]]] = field(default_factory=list)
    derive: list[dict[str, Column]] = field(default_factory=list)

    @property
    def is_security(self) -> bool:
        return self.category in SECURITY_WEIGHTS


# --- building blocks -------------------------------------------------------------

class _Fields:
    """Columns and predicates of an action, built on use (a session must exist by then)."""

    n = property(lambda self: F.col("n"))
    tool = property(lambda self: F.col("tool_name"))
    file = property(lambda self: F.col("file_path"))
    command = property(lambda self: F.col("command"))
    error = property(lambda self: F.col("error_message"))
    skill = property(lambda self: F.col("skill_name"))
    host = property(lambda self: F.nullif(F.col("network_host"), F.lit("")))
    port = property(lambda self: F.nullif(F.col("network_port"), F.lit(0)))
    failed = property(lambda self: ~F.col("success"))
    read = property(lambda self: c.is_file_read(F.col("tool_type")))
    edit = property(lambda self: c.is_file_edit(F.col("tool_type")))
    bash = property(lambda self: c.is_bash(F.col("tool_type")))
    network = property(lambda self: c.is_network(F.col("network_host"), F.col("network_port")))


A = _Fields()


def within(window: int) -> Column:
    return F.col("rd") <= window


def first_hit(condition: Column, value: Column) -> Column:
    """``value`` on the earliest row that fulfils ``condition``."""
    # The value too is only computed where it counts.
    return F.min_by(F.when(condition, value), F.when(condition, F.col("pos")))


def last_hit(condition: Column, value: Column) -> Column:
    return F.max_by(F.when(condition, value), F.when(condition, F.col("pos")))


def rows_in_order(condition: Column, **fields: Column) -> Column:
    """The rows of a bounded window as an array ordered by position."""
    row = F.struct(F.col("pos").alias("pos"), *[v.alias(k) for k, v in fields.items()])
    return F.array_sort(F.collect_list(F.when(condition, row)))


def top_entry(values: Column) -> Column:
    """Most frequent element and its count; the one seen first wins a tie."""
    distinct = F.array_distinct(values)
    counts = F.transform(distinct, lambda d: F.size(F.filter(values, lambda v: v == d)))
    best = F.array_max(counts)
    key = F.get(distinct, F.array_position(counts, best).cast("int") - 1)
    return F.struct(key.alias("key"), F.coalesce(best, F.lit(0)).alias("count"))


def js(value: Column) -> Column:
    return F.to_json(value)


def warn(
    category: str,
    severity: str | Column,
    signal: str | Column,
    message: str | Column,
    suggestion: str | Column | None = None,
    **details: Column,
) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(category).alias("category"),
        lit(severity).alias("severity"),
        lit(signal).alias("signal"),
        lit(message).alias("message"),
        lit(suggestion).cast("string").alias("suggestion"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"),
    )


# --- running -----------------------------------------------------------------------

def evaluate(buffered: DataFrame, detectors: list[Detector], keys: list[str] = SESSION) -> DataFrame:
    """One row per session: keys, ``n`` and ``results``, one nullable warning per detector."""
    df = buffered.select(
        *keys, "seq", "sub", "rd", "pos", "n",
        *[c.present(F.col(name)).alias(name) for name in _TEXT_COLUMNS],
        *_OTHER_COLUMNS,
    )
    for i in range(max((len(d.marks) for d in detectors), default=0)):
        df = df.withColumns({k: v for d in detectors if i < len(d.marks) for k, v in d.marks[i](keys).items()})
    aggs = [v.alias(k) for d in detectors for k, v in d.aggs.items()]
    out = df.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    for i in range(max((len(d.derive) for d in detectors), default=0)):
        out = out.withColumns({k: v for d in detectors if i < len(d.derive) for k, v in d.derive[i].items()})
    return out.select(*keys, "n", F.array(*[d.warning for d in detectors]).alias("results"))


def explode_warnings(evaluated: DataFrame, detectors: list[Detector], keys: list[str] = SESSION) -> DataFrame:
    """One row per warning, in detector order."""
    rows = evaluated.select(*keys, F.posexplode("results").alias("detector_ord", "w")).where(F.col("w").isNotNull())
    names = F.array(*[F.lit(d.name) for d in detectors])
    return rows.select(
        *keys,
        "detector_ord",
        F.get(names, F.col("detector_ord")).alias("detector"),
        "w.*",
        is_security_category(F.col("w.category")).alias("is_security"),
        severity_impact(F.col("w.severity")).alias("impact"),
        severity_rank(F.col("w.severity")).alias("severity_ord"),
    )


def detect(buffered: DataFrame, detectors: list[Detector], keys: list[str] = SESSION) -> DataFrame:
    return explode_warnings(evaluate(buffered, detectors, keys), detectors, keys)
