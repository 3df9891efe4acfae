"""Health detectors: loops, stuck patterns, errors and context."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from tracewarden.functions import classify as c, fixed_values as fv
from tracewarden.operators.buffer import newest_first
from tracewarden.operators.detector import A, Detector, js, last_hit, rows_in_order, top_entry, warn, within



def _text(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def _filled(value: Column, text: Column, other: Column | str = "") -> Column:
    return F.when(value.isNotNull(), text).otherwise(other if isinstance(other, Column) else F.lit(other))


def _cut(value: Column, size: int) -> Column:
    return F.left(value, F.lit(size))


def loop(name: str = "loop", threshold: int = 4, window: int = 10) -> Detector:
    rows, top = f"{name}__rows", f"{name}__top"
    call = F.concat(F.col("tool_name"), F.lit(":"), F.coalesce(A.file, F.lit("")))
    key, count = F.col(f"{top}.key"), F.col(f"{top}.count")

    def latest(field: str) -> Column:
        same = F.filter(F.col(rows), lambda r: (r["call"] == key) & r[field].isNotNull())
        return F.get(same, F.size(same) - 1)[field]

    tool, path = F.substring_index(key, ":", 1), F.regexp_replace(key, "^[^:]*:", "")
    cmd, err = F.col(f"{name}__cmd"), F.col(f"{name}__err")
    advice = F.when(
        cmd.isNotNull() & err.isNotNull(),
        F.concat(F.lit('The command "'), _cut(cmd, 80), F.lit('" keeps failing — try a fundamentally different approach.')),
    ).otherwise("Consider whether a different strategy is needed.")
    return Detector(
        name, "progress", "Agent performing same action repeatedly",
        aggs={rows: rows_in_order(within(window), call=call, command=A.command, error=A.error)},
        derive=[
            {top: top_entry(F.transform(F.col(rows), lambda r: r["call"]))},
            {f"{name}__cmd": latest("command"), f"{name}__err": latest("error")},
        ],
        warning=F.when(
            (A.n >= window) & (count >= threshold),
            warn(
                "progress",
                F.when(count < 6, "medium").otherwise("high"),
                "loop",
                F.concat(
                    F.lit("Repeated action: "), tool, F.when(path != "", F.concat(F.lit(" on "), path)).otherwise(""),
                    F.lit(" ("), count, F.lit("x)"),
                ),
                F.concat(F.lit("The exact same action is being repeated. "), advice),
                tool=tool, path=c.present(path), count=count, last_command=cmd, last_error=err,
            ),
        ),
    )


def reread(name: str = "reread", threshold: int = 3, window: int = 15) -> Detector:
    rows, found = f"{name}__rows", f"{name}__found"
    files = F.transform(F.col(rows), lambda r: r["file"])
    counted = F.transform(
        F.array_distinct(files),
        lambda f: F.struct(f.alias("file"), F.size(F.filter(files, lambda g: g == f)).alias("count")),
    )
    path, count = F.col(f"{found}.file"), F.col(f"{found}.count")
    return Detector(
        name, "progress", "Agent re-reading same file multiple times",
        aggs={rows: rows_in_order(within(window) & A.read & A.file.isNotNull(), file=A.file)},
        # The first file that reaches the threshold, not the worst one.
        derive=[{found: F.get(F.filter(counted, lambda x: x["count"] >= threshold), F.lit(0))}],
        warning=F.when(
            (A.n >= window) & path.isNotNull(),
            warn(
                "progress",
                F.when(count < 5, "low").otherwise("medium"),
                "reread",
                _text("Re-reading file: %s (%dx)", path, count),
                _text(
                    "Reading the same file %d times suggests the agent isn't retaining what it reads. "
                    "The file content may be too long, or the agent is losing context.", count,
                ),
                path=path, count=count,
            ),
        ),
    )


def thrash(name: str = "thrash", threshold: int = 3, window: int = 20) -> Detector:
    rows, found, err = f"{name}__rows", f"{name}__found", f"{name}__err"
    hit = f"{name}__hit"

    def marks(keys: list[str]) -> dict[str, Column]:
        # Newest first: the next three actions are the three preceding rows.
        following = newest_first(keys).rowsBetween(-3, -1)
        failing = F.max((A.bash & A.failed).cast("int")).over(following)
        # The last two actions of the window never start a cycle.
        return {hit: within(window) & (F.col("rd") > 2) & A.edit & A.file.isNotNull() & (failing == 1)}

    files = F.transform(F.col(rows), lambda r: r["file"])
    counted = F.transform(
        F.array_distinct(files),
        lambda f: F.struct(f.alias("file"), F.size(F.filter(files, lambda g: g == f)).alias("count")),
    )
    path, count = F.col(f"{found}.file"), F.col(f"{found}.count")
    return Detector(
        name, "progress", "Repeated edit→test→fail cycle",
        marks=[marks],
        aggs={
            rows: rows_in_order(F.col(hit), file=A.file),
            err: last_hit(within(window) & A.bash & A.failed & A.error.isNotNull(), _cut(A.error, 120)),
        },
        derive=[{found: F.get(F.filter(counted, lambda x: x["count"] >= threshold), F.lit(0))}],
        warning=F.when(
            (A.n >= window) & path.isNotNull(),
            warn(
                "progress", "high", "thrash",
                _text("Edit→test→fail cycle on %s (%dx)", path, count),
                F.concat(
                    _text("Edits to %s keep failing tests. ", path),
                    _filled(F.col(err), _text('Last error: "%s". ', F.col(err))),
                    F.lit("Stop editing and re-examine the approach."),
                ),
                path=path, count=count, last_error=F.col(err),
            ),
        ),
    )


def stall(name: str = "stall", window: int = 15, min_edits: int = 1, max_reads: int = 8) -> Detector:
    reads, edits, ok, files = (F.col(f"{name}__{x}") for x in ("reads", "edits", "ok", "files"))
    shown = F.slice(F.array_sort(files), 1, 5)
    return Detector(
        name, "progress", "No meaningful progress detected",
        aggs={
            f"{name}__reads": F.count_if(within(window) & A.read),
            f"{name}__edits": F.count_if(within(window) & A.edit),
            f"{name}__ok": F.count_if(within(window) & A.bash & F.col("success")),
            f"{name}__files": F.collect_set(F.when(within(window) & A.read, A.file)),
        },
        warning=F.when(
            (A.n >= window) & (reads > max_reads) & (edits < min_edits) & (ok < 2),
            warn(
                "progress", "medium", "stall",
                _text("Lots of reading (%d), minimal writing (%d)", reads, edits),
                _text(
                    "The agent is reading but not acting. Files being read: %s. It may be stuck deciding what to do.",
                    F.array_join(shown, ", "),
                ),
                reads=reads, edits=edits, successful_bash=ok, files_being_read=js(shown),
            ),
        ),
    )


def same_outcome(name: str = "same_outcome", threshold: int = 3, window: int = 25) -> Detector:
    rows, top, pair = f"{name}__rows", f"{name}__top", f"{name}__pair"

    def marks(keys: list[str]) -> dict[str, Column]:
        failure = F.when(
            within(window) & A.bash & A.failed & A.error.isNotNull(),
            F.struct(c.classify_error(A.error).alias("kind"), A.error.alias("message")),
        )
        # Nearest of the next four actions = last non-null of the four preceding rows.
        following = newest_first(keys).rowsBetween(-4, -1)
        return {pair: F.when(within(window) & A.edit, F.last(failure, ignorenulls=True).over(following))}

    key, count = F.col(f"{top}.key"), F.col(f"{top}.count")
    edits = F.col(f"{name}__edits")
    same = F.filter(F.col(rows), lambda r: r["kind"] == key)
    example = _cut(F.get(same, F.size(same) - 1)["message"], 120)
    found = F.col(pair)
    return Detector(
        name, "progress", "Different fixes producing the same error",
        marks=[marks],
        aggs={
            rows: rows_in_order(found.isNotNull(), kind=found["kind"], message=found["message"]),
            f"{name}__edits": F.count_if(within(window) & A.edit),
        },
        derive=[
            {top: top_entry(F.transform(F.col(rows), lambda r: r["kind"]))},
            {f"{name}__example": example},
        ],
        warning=F.when(
            (A.n >= window) & (count >= threshold),
            warn(
                "progress",
                F.when(count >= 5, "high").otherwise("medium"),
                "same_outcome",
                _text("Tried %d different edits but keep hitting %s (%dx)", edits, key, count),
                _text(
                    "The edits aren't resolving the root cause. Consider stepping back and re-reading the error: \"%s\"",
                    F.col(f"{name}__example"),
                ),
                error_class=key, occurrences=count, total_edits=edits, last_error=F.col(f"{name}__example"),
            ),
        ),
    )


def file_churn(name: str = "file_churn", threshold: int = 4, window: int = 30) -> Detector:
    rows, top, err, reset = (f"{name}__{x}" for x in ("rows", "top", "err", "reset"))

    files = F.transform(
        F.filter(F.col(rows), lambda r: r["pos"] > F.coalesce(F.col(reset), F.lit(0))), lambda r: r["file"]
    )
    key, count = F.col(f"{top}.key"), F.col(f"{top}.count")
    kept = F.col(f"{name}__files")
    others = F.filter(
        F.transform(
            F.array_distinct(kept),
            lambda f: F.struct(f.alias("k"), F.size(F.filter(kept, lambda g: g == f)).alias("v")),
        ),
        lambda e: (e["v"] >= threshold) & (e["k"] != key),
    )
    error = F.col(err)
    return Detector(
        name, "progress", "File edited repeatedly without successful test",
        aggs={
            rows: rows_in_order(within(window) & A.edit & A.file.isNotNull(), file=A.file),
            reset: F.max(F.when(within(window) & A.bash & F.col("success"), F.col("pos"))),
            err: last_hit(within(window) & A.bash & A.failed & A.error.isNotNull(), _cut(A.error, 120)),
        },
        derive=[{f"{name}__files": files}, {top: top_entry(kept)}],
        warning=F.when(
            (A.n >= window) & (count >= threshold),
            warn(
                "progress",
                F.when(count >= 6, "high").otherwise("medium"),
                "file_churn",
                _text("Edited %s %dx with no successful test in between", key, count),
                F.concat(
                    F.lit(
                        "Stop editing and re-read the file from scratch. "
                        "The repeated edits suggest a misunderstanding of the code."
                    ),
                    _filled(error, _text(' Last error: "%s"', error)),
                ),
                file=key, edit_count=count, last_error=error,
                other_churned_files=js(F.map_from_entries(others)),
            ),
        ),
    )


def exploration_stall(name: str = "exploration_stall", stale_window: int = 20, min_actions: int = 25) -> Detector:
    recent, earlier = F.col(f"{name}__recent"), F.col(f"{name}__earlier")
    edits, errors = F.col(f"{name}__edits"), F.col(f"{name}__errors")
    shown = F.slice(F.array_sort(recent), 1, 5)
    size = F.lit(stale_window)
    return Detector(
        name, "progress", "No new files explored despite continued activity",
        aggs={
            f"{name}__recent": F.collect_set(F.when(within(stale_window), A.file)),
            f"{name}__earlier": F.collect_set(F.when(~within(stale_window), A.file)),
            f"{name}__edits": F.count_if(within(stale_window) & A.edit),
            f"{name}__errors": F.count_if(within(stale_window) & A.failed),
        },
        warning=F.when(
            (A.n >= min_actions) & (A.n - stale_window >= 5) & (size >= 10)
            & (F.size(recent) > 0) & (F.size(F.array_except(recent, earlier)) == 0),
            warn(
                "progress",
                F.when(errors < 5, "medium").otherwise("high"),
                "exploration_stall",
                _text("Last %d actions only touched %d known file(s), no new files explored", size, F.size(recent)),
                _text(
                    "The agent is circling the same files: %s. Consider reading related files or taking a "
                    "different approach entirely.", F.array_join(shown, ", "),
                ),
                recent_action_count=size, unique_recent_files=F.size(recent), files=js(shown),
                recent_edits=edits, recent_errors=errors, total_known_files=F.size(earlier),
            ),
        ),
    )


def error_class_persistence(
    name: str = "error_class_persistence", threshold: int = 4, window: int = 20, min_edits_between: int = 2
) -> Detector:
    rows, top = f"{name}__rows", f"{name}__top"
    key, count, edits = F.col(f"{top}.key"), F.col(f"{top}.count"), F.col(f"{name}__edits")
    kinds = F.transform(F.col(rows), lambda r: r["kind"])
    samples = F.slice(
        F.array_distinct(F.transform(F.filter(F.col(rows), lambda r: r["kind"] == key), lambda r: r["message"])), 1, 3
    )
    distinct = F.array_distinct(kinds)
    histogram = F.map_from_arrays(
        distinct, F.transform(distinct, lambda d: F.size(F.filter(kinds, lambda k: k == d)))
    )
    return Detector(
        name, "errors", "Same type of error persisting despite different fixes",
        aggs={
            rows: rows_in_order(
                within(window) & A.bash & A.failed & A.error.isNotNull(), kind=c.classify_error(A.error), message=A.error
            ),
            f"{name}__edits": F.count_if(within(window) & A.edit),
        },
        derive=[{top: top_entry(kinds)}],
        warning=F.when(
            (A.n >= window) & (count >= threshold) & (edits >= min_edits_between),
            warn(
                "errors",
                F.when(count >= 6, "high").otherwise("medium"),
                "error_class_persistence",
                _text("%s persisting across %d edits (%d failures)", key, edits, count),
                _text(
                    "The root cause isn't being addressed. The error type is consistently %s — focus on why that "
                    "specific error class keeps occurring rather than patching symptoms.", key,
                ),
                error_class=key, failure_count=count, total_edits=edits, sample_errors=js(samples),
                all_error_classes=js(histogram),
            ),
        ),
    )


def error_spiral(name: str = "error_spiral", threshold: int = 3) -> Detector:
    span = threshold + 2
    since = F.coalesce(F.col(f"{name}__ok"), F.least(A.n, F.lit(span)) + 1)
    run = since - 1
    newest = F.transform(F.reverse(F.col(f"{name}__rows")), lambda r: r["message"])
    return Detector(
        name, "errors", "Multiple consecutive failures",
        aggs={
            f"{name}__ok": F.min(F.when(within(span) & F.col("success"), F.col("rd"))),
            f"{name}__rows": rows_in_order(within(span) & A.failed & A.error.isNotNull(), message=_cut(A.error, 100)),
        },
        warning=F.when(
            (A.n >= threshold) & (run >= threshold),
            warn(
                "errors", "high", "error_spiral",
                _text("Error spiral: %d consecutive failures", run),
                "Nothing has succeeded recently. Consider reverting recent changes or trying a completely different "
                "approach.",
                consecutive_failures=run, recent_errors=js(F.slice(newest, 1, 3)),
            ),
        ),
    )


def error_blindness(name: str = "error_blindness", threshold: int = 3, window: int = 15) -> Detector:
    rows, top = f"{name}__rows", f"{name}__top"
    key, count = F.col(f"{top}.key"), F.col(f"{top}.count")
    return Detector(
        name, "errors", "Same error repeated without fix",
        aggs={rows: rows_in_order(within(window) & A.failed & A.error.isNotNull(), message=c.normalize_error(A.error))},
        derive=[{top: top_entry(F.transform(F.col(rows), lambda r: r["message"]))}],
        warning=F.when(
            (A.n >= window) & (count >= threshold),
            warn(
                "errors", "high", "error_blindness",
                _text("Same error repeated %dx without fix", count),
                _text(
                    'The error "%s" keeps appearing unchanged. The agent isn\'t reading or addressing the error '
                    "message.", _cut(key, 80),
                ),
                error_pattern=_cut(key, 100), count=count,
            ),
        ),
    )


def syntax_loop(name: str = "syntax_loop", threshold: int = 3, window: int = 15) -> Detector:
    samples = F.transform(F.col(f"{name}__rows"), lambda r: r["message"])
    count = F.size(samples)
    return Detector(
        name, "errors", "Repeated syntax/import errors",
        aggs={
            f"{name}__rows": rows_in_order(
                within(window) & A.error.rlike(fv.any_of(fv.SYNTAX_ERRORS)), message=_cut(A.error, 100)
            )
        },
        warning=F.when(
            (A.n >= window) & (count >= threshold),
            warn(
                "errors", "medium", "syntax_loop",
                _text("Repeated syntax/import errors (%dx)", count),
                _text(
                    "Recurring syntax/import errors suggest a structural issue. Errors seen: %s",
                    F.array_join(F.slice(samples, 1, 2), "; "),
                ),
                count=count, sample_errors=js(F.slice(samples, 1, 3)),
            ),
        ),
    )


def high_error_rate(
    name: str = "high_error_rate", threshold: float = 0.6, window: int = 20, min_actions: int = 10
) -> Detector:
    failures = F.col(f"{name}__failures")
    total = F.least(A.n, F.lit(window))
    rate = failures / total
    return Detector(
        name, "errors", "Unusually high failure rate",
        aggs={f"{name}__failures": F.count_if(within(window) & A.failed)},
        warning=F.when(
            (A.n >= min_actions) & (rate >= threshold),
            warn(
                "errors",
                F.when(rate > 0.75, "high").otherwise("medium"),
                "high_error_rate",
                _text(
                    "High error rate: %d%% of actions failing (%d/%d)", F.floor(rate * 100), failures, total
                ),
                _text(
                    "%d out of %d recent actions failed. The agent may be in an unrecoverable state for this approach.",
                    failures, total,
                ),
                error_rate=F.round(rate, 2), failures=failures, total=total,
            ),
        ),
    )


def context_rot(
    name: str = "context_rot", early_fraction: float = 0.25, recent_window: int = 50, min_actions: int = 40
) -> Detector:
    rows = F.col(f"{name}__early")
    early_rows = F.col("pos") <= F.greatest(F.lit(15), F.floor(A.n * early_fraction))
    edited = F.transform(F.filter(rows, lambda r: r["edited"]), lambda r: r["file"])
    recent = F.col(f"{name}__recent")
    files = F.transform(rows, lambda r: r["file"])
    # In order of first appearance.
    forgotten = F.array_except(F.array_intersect(files, edited), recent)
    count = F.size(forgotten)
    return Detector(
        name, "context", "Important early files no longer being referenced",
        aggs={
            f"{name}__early": rows_in_order(early_rows & A.file.isNotNull(), file=A.file, edited=A.edit),
            f"{name}__recent": F.collect_set(F.when(within(recent_window), A.file)),
        },
        warning=F.when(
            (A.n >= min_actions) & (count >= 2),
            warn(
                "context", "medium", "context_rot",
                _text("%d early files not referenced recently", count),
                forgotten_files=js(F.slice(forgotten, 1, 5)),
                total_early=F.size(F.array_distinct(files)), total_recent=F.size(recent),
            ),
        ),
    )


def action_tokens() -> Column:
    """Logged tokens of an action, or an estimate by its type."""
    expr = F.when((F.col("tokens_in") != 0) | (F.col("tokens_out") != 0), F.col("tokens_in") + F.col("tokens_out"))
    for tool_type, tokens in fv.TOKENS_PER_ACTION.items():
        expr = expr.when(F.col("tool_type") == tool_type, tokens)
    return expr.otherwise(fv.TOKENS_PER_OTHER_ACTION)


def context_pressure(
    name: str = "context_pressure",
    warning_threshold: float = 0.7,
    critical_threshold: float = 0.85,
    model: str = "claude",
) -> Detector:
    limit = fv.CONTEXT_LIMITS.get(model, fv.CONTEXT_LIMITS["default"])
    tokens = F.col(f"{name}__tokens")
    ratio = tokens / limit
    critical = ratio >= critical_threshold
    percent = F.floor(ratio * 100)
    return Detector(
        name, "context", "Context window filling up",
        aggs={f"{name}__tokens": F.sum(action_tokens())},
        warning=F.when(
            (A.n >= 10) & (critical | (ratio >= warning_threshold)),
            warn(
                "context",
                F.when(critical, "high").otherwise("medium"),
                F.when(critical, "context_critical").otherwise("context_pressure"),
                _text("Context window ~%d%% full", percent),
                estimated_tokens=tokens, usage_percent=percent, limit=F.lit(limit),
            ),
        ),
    )


def rediscovery(name: str = "rediscovery", window: int = 200, rediscovery_gap: int = 30) -> Detector:
    gap = f"{name}__gap"
    read = within(window) & A.read & A.file.isNotNull()

    def marks(keys: list[str]) -> dict[str, Column]:
        # Reads of one file, newest first: the following row is the read before this one.
        same_file = Window.partitionBy(*keys, F.when(read, A.file)).orderBy(F.col("seq").desc(), F.col("sub").desc())
        return {gap: F.when(read, F.col("pos") - F.lead("pos").over(same_file))}

    top = F.col(f"{name}__top")
    return Detector(
        name, "context", "Agent re-discovering previously learned information",
        marks=[marks],
        aggs={f"{name}__rows": rows_in_order(F.col(gap) >= rediscovery_gap, file=A.file)},
        derive=[{f"{name}__top": top_entry(F.transform(F.col(f"{name}__rows"), lambda r: r["file"]))}],
        warning=F.when(
            (A.n >= window) & (top["count"] >= 2),
            warn(
                "context", "low", "rediscovery",
                _text("Re-reading %s after long gaps (%dx)", top["key"], top["count"]),
                file=top["key"], rediscovery_count=top["count"],
            ),
        ),
    )


def all_health() -> list[Detector]:
    return [
        loop(), reread(), thrash(), stall(), same_outcome(), file_churn(), exploration_stall(),
        error_class_persistence(), error_spiral(), error_blindness(), syntax_loop(), high_error_rate(),
        context_rot(), context_pressure(), rediscovery(),
    ]
