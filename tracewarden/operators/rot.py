"""Context-rot metrics, their weighted sum, smoothing and states.

All five modules come out of one pass: actions are grouped into turns, turns
into sessions, both on the distribution the buffer already has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tracewarden.functions import classify as c, fixed_values as fv, status, text
from tracewarden.operators.buffer import SESSION
from tracewarden.operators.detector import A
from tracewarden.operators.turns import action_window, maturity, scaled_window, turn_aggregates, turn_window, with_turns

# Module weights.
WEIGHTS = {"behavioral": 0.20, "repetition": 0.20, "thrash": 0.25, "progress": 0.25, "constraint": 0.10}
MODULES = list(WEIGHTS)
# Fixed values: (smoothed score, ticks in a row) needed for the states 3, 2 and 1.
STATE_RULES = [(3, 0.60, 2), (2, 0.40, 3), (1, 0.20, 2)]
CONSTRAINT_ALARM = THRASH_ALARM = 0.7
#: Raw scores are smaller than this, either way.
BOUND = 1e9
ALPHA = 0.4


@dataclass(frozen=True)
class Constraints:
    """Opt-in rules of the constraint module."""

    no_new_deps: bool = False
    forbidden_prefixes: list[str] = field(default_factory=list)
    must_touch_paths: list[str] = field(default_factory=list)
    must_touch_after: int = 6
    manifests: list[str] = field(default_factory=lambda: fv.DEPENDENCY_MANIFESTS)


def _round(value: Column) -> Column:
    return c.round_half_even(value, 4)


def _line(condition: Column, template: str, *values: Column) -> Column:
    """A one-line evidence array, or an empty one."""
    return F.when(condition, F.array(F.format_string(template, *values))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _part(name: str, value: Column, evidence: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), _round(value).alias("value"), evidence.alias("evidence"))


def _metric(name: str, value: Column, evidence: Column, parts: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        _round(F.least(value, F.lit(1.0))).alias("value"),
        evidence.alias("evidence"),
        parts.alias("contributors"),
    )


_PARTS = "array<struct<name:string,value:double,evidence:array<string>>>"


def _parts(*parts: Column) -> Column:
    return F.array(*parts).cast(_PARTS)


def _action_rows(buffered: DataFrame, keys: list[str], rules: Constraints) -> DataFrame:
    """Buffer rows with turn, repeat counts and rule hits."""
    file, command = c.present(F.col("file_path")), c.present(F.col("command"))
    error = c.present(F.col("error_message"))
    recent = F.col("rd") <= action_window(F.col("n"))
    rows = with_turns(buffered, keys).select(
        *keys, "rd", "pos", "n", "turn_idx", "tool_name", "tool_type", "success",
        file.alias("file_path"), command.alias("command"), "outgoing_data",
        F.when(recent, c.error_signature(error)).alias("signature"),
        recent.alias("recent"),
    )
    call = Window.partitionBy(*keys, "tool_name", "file_path", "command")
    same_error = Window.partitionBy(*keys, "signature")
    return rows.withColumn("calls", F.count_if("recent").over(call)).withColumn(
        "errors", F.when(F.col("signature").isNotNull(), F.count("*").over(same_error))
    )


def _turn_rows(buffered: DataFrame, keys: list[str], rules: Constraints) -> DataFrame:
    rows = _action_rows(buffered, keys, rules)
    file = F.col("file_path")
    extra = {}
    if rules.no_new_deps:
        extra["manifests"] = F.collect_set(F.when(A.edit & c.basename(file).isin(*rules.manifests), file))
    if rules.forbidden_prefixes:
        hit = F.lit(False)
        for prefix in rules.forbidden_prefixes:
            hit = hit | file.startswith(prefix)
        extra["forbidden"] = F.collect_set(F.when(hit, file))
    for i, path in enumerate(rules.must_touch_paths):
        extra[f"touched_{i}"] = F.coalesce(F.bool_or((file == path) | file.endswith("/" + path)), F.lit(False))
    # Highest count; among equals the one seen first.
    top_call = F.struct(
        F.col("calls"), (-F.col("pos")).alias("first"), F.col("tool_name"), file, F.col("command")
    )
    top_error = F.struct(F.col("errors"), (-F.col("pos")).alias("first"), F.col("signature"))
    return rows.groupBy(*keys, "turn_idx").agg(
        *turn_aggregates(),
        F.max("n").alias("n"),
        F.max(F.when(F.col("recent"), top_call)).alias("top_call"),
        F.max(F.when(F.col("errors").isNotNull(), top_error)).alias("top_error"),
        *[v.alias(k) for k, v in extra.items()],
    )


def _session_rows(buffered: DataFrame, keys: list[str], rules: Constraints) -> DataFrame:
    everything = Window.partitionBy(*keys)
    in_order = everything.orderBy("turn_idx")
    said = F.col("model_output").isNotNull().cast("int")
    t = (
        _turn_rows(buffered, keys, rules)
        .withColumns(
            {
                "n_turns": F.count("*").over(everything),
                "n_out": F.sum(said).over(everything),
                "out_no": F.sum(said).over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .withColumn("turn_rd", F.col("n_turns") - F.col("turn_idx"))
        .withColumn("out_rd", F.col("n_out") - F.col("out_no") + 1)
        .withColumn("prior", F.greatest(F.lit(3), F.least(F.lit(10), F.expr("n_out div 5"))))
    )
    output, said = F.col("model_output"), F.col("model_output").isNotNull()
    spoken = said & (F.col("turn_rd") <= scaled_window(F.col("n_turns"), 5, 0.15, 20))
    compared = said & (F.col("out_rd") <= F.col("prior") + 1)
    in_window = F.col("turn_rd") <= turn_window(F.col("n_turns"))
    t = t.withColumns(
        {
            "length": F.when(spoken, text.word_count(output)),
            "hedge": F.when(spoken, text.hedge_density(output)),
            "apology": F.when(spoken, text.apology_density(output)),
            "words": F.when(compared, text.content_words(output)),
            "sentences": F.when(compared, text.sentences(output)),
            "in_window": in_window,
        }
    )
    lengths = F.array_sort(F.collect_list(F.when(F.col("length").isNotNull(), F.struct("turn_idx", "length"))))
    outputs = F.array_sort(
        F.collect_list(
            F.when(
                F.col("words").isNotNull(),
                F.struct("out_rd", F.array_distinct("words").alias("words"), "sentences"),
            )
        )
    )
    edits = F.array_sort(
        F.collect_list(
            F.when(
                F.col("in_window") & (F.size("edited_files") > 0),
                F.struct("turn_idx", F.array_sort("edited_files").alias("files")),
            )
        )
    )
    extra = []
    if rules.no_new_deps:
        extra.append(F.flatten(F.collect_list("manifests")).alias("manifests"))
    if rules.forbidden_prefixes:
        extra.append(F.flatten(F.collect_list("forbidden")).alias("forbidden"))
    extra += [F.bool_or(f"touched_{i}").alias(f"touched_{i}") for i in range(len(rules.must_touch_paths))]
    return t.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count("*").alias("n_turns"),
        F.max("n_out").alias("n_out"),
        F.max("prior").alias("prior"),
        lengths.alias("lengths"),
        F.sum("hedge").alias("hedge"),
        F.sum("apology").alias("apology"),
        F.max(F.when(F.col("out_rd") == 1, F.when(said, text.repeated_share(text.trigrams(F.col("words")))))).alias(
            "self_repeat"
        ),
        outputs.alias("outputs"),
        F.bool_or("has_edit").alias("any_edit"),
        F.count_if("has_code_exploration").alias("exploration_turns"),
        F.max(F.when(F.col("has_edit") & F.col("has_successful_bash"), F.col("turn_idx"))).alias("productive"),
        F.count_if(F.col("in_window") & F.col("has_edit")).alias("edited_turns"),
        F.max(F.when(F.col("has_successful_bash"), F.col("turn_idx"))).alias("last_ok"),
        edits.alias("edits"),
        F.max("top_call").alias("top_call"),
        F.max("top_error").alias("top_error"),
        *extra,
    )


# --- modules ---------------------------------------------------------------------------

def _behavioral(s: DataFrame) -> DataFrame:
    lengths = F.transform(F.col("lengths"), lambda r: r["length"].cast("long"))
    s = s.withColumn("lengths", lengths)
    count = F.size("lengths")
    zero = F.lit(0).cast("long")
    indexed = F.transform(F.col("lengths"), lambda y, i: y * i.cast("long"))
    s = s.withColumns(
        {
            "spoken": count.cast("long"),
            "sum_y": F.aggregate("lengths", zero, lambda a, y: a + y),
            "sum_xy": F.aggregate(indexed, zero, lambda a, y: a + y),
        }
    )
    # Least squares over x = 0..k-1 with exact integer sums.
    k, sy, sxy = F.col("spoken"), F.col("sum_y"), F.col("sum_xy")
    sx = F.expr("spoken * (spoken - 1) div 2")
    sxx = F.expr("(spoken - 1) * spoken * (2 * spoken - 1) div 6")
    slope = (k * sxy - sx * sy) / (k * sxx - sx * sx)
    inflation = F.when(k < 2, 0.0).otherwise(
        F.when(slope <= 0, 0.0).otherwise(F.least(slope / F.greatest(sy / k, F.lit(1.0)), F.lit(1.0)))
    )
    s = s.withColumns(
        {
            "inflation": inflation,
            "avg_hedge": F.col("hedge") / k,
            "avg_apology": F.col("apology") / k,
        }
    ).withColumn("hedging", F.least(F.col("avg_hedge") / 0.05, F.lit(1.0)))
    inflation, hedge, hedging, apology = (F.col(x) for x in ("inflation", "avg_hedge", "hedging", "avg_apology"))
    shown = F.concat(F.lit("["), F.array_join(F.transform("lengths", lambda y: y.cast("string")), ", "), F.lit("]"))
    active = (F.col("n_turns") >= 2) & (k > 0)
    evidence = F.concat(
        _line(inflation > 0.2, "response length inflating (slope=%.2f)", inflation),
        _line(hedging > 0.2, "high hedge-word density (%.1f%%)", hedge * 100),
        _line(apology > 0.2, "frequent apologies (%.2f)", apology),
    )
    parts = _parts(
        _part("length_inflation", inflation,
              _line(inflation > 0.1, "word counts over last %d turns: %s", k, shown)),
        _part("hedge_density", hedging, _line(hedging > 0.1, "avg hedge word ratio: %.3f", hedge)),
        _part("apology_density", apology, _line(apology > 0.1, "avg apology density: %.3f", apology)),
    )
    value = (inflation + hedging + apology) / 3.0
    return s.withColumn("behavioral", F.when(active, _metric("behavioral", value, evidence, parts)).otherwise(
        _metric("behavioral", F.lit(0.0), _none(), _parts())))


def _repetition(s: DataFrame) -> DataFrame:
    outputs = F.col("outputs")
    current = F.get(outputs, F.lit(0))
    previous = F.filter(outputs, lambda o: o["out_rd"] > 1)
    s = s.withColumns({"current": current, "previous": previous})
    current, previous = F.col("current"), F.col("previous")
    overlaps = F.transform(
        F.filter(previous, lambda o: F.size(o["words"]) > 0), lambda o: text.jaccard(current["words"], o["words"])
    )
    s = s.withColumns(
        {
            # Oldest first, so that the sum has one defined order.
            "overlaps": F.when(F.size(current["words"]) > 0, F.reverse(overlaps)).otherwise(
                F.array().cast("array<double>")
            ),
            "known": F.flatten(F.transform(previous, lambda o: o["sentences"])),
        }
    )
    total = F.aggregate("overlaps", F.lit(0.0), lambda a, x: a + x)
    latest = current["sentences"]
    repeated = F.size(F.filter(latest, lambda x: F.array_contains(F.col("known"), x)))
    s = s.withColumns(
        {
            "overlap": F.when(F.size("overlaps") > 0, total / F.size("overlaps")).otherwise(0.0),
            "restated": F.when(F.size(latest) > 0, repeated / F.size(latest)).otherwise(0.0),
            "self_repeat": F.coalesce("self_repeat", F.lit(0.0)),
        }
    )
    within, overlap, restated = F.col("self_repeat"), F.col("overlap"), F.col("restated")
    evidence = F.concat(
        _line(within > 0.15, "self-repeating n-grams (%.0f%%)", within * 100),
        _line(overlap > 0.3, "high overlap with prior outputs (Jaccard %.0f%%)", overlap * 100),
        _line(restated > 0.2, "sentences repeated from prior turns (%.0f%%)", restated * 100),
    )
    parts = _parts(
        _part("ngram_self_repeat", within, _line(within > 0.1, "3-gram self-repeat ratio: %.2f", within)),
        _part("cross_turn_overlap", overlap,
              _line(overlap > 0.2, "Jaccard overlap with prior %d outputs: %.2f", F.col("prior"), overlap)),
        _part("repeated_sentences", restated, _line(restated > 0.1, "repeated sentence ratio: %.2f", restated)),
    )
    value = F.lit(0.25) * within + F.lit(0.40) * overlap + F.lit(0.35) * restated
    return s.withColumn("repetition", F.when(F.col("n_out") > 0, _metric("repetition", value, evidence, parts))
                        .otherwise(_metric("repetition", F.lit(0.0), _none(), _parts())))


def _thrash(s: DataFrame) -> DataFrame:
    calls, errors = F.col("top_call"), F.col("top_error")
    most_calls, most_errors = calls["calls"], F.coalesce(errors["errors"], F.lit(0))
    stale = F.col("n_turns") - 1 - F.coalesce(F.col("productive"), F.lit(-1))
    s = s.withColumns(
        {
            "maturity": maturity(F.col("n_turns"), F.col("any_edit"), F.col("exploration_turns")),
            "call_score": F.when(F.col("n") < 4, 0.0).otherwise(
                F.least(F.greatest(most_calls - 3, F.lit(0)) / 5.0, F.lit(1.0))
            ),
            "error_score": F.least(F.greatest(most_errors - 2, F.lit(0)) / 4.0, F.lit(1.0)),
            "stale": stale,
            "stale_score": F.when(stale <= 1, 0.0).otherwise(F.least(stale / 10.0, F.lit(1.0))),
        }
    ).withColumn("stall_score", F.col("stale_score") * F.col("maturity"))
    call, error, stall = F.col("call_score"), F.col("error_score"), F.col("stall_score")
    described = F.concat(
        calls["tool_name"],
        F.when(calls["file_path"].isNotNull(), F.concat(F.lit(" on "), calls["file_path"]))
        .when(calls["command"].isNotNull(), F.concat(F.lit(": "), F.left(calls["command"], F.lit(60))))
        .otherwise(""),
    )
    call_line = _line(call > 0, "'%s' repeated %dx in last %d actions", described, most_calls, action_window(F.col("n")))
    error_line = _line(error > 0, "error repeated %dx: '%s'", most_errors, F.left(errors["signature"], F.lit(80)))
    stall_line = _line(F.col("stale_score") > 0.1, "%d turns since last productive change", F.col("stale"))
    parts = _parts(
        _part("repeated_tool_calls", call, call_line),
        _part("repeated_errors", error, error_line),
        _part("turns_since_progress", stall, stall_line),
    )
    value = F.lit(0.35) * call + F.lit(0.35) * error + F.lit(0.30) * stall
    return s.withColumn("thrash", _metric("thrash", value, F.concat(call_line, error_line, stall_line), parts))


def _progress(s: DataFrame) -> DataFrame:
    window = F.least(F.col("n_turns"), turn_window(F.col("n_turns")))
    s = s.withColumns(
        {
            "window": window,
            "deficit": _round(F.lit(1.0) - F.col("edited_turns") / window),
            "edited": F.flatten(
                F.transform(
                    F.col("edits"),
                    lambda e: F.transform(e["files"], lambda f: F.struct(e["turn_idx"].alias("turn"), f.alias("file"))),
                )
            ),
        }
    )
    edited = F.col("edited")
    # Files in order of their first edit, with edited turns and the last one.
    per_file = F.transform(
        F.array_distinct(F.transform(edited, lambda e: e["file"])),
        lambda f: F.struct(
            f.alias("file"),
            F.size(F.filter(edited, lambda e: e["file"] == f)).alias("turns"),
            F.array_max(F.transform(F.filter(edited, lambda e: e["file"] == f), lambda e: e["turn"])).alias("last"),
        ),
    )
    s = s.withColumn(
        "churning",
        F.filter(per_file, lambda p: (p["turns"] >= 3) & (p["last"] > F.coalesce(F.col("last_ok"), F.lit(-1)))),
    )
    churning = F.col("churning")
    deficit = F.col("deficit")
    churn = _round(F.least(F.size(churning) * 0.35, F.lit(1.0)))
    deficit_line = _line(
        deficit > 0.3, "only %d/%d recent turns produced file changes", F.col("edited_turns"), F.col("window")
    )
    churn_line = _line(
        F.size(churning) > 0, "file churning without success: %s (%d+ edits)",
        F.array_join(F.slice(F.transform(churning, lambda p: p["file"]), 1, 3), ", "),
        F.array_max(F.transform(churning, lambda p: p["turns"])),
    )
    parts = _parts(_part("turns_with_diff", deficit, deficit_line), _part("file_churn", churn, churn_line))
    value = (F.lit(0.55) * deficit + F.lit(0.45) * churn) * F.col("maturity")
    return s.withColumn(
        "progress",
        F.when(F.col("n_turns") >= 2, _metric("progress", value, F.concat(deficit_line, churn_line), parts))
        .otherwise(_metric("progress", F.lit(0.0), _none(), _parts())),
    )


def _constraint(s: DataFrame, rules: Constraints) -> DataFrame:
    parts = []

    def listed(prefix: str, paths: Column, limit: int) -> Column:
        return F.transform(F.slice(paths, 1, limit), lambda p: F.concat(F.lit(prefix), p))

    if rules.no_new_deps:
        paths = F.array_sort(F.array_distinct("manifests"))
        parts.append(_part("no_new_deps", F.least(F.size(paths) * 0.5, F.lit(1.0)),
                           listed("dependency manifest modified: ", paths, 3)))
    if rules.forbidden_prefixes:
        paths = F.array_sort(F.array_distinct("forbidden"))
        parts.append(_part("forbidden_paths", F.least(F.size(paths) * 0.3, F.lit(1.0)),
                           listed("forbidden path accessed: ", paths, 5)))
    if rules.must_touch_paths:
        wanted = rules.must_touch_paths
        due = F.col("n_turns") >= rules.must_touch_after
        missing = F.array_compact(
            F.array(*[F.when(due & ~F.col(f"touched_{i}"), F.lit(p)) for i, p in enumerate(wanted)])
        )
        parts.append(_part("must_touch", F.least(F.size(missing) / len(wanted), F.lit(1.0)),
                           listed(f"required path not yet touched after {rules.must_touch_after} turns: ", missing, 3)))
    if not parts:
        return s.withColumn("constraint", _metric("constraint", F.lit(0.0), _none(), _parts()))
    scores = [p["value"] for p in parts]
    worst = F.greatest(*scores) if len(scores) > 1 else scores[0]
    evidence = F.concat(*[p["evidence"] for p in parts])
    return s.withColumn("constraint", _metric("constraint", worst, evidence, _parts(*parts)))


def _ranked_reasons(name: str, module: int) -> Column:
    """Evidence lines of a module, to be sorted by falling module value."""
    value = F.col(name)["value"]

    def entry(line: Column, i: Column) -> Column:
        return F.struct((-value).alias("order"), F.lit(module).alias("module"), i.alias("line"), line.alias("text"))

    return F.transform(F.col(name)["evidence"], entry)


def rot_modules(
    buffered: DataFrame, keys: list[str] = SESSION, rules: Constraints = Constraints()
) -> DataFrame:
    """Five metric structs, ``raw_score`` and the top three reasons per session."""
    s = _session_rows(buffered, keys, rules)
    s = _constraint(_progress(_thrash(_repetition(_behavioral(s)))), rules)
    raw = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        raw = raw + F.lit(weight) * F.col(name)["value"]
    reasons = F.flatten(F.array(*[_ranked_reasons(name, i) for i, name in enumerate(MODULES)]))
    top = F.transform(F.slice(F.array_sort(reasons), 1, 3), lambda r: r["text"])
    return s.select(
        *keys, "n", "n_turns", *MODULES, F.least(raw, F.lit(1.0)).alias("raw_score"), top.alias("top_reasons")
    )


# --- smoothing and states ------------------------------------------------------------------

def state_of(above: dict[int, Column], constraint: Column, thrash: Column) -> Column:
    """State 0..3 from "long enough above its threshold" flags; the highest match wins."""
    alarm = (constraint >= CONSTRAINT_ALARM) & (thrash >= THRASH_ALARM)
    expr = F.when(above[3] | alarm, 3)
    for level in (2, 1):
        expr = expr.when(above[level], level)
    return expr.otherwise(0)


def shown(name: str, alias: str | None = None) -> Column:
    """Scores are reported, and blended, with four digits."""
    return c.round_half_even(F.col(name), 4).alias(alias or name)


def rot_report(
    buffered: DataFrame, keys: list[str] = SESSION, rules: Constraints = Constraints(),
    theme: str = fv.DEFAULT_THEME,
) -> DataFrame:
    """The first tick of a scorer: nothing to smooth, no run of ticks yet."""
    modules = rot_modules(buffered, keys, rules)
    never = {3: F.lit(False), 2: F.lit(False), 1: F.lit(False)}
    state = state_of(never, F.col("constraint")["value"], F.col("thrash")["value"])
    return modules.select(
        *keys, "n_turns", shown("raw_score"), shown("raw_score", "smoothed_score"), state.alias("state"),
        status.level_label(state, theme).alias("state_label"), "top_reasons", *MODULES,
    )


def _folder(alpha: float, columns: list[str]):
    """Smoothing of sorted rows: a new (session_id, run) begins with its ``start``, or with its first score if null."""

    def fold(batches):
        key = smoothed = None
        for batch in batches:
            out = []
            for *now, start, raw in zip(*(batch.column(c).to_pylist() for c in ("session_id", "run", "start", "raw_score"))):
                if now != key:
                    key, smoothed = now, start
                smoothed = raw if smoothed is None else alpha * raw + (1.0 - alpha) * smoothed
                out.append(smoothed)
            arrays = [batch.column(c) for c in columns] + [pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "smoothed_score"])

    return fold


def smooth(ticks: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Exponential smoothing and states over ``ticks(session_id, snapshot_id, raw_score, constraint, thrash)``.

    Snapshot ids are consecutive, scores lie between -BOUND and BOUND. The result has the bits of the plain fold
    ``alpha * raw + (1 - alpha) * smoothed``, yet long sessions are folded in stretches side by side. The start of a
    stretch follows from the one before, folded from both bounds: a fold never changes the order of two start values, so
    where both end in the same double, the true one, which lies between, does too. Where they do not (long runs of zeros,
    which only shrink what came before), the stretch is folded after its predecessor, row by row.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    keep = 1.0 - alpha
    stretch = 1024 if keep == 0 else max(8, math.ceil(355 / -math.log(keep)))
    placed = ticks.withColumn("stretch", F.expr(f"snapshot_id div {stretch}")).withColumn("off", F.col("snapshot_id") % stretch)
    order = Window.partitionBy("session_id", "stretch").orderBy("snapshot_id")
    if keep == 0:
        smoothed = placed.withColumn("smoothed_score", F.col("raw_score"))
    else:
        def of(start: float) -> Column:
            return F.aggregate("before", F.lit(start), lambda before, row: F.lit(alpha) * row["raw_score"] + F.lit(keep) * before)

        # One row for each stretch, beside the scores of the stretch before it.
        twice = placed.select("session_id", "snapshot_id", "raw_score", F.posexplode(F.array("stretch", F.col("stretch") + 1)).alias("later", "at"))
        grouped = twice.groupBy(F.col("session_id").alias("of"), "at").agg(
            F.max(F.col("later") == 0).alias("own"), F.sort_array(F.collect_list(F.when(F.col("later") == 1, F.struct("snapshot_id", "raw_score")))).alias("before"))
        ends = grouped.where("own").select("of", "at", (F.size("before") == 0).alias("first"), of(-BOUND).alias("low"), of(BOUND).alias("high"))
        # Stretches with a known start, and those that are folded after them.
        known = F.when(F.col("first") | (F.col("low") == F.col("high")), F.struct("at", F.when(~F.col("first"), F.col("low")).alias("start")))
        since = F.last(known, ignorenulls=True).over(Window.partitionBy("of").orderBy("at"))
        heads = ends.select("of", "at", since.alias("since")).select("of", "at", F.col("since.at").alias("run"), F.col("since.start").alias("start"))
        same = F.col("session_id").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at"))
        dealt = placed.join(heads, same).drop("of", "at").repartition("session_id", "run").sortWithinPartitions("session_id", "run", "snapshot_id")
        kinds = T.StructType([*placed.schema.fields, T.StructField("smoothed_score", T.DoubleType())])
        smoothed = dealt.mapInArrow(_folder(alpha, placed.columns), kinds)

    # A stretch's first states look back into the one before.
    back = max(needed for _, _, needed in STATE_RULES) - 1
    looked = F.when(F.col("off") >= stretch - back, F.array("stretch", F.col("stretch") + 1)).otherwise(F.array("stretch"))
    copies = smoothed.withColumn("home", F.col("stretch")).withColumn("stretch", F.explode(looked))
    above = {}
    for level, score, ticks_needed in STATE_RULES:
        lowest = F.min("smoothed_score").over(order.rowsBetween(-(ticks_needed - 1), 0))
        seen = F.count("*").over(order.rowsBetween(-(ticks_needed - 1), 0))
        above[level] = (lowest >= score) & (seen == ticks_needed)
    return (
        copies.withColumn("state", state_of(above, F.col("constraint"), F.col("thrash")))
        .where(F.col("stretch") == F.col("home"))
        .drop("home", "stretch", "off")
    )


def rot_replay(
    replayed: DataFrame, rules: Constraints = Constraints(), alpha: float = ALPHA
) -> DataFrame:
    """Rot score after every snapshot of :func:`.buffer.replay`."""
    keys = ["session_id", "snapshot_id"]
    ticks = rot_modules(replayed, keys, rules).select(
        *keys, "raw_score", F.col("constraint")["value"].alias("constraint"), F.col("thrash")["value"].alias("thrash")
    )
    smoothed = smooth(ticks, alpha)
    return smoothed.withColumns({name: shown(name) for name in ("raw_score", "smoothed_score")})
