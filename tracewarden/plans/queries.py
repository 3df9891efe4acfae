"""Named queries over the given tables: ``query(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewarden.functions import classify as c, fixed_values as fv, status, text
from tracewarden.model import CATEGORIES
from tracewarden.operators import agents as ag, buffer as b, health as h, history, rot, score, security as x, turns as t
from tracewarden.operators.detector import Detector, detect
from tracewarden.operators.lineage import shared_folder
from tracewarden.operators.registry import FrameDetector, create_registry
from tracewarden.plans import reports
from tracewarden.sources import jsonl, tables
from tracewarden.streaming import dialects, presence, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Counts as bigint, so that both engines agree on the type."""
    return df.select(
        *[F.col(n).cast("bigint").alias(n) if kind in ("int", "smallint") else F.col(n) for n, kind in df.dtypes]
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return tables.event_actions(spark, folder)


def event_buffer(spark: SparkSession, folder: str) -> DataFrame:
    return b.buffer(events(spark, folder))


# --- statistics and buffer ------------------------------------------------------------

@query
def session_stats(spark, folder):
    return plain(b.session_stats(events(spark, folder)).drop("total_cost", "start_time", "last_time"))


@query
def session_duration_cost(spark, folder):
    stats = b.with_duration(b.session_stats(events(spark, folder)))
    return stats.select(
        "session_id",
        F.round("duration_minutes", 4).alias("duration_minutes"),
        F.round(b.estimated_cost(), 6).alias("estimated_cost"),
    )


@query
def buffer_positions(spark, folder):
    buffered = b.buffer(events(spark, folder), max_size=20)
    return plain(buffered.select("session_id", F.col("sub").alias("event_id"), "rd", "pos", "n"))


@query
def file_access_count(spark, folder):
    return b.file_access_count(events(spark, folder))


@query
def files_in_window(spark, folder):
    return b.files_in_window(event_buffer(spark, folder), 15)


@query
def early_files(spark, folder):
    return b.early_files(event_buffer(spark, folder), 15)


@query
def recent_errors(spark, folder):
    return plain(b.recent_errors(events(spark, folder), 10))


@query
def bash_commands(spark, folder):
    return plain(b.bash_commands(event_buffer(spark, folder), 5).select("session_id", "command_rd", "command"))


@query
def network_actions(spark, folder):
    found = b.network_actions(event_buffer(spark, folder))
    return plain(found.select("session_id", "pos", "network_host", "network_port"))


@query
def actions_by_file(spark, folder):
    return plain(b.actions_by_file(event_buffer(spark, folder), "src/mod_1.py").select("session_id", "pos", "tool_name"))


@query
def replay_buffer(spark, folder):
    replayed = b.replay(events(spark, folder), every=10, max_size=30)
    return plain(
        replayed.groupBy("session_id", "snapshot_id").agg(
            F.count("*").alias("actions"), F.max("rd").alias("max_rd"), F.min("pos").alias("min_pos"),
            F.sum("sub").alias("event_ids"),
        )
    )


@query
def replay_at_points(spark, folder):
    actions = events(spark, folder)
    points = actions.groupBy("session_id").agg(F.count("*").alias("n")).select(
        "session_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("snapshot_id"),
        F.expr("n div 3").alias("third"),
    )
    snapshots = points.select("session_id", "snapshot_id", (F.col("third") * F.col("snapshot_id")).alias("as_of_idx"))
    replayed = b.replay_at(actions, snapshots, max_size=25)
    return plain(
        replayed.groupBy("session_id", "snapshot_id").agg(
            F.count("*").alias("actions"), F.max("pos").alias("max_pos"), F.sum("sub").alias("event_ids")
        )
    )


@query
def replay_by_time(spark, folder):
    actions = events(spark, folder)
    spans = actions.groupBy("session_id").agg(F.unix_micros(F.min("timestamp").cast("timestamp")).alias("lo"), F.unix_micros(F.max("timestamp").cast("timestamp")).alias("hi"))
    each = spans.select("session_id", "lo", "hi", F.explode(F.expr("array(0L, 1L, 2L)")).alias("snapshot_id"))
    ticks = each.select("session_id", "snapshot_id", F.timestamp_micros(F.expr("lo + (hi - lo) * snapshot_id div 3")).alias("tick_at"))
    replayed = b.replay_by_time(actions, ticks, max_size=25)
    return plain(
        replayed.groupBy("session_id", "snapshot_id").agg(
            F.count("*").alias("actions"), F.max("pos").alias("max_pos"), F.sum("sub").alias("event_ids")
        )
    )


@query
def turns(spark, folder):
    found = t.turns(event_buffer(spark, folder))
    return plain(
        found.select(
            "session_id", "turn_idx", "model_output", "action_count", "has_edit", "has_successful_bash",
            "has_code_exploration", F.array_join(F.array_sort("edited_files"), ",").alias("edited_files"),
            F.array_join(F.array_sort("touched_files"), ",").alias("touched_files"), "failed_actions",
        )
    )


@query
def conversation_turns(spark, folder):
    found = t.turns(b.buffer(tables.conversation_actions(spark, folder)))
    return plain(
        found.select("session_id", "turn_idx", "action_count", text.word_count(F.col("model_output")).alias("words"))
    )


@query
def session_shape(spark, folder):
    return plain(t.session_shape(event_buffer(spark, folder)))


# --- functions ---------------------------------------------------------------------------

@query
def action_functions(spark, folder):
    a = events(spark, folder)
    tool, path, command, error = (F.col(n) for n in ("tool_name", "file_path", "command", "error_message"))
    return plain(
        a.select(
            F.col("sub").alias("event_id"),
            c.classify_tool(tool).alias("tool_class"),
            c.is_file_read(F.col("tool_type")).alias("is_read"),
            c.is_file_edit(F.col("tool_type")).alias("is_edit"),
            c.is_bash(F.col("tool_type")).alias("is_bash"),
            c.is_network(F.col("network_host"), F.col("network_port")).alias("is_network"),
            c.is_sensitive_path(path).alias("sensitive_path"),
            c.is_sensitive_path(command).alias("sensitive_command"),
            c.classify_error(error).alias("error_class"),
            c.normalize_error(error).alias("error_text"),
            c.error_signature(error).alias("error_signature"),
            c.call_signature(tool, path, command).alias("call_hash"),
            c.basename(path).alias("basename"),
        )
    )


@query
def classify_tool_words(spark, folder):
    """Tool classes of every word of every conversation text."""
    said = tables.spread(tables.table(spark, folder, "conversations"), "conv_id")
    words = said.select(F.explode(text.words(F.col("text"))).alias("word"))
    return words.groupBy(c.classify_tool(F.col("word")).alias("tool_class")).agg(F.count("*").alias("words"))


def _text_measures(df: DataFrame, key: str) -> DataFrame:
    body = F.col("text")
    words, grams = F.col("content_words"), F.col("grams")
    prepared = df.withColumn("content_words", text.content_words(body)).withColumn("grams", text.trigrams(words))
    return plain(
        prepared.select(
            key,
            text.word_count(body).alias("words"),
            text.hedge_count(body).alias("hedges"),
            text.apology_count(body).alias("apologies"),
            F.size(words).alias("content_words"),
            F.size(grams).alias("trigrams"),
            F.size(F.array_distinct(grams)).alias("distinct_trigrams"),
            F.size(text.sentences(body)).alias("sentences"),
        )
    )


@query
def conversation_text_measures(spark, folder):
    said = tables.spread(tables.table(spark, folder, "conversations"), "conv_id")
    return _text_measures(said.withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id")


@query
def document_text_measures(spark, folder):
    return _text_measures(tables.spread(tables.table(spark, folder, "documents"), "doc_id"), "doc_id")


# --- detectors: default rules, or the given ones where defaults stay quiet on this data ------

DETECTORS: dict[str, tuple[Callable[[], Detector], list[str]]] = {
    "loop": (h.loop, ["count", "last_command", "last_error"]),
    "reread": (h.reread, ["path", "count"]),
    "thrash": (lambda: h.thrash(threshold=2, window=30), ["path", "count", "last_error"]),
    "stall": (lambda: h.stall(max_reads=5), ["reads", "edits", "successful_bash"]),
    "same_outcome": (h.same_outcome, ["error_class", "occurrences", "total_edits", "last_error"]),
    "file_churn": (lambda: h.file_churn(threshold=2), ["file", "edit_count", "last_error"]),
    "exploration_stall": (
        h.exploration_stall, ["unique_recent_files", "recent_edits", "recent_errors", "total_known_files"]
    ),
    "error_class_persistence": (h.error_class_persistence, ["error_class", "failure_count", "total_edits"]),
    "error_spiral": (lambda: h.error_spiral(threshold=2), ["consecutive_failures"]),
    "error_blindness": (h.error_blindness, ["error_pattern", "count"]),
    "syntax_loop": (lambda: h.syntax_loop(threshold=2), ["count"]),
    "high_error_rate": (lambda: h.high_error_rate(threshold=0.4), ["failures", "total"]),
    "context_rot": (h.context_rot, ["total_early", "total_recent"]),
    "context_pressure": (
        lambda: h.context_pressure(warning_threshold=0.2, critical_threshold=0.25), ["estimated_tokens", "usage_percent"]
    ),
    "rediscovery": (lambda: h.rediscovery(window=40, rediscovery_gap=10), ["file", "rediscovery_count"]),
    "credential_access": (x.credential_access, ["target", "tool"]),
    "credential_exfiltration": (x.credential_exfiltration, ["target", "host"]),
    "prompt_injection": (x.prompt_injection, ["match_count", "confidence"]),
    "hidden_instruction": (x.hidden_instruction, ["source"]),
    "indirect_injection": (x.indirect_injection, ["source_type", "tool"]),
    "network_anomaly": (x.network_anomaly, ["host", "port", "command"]),
    "data_exfiltration": (x.data_exfiltration, ["file_count", "size_bytes"]),
    "c2_communication": (x.c2_communication, ["command", "host", "connection_count"]),
    "dns_exfiltration": (x.dns_exfiltration, ["command"]),
    "privilege_escalation": (x.privilege_escalation, ["command", "tool"]),
    "dangerous_command": (x.dangerous_command, ["command", "tool"]),
    "mass_file_operation": (lambda: x.mass_file_operation(threshold=3), ["delete_count", "overwrite_count"]),
    "sensitive_directory": (x.sensitive_directory, ["path", "operation"]),
    "malicious_skill": (x.malicious_skill, ["skill", "command", "path"]),
    "skill_network": (x.skill_network, ["skill", "host", "port"]),
    "new_skill": (x.new_skill, ["skill"]),
    "skill_chain": (x.skill_chain, ["count"]),
    "skill_install": (x.skill_install, ["command"]),
}


def warnings_with(df: DataFrame, details: list[str]) -> DataFrame:
    return df.select(
        "session_id", "category", "signal", "severity", "message",
        *[F.col("details")[name].alias(name) for name in details],
    )


def _detector_query(name: str) -> Query:
    build, details = DETECTORS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return warnings_with(detect(event_buffer(spark, folder), [build()]), details)

    return run


for _name in DETECTORS:
    QUERIES[_name] = _detector_query(_name)


@query
def secret_in_output(spark, folder):
    """Documents as outgoing text of their source: the first secret among a source's last actions."""
    buffered = b.buffer(tables.document_actions(spark, folder))
    return warnings_with(detect(buffered, [x.secret_in_output(window=500)]), ["size"])


#: Characters that ``data_exfiltration`` takes for a large payload.
LARGE = 10_000


@query
def docs_secret_scan(spark, folder):
    """Every document that holds a secret: one row for each rule it meets."""
    texts = tables.table(spark, folder, "documents").select("doc_id", "source", "text")
    rules = F.array(*(F.when(F.col("text").rlike(fv.any_of([p])), n) for n, p in enumerate(fv.SECRETS)))
    hits = texts.withColumn("rule", F.explode(F.filter(rules, lambda n: n.isNotNull())))
    return plain(hits.select("doc_id", "source", "rule", F.length("text").alias("size")))


@query
def docs_large_outgoing(spark, folder):
    """Every document larger than an answer should be."""
    size = F.length("text")
    return plain(tables.table(spark, folder, "documents").where(size > LARGE).select("doc_id", "source", size.alias("size_bytes")))


@query
def pages_hidden_content(spark, folder):
    """Every page holding an HTML comment."""
    pages = tables.table(spark, folder, "pages").where(F.col("html").contains("<!--"))
    return plain(pages.select("page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("host")))


@query
def first_seen_skills(spark, folder):
    return x.first_seen_skills(events(spark, folder))


# --- registry -------------------------------------------------------------------------------

@query
def check_health(spark, folder):
    found = create_registry("health").check(event_buffer(spark, folder))
    return found.select("session_id", "detector", "category", "severity", "signal", "message")


@query
def check_all(spark, folder):
    """All detectors with default rules, worst first per session."""
    found = create_registry("all").check_all(event_buffer(spark, folder))
    return plain(found.select("session_id", "rank", "detector", "severity", "impact"))


@query
def check_security(spark, folder):
    found = create_registry("security").check(event_buffer(spark, folder))
    return found.select("session_id", "detector", "category", "severity", "signal", "message")


def _many_hosts(buffered: DataFrame, keys: list[str]) -> DataFrame:
    hosts = buffered.groupBy(*keys).agg(F.count_distinct("network_host").alias("hosts")).where("hosts >= 2")
    return hosts.select(
        *keys, F.lit("network").alias("category"), F.when(F.col("hosts") >= 3, "high").otherwise("medium").alias("severity"),
        F.lit("many_hosts").alias("signal"), F.concat(F.lit("Talks to "), F.col("hosts").cast("string"), F.lit(" hosts")).alias("message"),
        F.lit("Check that all of them are needed").alias("suggestion"),
        F.create_map(F.lit("hosts"), F.col("hosts").cast("string")).alias("details"),
    )


@query
def custom_detector(spark, folder):
    """The security detectors less one and with an own one, worst first per session."""
    own = FrameDetector("many_hosts", "network", "Several hosts in one session", _many_hosts, is_security=True)
    registry = create_registry("security", [own])
    registry.remove("new_skill")
    found = registry.check_all(event_buffer(spark, folder))
    return plain(found.select("session_id", "rank", "detector", "severity", "message"))


@query
def security_audit(spark, folder):
    audit = create_registry("security").audit(event_buffer(spark, folder))
    return plain(audit.groupBy("detector", "category").agg(
        F.count("*").alias("sessions"), F.count_if("triggered").alias("triggered"),
        F.sum("action_count").alias("action_count"),
    ))


# --- rot metrics -----------------------------------------------------------------------------

RULES = rot.Constraints(
    no_new_deps=True, forbidden_prefixes=["/etc/", "/home/"], must_touch_paths=["src/mod_1.py", "mod_2.py", "README.md"]
)


def _metric(df: DataFrame, name: str, parts: list[str]) -> DataFrame:
    m = F.col(name)

    def part(i: int) -> Column:
        return F.round(F.get(m["contributors"], F.lit(i))["value"], 6)

    return df.select("session_id", F.round(m["value"], 6).alias("value"), *[part(i).alias(p) for i, p in enumerate(parts)])


def _conversation_rot(spark, folder):
    return rot.rot_modules(b.buffer(tables.conversation_actions(spark, folder)))


@query
def metric_behavioral(spark, folder):
    return _metric(
        rot.rot_modules(event_buffer(spark, folder)), "behavioral", ["length_inflation", "hedge_density", "apology_density"]
    )


@query
def metric_behavioral_conversations(spark, folder):
    return _metric(
        _conversation_rot(spark, folder), "behavioral", ["length_inflation", "hedge_density", "apology_density"]
    )


@query
def metric_repetition(spark, folder):
    return _metric(
        rot.rot_modules(event_buffer(spark, folder)), "repetition",
        ["ngram_self_repeat", "cross_turn_overlap", "repeated_sentences"],
    )


@query
def metric_repetition_conversations(spark, folder):
    return _metric(
        _conversation_rot(spark, folder), "repetition",
        ["ngram_self_repeat", "cross_turn_overlap", "repeated_sentences"],
    )


@query
def metric_thrash(spark, folder):
    return _metric(
        rot.rot_modules(event_buffer(spark, folder)), "thrash",
        ["repeated_tool_calls", "repeated_errors", "turns_since_progress"],
    )


@query
def metric_progress(spark, folder):
    return _metric(rot.rot_modules(event_buffer(spark, folder)), "progress", ["turns_with_diff", "file_churn"])


@query
def metric_constraint(spark, folder):
    return _metric(
        rot.rot_modules(event_buffer(spark, folder), rules=RULES), "constraint",
        ["no_new_deps", "forbidden_paths", "must_touch"],
    )


@query
def rot_report(spark, folder):
    report = rot.rot_report(event_buffer(spark, folder), rules=RULES)
    return plain(
        report.select(
            "session_id", "n_turns", "raw_score", "state", "state_label",
        )
    )


@query
def rot_replay(spark, folder):
    ticks = rot.rot_replay(b.replay(events(spark, folder), every=10, max_size=50))
    return plain(
        ticks.select(
            "session_id", "snapshot_id", "raw_score", "smoothed_score", "state",
        )
    )


@query
def rot_smoothing(spark, folder):
    """Smoothing and states over a score series given by every event's value."""
    indexed = b.numbered(events(spark, folder))
    ticks = indexed.select(
        "session_id", (F.col("idx") - 1).alias("snapshot_id"), ((F.col("tokens_in") % 100) / 100.0).alias("raw_score"),
        F.lit(0.0).alias("constraint"), F.lit(0.0).alias("thrash"),
    )
    return plain(
        rot.smooth(ticks).select("session_id", "snapshot_id", F.round("smoothed_score", 6).alias("smoothed_score"), "state")
    )


# --- scores -----------------------------------------------------------------------------------

@query
def category_scores(spark, folder):
    scored = score.with_category_scores(create_registry("all").evaluate(event_buffer(spark, folder)))
    return plain(scored.select("session_id", *[f"score_{k}" for k in CATEGORIES], *[f"warnings_{k}" for k in CATEGORIES]))


def _health(spark, folder, mode: str) -> DataFrame:
    evaluated = create_registry(mode).evaluate(event_buffer(spark, folder))
    return score.health_report(evaluated, include_security=mode == "all")


@query
def health_report(spark, folder):
    report = _health(spark, folder, "health")
    return plain(
        report.select("session_id", "action_count", "overall_score", "status", "health_warning_count", "exit_code")
    )


@query
def health_report_with_security(spark, folder):
    report = _health(spark, folder, "all")
    return plain(
        report.select(
            "session_id", "overall_score", "status", "health_warning_count", "security_warning_count", "exit_code"
        )
    )


@query
def security_score(spark, folder):
    report = score.security_report(create_registry("security").evaluate(event_buffer(spark, folder)))
    return plain(report.select("session_id", "security_score", "status", "exit_code", F.size("warnings").alias("found")))


@query
def efficiency(spark, folder):
    actions = events(spark, folder)
    report = score.session_efficiency(actions, b.buffer(actions))
    return plain(report.drop("recommendation"))


@query
def session_health(spark, folder):
    """Detectors, efficiency and rot blended into one score per session."""
    report = reports.session_health(events(spark, folder))
    return plain(
        report.select("session_id", "detector_score", "efficiency_score", "rot_score", "overall_score", "status")
        .withColumn("rot_score", F.round("rot_score", 6))
    )


@query
def report_json(spark, folder):
    """Fields read back from the JSON form of the health report."""
    report = reports.report_json(_health(spark, folder, "health"))

    def field(path: str) -> Column:
        return F.get_json_object("report", path)

    return report.select(
        "session_id",
        field("$.overall_score").cast("bigint").alias("overall_score"),
        field("$.status").alias("status"),
        field("$.categories.errors.score").cast("bigint").alias("errors_score"),
        field("$.categories.progress.warning_count").cast("bigint").alias("progress_warnings"),
        field("$.exit_code").cast("bigint").alias("exit_code"),
    )


@query
def status_themes(spark, folder):
    """Detector score of every session, worded in every theme."""
    return plain(
        status.with_all_themes(_health(spark, folder, "health").select("session_id", "overall_score")).drop("emoji")
    )


@query
def score_bars(spark, folder):
    report = _health(spark, folder, "health")
    s = F.col("overall_score")
    return report.select(
        "session_id", status.score_bar(s).alias("bar"), status.mini_bar(s / 100.0).alias("mini_bar")
    )


# --- agents and teams -------------------------------------------------------------------------------

def _ancestors(spark, folder):
    processes = tables.event_processes(spark, folder)
    return ag.nearest_ancestors(ag.find_agents(processes), processes)


@query
def find_agents(spark, folder):
    found = ag.find_agents(tables.event_processes(spark, folder))
    return found.select("pid", "agent_type", "project", F.round("memory_mb", 4).alias("memory_mb"), "cpu_percent")


@query
def agent_ancestors(spark, folder):
    return _ancestors(spark, folder).select("pid", "parent_pid", "parent_agent_pid")


@query
def agent_tree(spark, folder):
    placed = ag.agent_tree(_ancestors(spark, folder))
    return plain(
        placed.select(
            "pid", "depth", "team_id", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path")
        )
    )


@query
def agent_teams(spark, folder):
    return plain(ag.teams(ag.agent_tree(_ancestors(spark, folder))))


@query
def team_health(spark, folder):
    """Team scores over detector scores of the members' sessions."""
    placed = ag.agent_tree(_ancestors(spark, folder))
    names = ag.teams(placed).select("team_id", "team_name")
    scores = _health(spark, folder, "all").select("session_id", "overall_score")
    members = placed.select("pid", "team_id", "session_id").join(scores, "session_id").join(names, "team_id")
    teams = score.team_health(members)
    return plain(
        teams.select(
            "team_id", "team_name", "overall_score", "status", "member_count", "subagent_count",
            F.array_join(F.transform("cross_agent_warnings", lambda w: w["signal"]), ",").alias("signals"),
        )
    )


@query
def agent_presence(spark, folder):
    sightings, snapshots = tables.event_sightings(spark, folder, hours=24)
    return ag.presence(sightings, snapshots, reap_after_seconds=36 * 3600.0).select("agent_key", "snapshot_no", "event")


@query
def agent_tree_history(spark, folder):
    """Hierarchies of four process snapshots at once."""
    processes = tables.event_process_history(spark, folder)
    found = processes.where(ag.agent_type(F.col("args")).isNotNull())
    return history.agent_trees(history.nearest_ancestors(found, processes))


# --- log parsing over lines derived from the events ---------------------------------------------------

def structured_lines(spark, folder):
    """Events as message entries: tool uses, failed results and plain text."""
    a = events(spark, folder)
    use = F.struct(
        F.lit("tool_use").alias("type"), F.col("tool_name").alias("name"),
        F.struct(F.col("file_path"), F.col("command")).alias("input"),
    )
    said = F.struct(F.lit("text").alias("type"), F.col("outgoing_data").alias("text"))
    blocks = F.when(F.col("outgoing_data").isNotNull(), F.concat(
        F.concat(F.lit("["), F.to_json(said), F.lit(",")), F.to_json(use), F.lit("]")
    )).otherwise(F.concat(F.lit("["), F.to_json(use), F.lit("]")))
    result = F.struct(
        F.lit("tool_result").alias("type"), F.lit(True).alias("is_error"), F.col("error_message").alias("content")
    )
    content = F.when(F.col("success"), blocks).otherwise(F.concat(F.lit("["), F.to_json(result), F.lit("]")))
    role = F.when(F.col("success"), "assistant").otherwise("user")
    usage = F.to_json(F.struct(
        F.col("tokens_in").alias("input_tokens"), F.col("tokens_out").alias("output_tokens"),
        F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
        F.col("cache_read_tokens").alias("cache_read_input_tokens"),
    ))
    line = F.format_string(
        '{"type":"%s","sessionId":"%s","timestamp":"%s","message":{"role":"%s","usage":%s,"content":%s}}',
        role, F.col("session_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), role, usage, content,
    )
    return a.select(F.col("session_id").alias("source_file"), F.col("sub").alias("seq"), line.alias("value"))


def role_lines(spark, folder):
    a = events(spark, folder)
    entry = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.when(F.col("incoming_message").isNotNull(), "user").when(F.col("outgoing_data").isNotNull(), "assistant")
        .otherwise("tool").alias("role"),
        F.col("skill_name").alias("skill"),
        F.coalesce("incoming_message", "outgoing_data").alias("content"),
        F.struct(
            F.col("tool_name").alias("name"),
            F.struct(
                F.col("file_path").alias("path"), F.col("command").alias("cmd"), F.col("network_host").alias("url"),
                F.col("network_port").alias("port"),
            ).alias("input"),
        ).alias("tool_call"),
        F.col("error_message").alias("error"),
        F.col("session_id"),
    )
    return a.select(F.col("session_id").alias("source_file"), F.col("sub").alias("seq"), F.to_json(entry).alias("value"))


def flat_lines(spark, folder):
    a = events(spark, folder)
    entry = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("tool_name").alias("tool"), F.col("file_path").alias("file"), F.col("command"),
        F.col("error_message").alias("error"), F.col("tokens_in"), F.col("tokens_out").alias("output_tokens"),
    )
    return a.select(F.col("session_id").alias("source_file"), F.col("sub").alias("seq"), F.to_json(entry).alias("value"))


_PARSED = [
    "source_file", "seq", "tool_name", "tool_type", "success", "file_path", "command", "error_message", "outgoing_data"
]


@query
def parse_structured(spark, folder):
    parsed = jsonl.parse_logs(structured_lines(spark, folder))
    return plain(parsed.select(
        *_PARSED, "session_id", "sub", "tokens_in", "tokens_out", "cache_creation_tokens", "cache_read_tokens",
        b.micros(F.col("timestamp")).alias("micros"),
    ))


@query
def parse_role(spark, folder):
    parsed = jsonl.parse_logs(role_lines(spark, folder))
    return plain(parsed.select(
        *_PARSED, "session_id", "incoming_message", "network_host", "network_port", "skill_name", "raw_external"
    ))


@query
def parse_flat(spark, folder):
    parsed = jsonl.parse_logs(flat_lines(spark, folder))
    return plain(parsed.select(*_PARSED, "session_id", "tokens_in", "tokens_out"))


@query
def detect_dialects(spark, folder):
    """Three logs per session, one in each dialect, every log behind a metadata line."""
    lines = None
    for name, make in (("s", structured_lines), ("r", role_lines), ("f", flat_lines)):
        found = make(spark, folder).withColumn("source_file", F.concat_ws("/", F.lit(name), "source_file"))
        head = found.groupBy("source_file").agg(
            F.lit(-1).cast("bigint").alias("seq"), F.lit('{"type":"summary"}').alias("value")
        )
        both = found.unionByName(head)
        lines = both if lines is None else lines.unionByName(both)
    return jsonl.detect_dialect(jsonl.parse_lines(lines))


@query
def log_reports(spark, folder):
    """Lines of logs that hold half a session each -> actions -> one report for each session, in order of the files."""
    lines = flat_lines(spark, folder).withColumn("session", F.col("source_file"))
    part = F.when(F.col("seq") % 200 < 100, 0).otherwise(1)
    lines = lines.withColumn("source_file", F.concat_ws("/", "session", part.cast("string")))
    files = lines.select("source_file").distinct().withColumn("modified", F.substring_index("source_file", "/", -1).cast("long"))
    parsed = jsonl.in_file_order(jsonl.parse_logs(lines.select("source_file", "seq", "value")), files)
    actions = parsed.withColumn("session_id", F.substring_index("source_file", "/", 1))
    stats = b.session_stats(actions).select("session_id", "action_count", "total_tokens", "error_count", "files_touched")
    last = b.buffer(actions, 5).groupBy(F.col("session_id").alias("of")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tool_name"))), lambda r: r["tool_name"]), ",").alias("last_tools")
    )
    return plain(stats.join(last, F.col("session_id").eqNullSafe(F.col("of"))).drop("of"))


@query
def session_filter(spark, folder):
    """Parsed logs cut to one session."""
    parsed = jsonl.filter_session(jsonl.parse_logs(structured_lines(spark, folder)), "u3")
    return plain(parsed.groupBy("session_id").agg(F.count("*").alias("actions")))


@query
def scan_logs(spark, folder):
    """Events written as log files of many sessions each, found, read and put in order again."""
    place = shared_folder(spark)
    lines = structured_lines(spark, folder).withColumn("log", F.pmod(F.xxhash64("source_file"), F.lit(16)))
    ordered = lines.repartition("log").sortWithinPartitions("log", "seq")
    ordered.select("log", "value").write.partitionBy("log").text(place)
    actions = jsonl.read_actions(spark, place, pattern="*.txt", per="session")
    at, tool = F.struct("seq", "sub"), F.coalesce("tool_name", F.lit(""))
    return actions.groupBy("session_id").agg(
        F.count("*").alias("actions"), F.count_if(~F.col("success")).alias("failures"),
        F.min_by(tool, at).alias("first_tool"), F.max_by(tool, at).alias("last_tool"),
    )


# --- streams, run to the end of the table and read back ---------------------------------------------------


def _drained(stream: DataFrame) -> DataFrame:
    """Everything a stream has to say about the data at hand, through a table in the shared folder."""
    spark = stream.sparkSession
    place = shared_folder(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{place}/out")
    writer.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@query
def stream_new_skills(spark, folder):
    found = _drained(watch.new_skills(tables.event_action_stream(spark, folder)))
    return found.select("session_id", "skill_name")


@query
def stream_live_spans(spark, folder):
    """Users seen again within a day; spans still open at the end are marked."""
    seen = tables.event_stream(spark, folder).select(
        F.col("user_id").alias("agent_key"), F.col("ts").cast("timestamp").alias("taken_at")
    )
    spans = _drained(watch.live_spans(seen, timeout="24 hours", lateness="10 seconds"))
    table = tables.table(spark, folder, "events").select(
        F.col("user_id").alias("agent_key"), F.col("ts").cast("timestamp").alias("taken_at")
    )
    still = watch.open_spans(table, spans, timeout="24 hours").withColumn("open", F.lit(True))
    return spans.withColumn("open", F.lit(False)).unionByName(still).select(
        "agent_key", F.unix_micros("seen_from").alias("seen_from"), F.unix_micros("expired_at").alias("expired_at"),
        "sightings", "open",
    )


@query
def stream_smoothing(spark, folder):
    ticks = tables.event_action_stream(spark, folder).select(
        "session_id", F.col("seq").alias("tick"), ((F.col("tokens_in") % 100) / 100.0).alias("raw_score"),
        F.lit(0.0).alias("constraint"), F.lit(0.0).alias("thrash"),
    )
    found = _drained(watch.smooth_stream(ticks))
    return plain(
        found.select("session_id", F.col("tick").alias("snapshot_id"), F.round("smoothed_score", 6).alias("smoothed_score"), "state")
    )


@query
def stream_reports(spark, folder):
    """Reports of the last micro-batch of the continuous evaluation, on smoothed rot scores."""
    place = shared_folder(spark)
    writer = watch.watch(tables.event_action_stream(spark, folder), f"{place}/reports", f"{place}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = _drained(watch.live_reports(spark, f"{place}/reports"))
    latest = found.groupBy("session_id").agg(
        F.max_by(F.struct("detector_score", "efficiency_score", "overall_score"), "tick").alias("r")
    )
    return plain(latest.select("session_id", "r.*"))


def _landed(df: DataFrame, steps: list, start: Callable[[DataFrame, str], None]) -> str:
    """Run a stream over rows of ``df`` that land in the order of ``steps`` (values of its column ``step``), a micro-batch
    each; ``start(stream, place)`` runs it to the end of what is there. Gives the folder that holds what it wrote.

    Rows are written once, a folder for each step; one that the stream's path does not name yet has not landed. State has
    a fixed cost for each partition and micro-batch, so it gets as many partitions as tasks run at once.
    """
    spark = df.sparkSession
    place = shared_folder(spark)
    df.where(F.col("step").isin(steps)).write.partitionBy("step").parquet(f"{place}/in")
    rows = spark.readStream.schema(df.drop("step").schema)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(parts), spark.sparkContext.defaultParallelism))
    try:
        for i in range(len(steps)):
            start(rows.parquet(f"{place}/in/step={{{','.join(map(str, steps[: i + 1]))}}}"), place)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return place


@query
def stream_dialects(spark, folder):
    """Logs in each dialect cut into six segments, two of metadata first, that land one by one and not in order."""
    lines = None
    for name, make in (("s", structured_lines), ("r", role_lines), ("f", flat_lines)):
        found = make(spark, folder).select(F.concat_ws("/", F.lit(name), "source_file").alias("log"), "seq", "value")
        lines = found if lines is None else lines.unionByName(found)
    last = tables.table(spark, folder, "events").agg(F.max("event_id")).first()[0]
    cut = lines.withColumn("segment", F.expr(f"2 + 4 * seq div {last + 1}"))
    # Every log has all its segments, events or not: each starts with metadata.
    heads = lines.groupBy("log").agg(F.lit(0).cast("long").alias("seq"), F.lit('{"type":"summary"}').alias("value"))
    heads = heads.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    rows = cut.withColumn("seq", F.col("seq") + 1).unionByName(heads).withColumn("step", F.col("segment"))

    def start(stream, place):
        writer = dialects.log_actions(stream).writeStream.format("parquet").option("path", f"{place}/out")
        writer.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()

    place = _landed(rows, [0, 2, 1, 3, 5, 4], start)
    found = spark.read.parquet(f"{place}/out")
    # Metadata behind the decisive line is parsed like any other line; it stands at place 0 of its segment.
    at = F.col("seq").bitwiseAND(F.lit((1 << dialects.PLACE) - 1))
    return plain(found.withColumn("seq", at - 1).where("seq >= 0").select(*_PARSED))


@query
def stream_skill_warnings(spark, folder):
    """Warnings about new skills tick by tick, events landing in five steps: a session is warned of a skill once."""
    last = tables.table(spark, folder, "events").agg(F.max("event_id")).first()[0]
    actions = events(spark, folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = actions.withColumn("step", F.expr(f"5 * sub div {last + 1}"))

    def start(stream, place):
        writer = watch.watch(stream, f"{place}/reports", f"{place}/state")
        writer.trigger(availableNow=True).start().awaitTermination()

    place = _landed(rows, [0, 1, 2, 3, 4], start)
    found = spark.read.parquet(f"{place}/reports").select("session_id", F.col("tick").cast("long").alias("tick"), F.explode("warnings").alias("w"))
    return found.where("w.signal = 'new_skill'").select("session_id", "tick", F.col("w.details")["skill"].alias("skill"))


@query
def stream_presence(spark, folder):
    """Presence events of users in daily snapshots, landing in five steps, told as the watermark passes."""
    sightings, _ = tables.event_sightings(spark, folder, hours=24)
    low, high = sightings.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    rows = sightings.select(
        "agent_key", F.timestamp_seconds(F.col("snapshot_no") * 86400).alias("taken_at"),
        F.expr(f"5 * (snapshot_no - {low}) div {high - low + 1}").alias("step"),
    )

    def start(stream, place):
        told = presence.live_presence(stream, every_seconds=86400.0, reap_after_seconds=36 * 3600.0)
        writer = told.writeStream.format("parquet").option("path", f"{place}/out")
        writer.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()

    place = _landed(rows, [0, 1, 2, 3, 4], start)
    found = spark.read.parquet(f"{place}/out")
    return found.select(
        F.col("agent_key").cast("long").alias("agent_key"), F.expr("unix_seconds(taken_at) div 86400").alias("snapshot_no"), "event"
    )
