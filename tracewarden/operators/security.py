"""Security detectors: the earliest suspicious action of the window raises the warning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewarden.functions import classify as c, fixed_values as fv
from tracewarden.operators.detector import A, Detector, first_hit, js, rows_in_order, top_entry, warn, within


def _cut(value: Column, size: int) -> Column:
    return F.left(value, F.lit(size))


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _command_rule(
    name: str, category: str, description: str, patterns: list[str], window: int, severity: str,
    signal: str, message: str, size: int, with_tool: bool,
) -> Detector:
    """First command in the window that matches any pattern."""
    hit = F.col(f"{name}__hit")
    details = {"command": hit["command"], **({"tool": hit["tool"]} if with_tool else {})}
    return Detector(
        name, category, description,
        aggs={
            f"{name}__hit": first_hit(
                within(window) & A.command.rlike(fv.any_of(patterns)), _struct(command=_cut(A.command, size), tool=A.tool)
            )
        },
        warning=F.when(hit.isNotNull(), warn(category, severity, signal, message, **details)),
    )


# --- credentials (published by name and intent only; windows and severities are own choices) ---

def _credential_target() -> Column:
    return F.when(c.is_sensitive_path(A.file), A.file).when(c.is_sensitive_path(A.command), A.command)


def credential_access(name: str = "credential_access", window: int = 10) -> Detector:
    hit = F.col(f"{name}__hit")
    return Detector(
        name, "credential", "Access to credential files",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & _credential_target().isNotNull(), _struct(target=_credential_target(), tool=A.tool)
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn(
                "credential", "high", "credential_access",
                F.concat(F.lit("Access to credentials: "), _cut(hit["target"], 80)),
                target=_cut(hit["target"], 100), tool=hit["tool"],
            ),
        ),
    )


def secret_in_output(name: str = "secret_in_output", window: int = 10) -> Detector:
    hit = F.col(f"{name}__hit")
    text = F.col("outgoing_data")
    return Detector(
        name, "credential", "API keys or tokens in output",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & text.rlike(fv.any_of(fv.SECRETS)), _struct(tool=A.tool, size=F.length(text))
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn("credential", "critical", "secret_in_output", "Secret found in output",
                 tool=hit["tool"], size=hit["size"]),
        ),
    )


def credential_exfiltration(name: str = "credential_exfiltration", window: int = 30) -> Detector:
    accessed, sent = F.col(f"{name}__accessed"), F.col(f"{name}__sent")
    reached = F.filter(sent, lambda r: r["pos"] >= accessed["pos"])
    target = F.get(reached, F.lit(0))
    return Detector(
        name, "exfiltration", "Network activity after access to credentials",
        aggs={
            f"{name}__accessed": first_hit(
                within(window) & _credential_target().isNotNull(),
                _struct(pos=F.col("pos"), target=_credential_target()),
            ),
            f"{name}__sent": rows_in_order(within(window) & A.network, host=F.col("network_host")),
        },
        warning=F.when(
            target.isNotNull(),
            warn(
                "exfiltration", "critical", "credential_exfiltration", "Network activity after access to credentials",
                target=_cut(accessed["target"], 100), host=target["host"],
            ),
        ),
    )


# --- injection ------------------------------------------------------------------------

def prompt_injection(name: str = "prompt_injection", window: int = 10) -> Detector:
    text = F.col("incoming_message")
    sure = text.rlike(fv.any_of(fv.INJECTION_HIGH_CONFIDENCE))
    pattern = fv.any_of(fv.INJECTION_PATTERNS)
    hit = F.col(f"{name}__hit")
    high, count = hit["high"], hit["count"]
    return Detector(
        name, "injection", "Potential prompt injection attempt detected",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & text.isNotNull() & (sure | text.rlike(pattern)),
                _struct(high=sure, count=F.regexp_count(text, F.lit(pattern))),
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn(
                "injection",
                F.when(high, "critical").when(count > 1, "high").otherwise("medium"),
                "prompt_injection",
                F.when(high, "High-confidence prompt injection attempt detected").otherwise(
                    F.format_string("Possible prompt injection attempt (%d pattern match)", count)
                ),
                source=F.lit("incoming_message"),
                match_count=F.when(~high, count),
                confidence=F.when(high, "high").otherwise("medium"),
            ),
        ),
    )


def hidden_instruction(
    name: str = "hidden_instruction", window: int = 10, patterns: list[str] | None = None
) -> Detector:
    content = F.concat(F.coalesce(F.col("incoming_message"), F.lit("")), F.coalesce(F.col("raw_content"), F.lit("")))
    hit = F.col(f"{name}__hit")
    return Detector(
        name, "injection", "Hidden or encoded instructions detected",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & content.rlike(fv.any_of(patterns or fv.HIDDEN_CONTENT)), _struct(tool=A.tool)
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn("injection", "high", "hidden_instruction", "Hidden or encoded content detected", source=hit["tool"]),
        ),
    )


def indirect_injection(
    name: str = "indirect_injection", window: int = 10, patterns: list[str] | None = None
) -> Detector:
    external = F.col("tool_type").isin("read", "browser", "mcp")
    found = F.col("raw_external").rlike(fv.any_of(patterns or fv.INDIRECT_INSTRUCTIONS))
    hit = F.col(f"{name}__hit")
    return Detector(
        name, "injection", "Potential injection from external content",
        aggs={
            f"{name}__hit": first_hit(within(window) & external & found, _struct(type=F.col("tool_type"), tool=A.tool))
        },
        warning=F.when(
            hit.isNotNull(),
            warn(
                "injection", "medium", "indirect_injection",
                F.format_string("Instruction-like content in external source (%s)", hit["tool"]),
                source_type=hit["type"], tool=hit["tool"],
            ),
        ),
    )


# --- network ----------------------------------------------------------------------------

def network_anomaly(name: str = "network_anomaly", window: int = 20) -> Detector:
    lowered = F.lower(A.command)
    signal = (
        F.when(A.host.rlike(fv.any_of(fv.SUSPICIOUS_HOSTS)), "suspicious_host")
        .when(A.port.isin(*fv.SUSPICIOUS_PORTS), "suspicious_port")
        .when(c.contains_any(lowered, fv.UPLOAD_TOOLS) & c.contains_any(lowered, fv.UPLOAD_FLAGS), "data_upload")
    )
    hit = F.col(f"{name}__hit")
    kind = hit["signal"]
    upload = kind == "data_upload"
    return Detector(
        name, "network", "Unusual network activity detected",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & signal.isNotNull(),
                _struct(
                    signal=signal, host=F.col("network_host"), port=F.col("network_port"), command=_cut(A.command, 80)
                ),
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn(
                "network",
                F.when(upload, "medium").otherwise("high"),
                kind,
                F.when(upload, "Data being uploaded via command line")
                .when(kind == "suspicious_host", F.concat(F.lit("Connection to suspicious host: "), hit["host"]))
                .otherwise(F.format_string("Connection to suspicious port: %d", hit["port"])),
                host=F.when(~upload, hit["host"]), port=F.when(~upload, hit["port"]),
                command=F.when(upload, hit["command"]),
            ),
        ),
    )


def data_exfiltration(
    name: str = "data_exfiltration", window: int = 30, min_reads: int = 3, large: int = 10_000
) -> Detector:
    reads, sent, size = F.col(f"{name}__reads"), F.col(f"{name}__sent"), F.col(f"{name}__size")
    first_read = F.get(reads, F.lit(0))["pos"]
    contact = F.get(F.filter(sent, lambda r: r["pos"] >= first_read), F.lit(0))["pos"]
    before = F.transform(F.filter(reads, lambda r: r["pos"] <= F.col(f"{name}__contact")), lambda r: r["file"])
    files = F.col(f"{name}__files")
    count = F.size(files)
    pattern = F.col(f"{name}__contact").isNotNull() & (count >= min_reads)
    outgoing = F.length(F.col("outgoing_data"))
    return Detector(
        name, "exfiltration", "Potential data exfiltration detected",
        aggs={
            f"{name}__reads": rows_in_order(within(window) & A.read & A.file.isNotNull(), file=A.file),
            f"{name}__sent": rows_in_order(within(window) & A.network),
            f"{name}__size": first_hit(within(window) & (outgoing > large), outgoing),
        },
        derive=[{f"{name}__contact": contact}, {f"{name}__files": before}],
        warning=F.when(
            (A.n >= 5) & (pattern | size.isNotNull()),
            warn(
                "exfiltration",
                F.when(pattern, "high").otherwise("medium"),
                F.when(pattern, "exfil_pattern").otherwise("large_outgoing"),
                F.when(pattern, F.format_string("Network activity after reading %d files", count)).otherwise(
                    F.format_string("Large data payload (%d bytes) in output", size)
                ),
                files_read=F.when(pattern, js(F.slice(files, 1, 5))),
                file_count=F.when(pattern, count),
                size_bytes=F.when(~pattern, size),
            ),
        ),
    )


def c2_communication(
    name: str = "c2_communication", window: int = 50, min_connections: int = 5, min_same_host: int = 4
) -> Detector:
    hit, rows, top = F.col(f"{name}__hit"), F.col(f"{name}__rows"), F.col(f"{name}__top")
    hosts = F.filter(F.transform(rows, lambda r: r["host"]), lambda h: h.isNotNull())
    return Detector(
        name, "network", "Potential C2 communication pattern detected",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & A.command.rlike(fv.any_of(fv.BEACON_COMMANDS)), _struct(command=_cut(A.command, 80))
            ),
            f"{name}__rows": rows_in_order(within(window) & A.network, host=A.host),
        },
        derive=[{f"{name}__top": top_entry(hosts)}],
        warning=F.when(
            (A.n >= 10) & hit.isNotNull(),
            warn("network", "critical", "c2_beacon", "Command pattern consistent with C2 beacon",
                 command=hit["command"], host=F.lit(None), connection_count=F.lit(None)),
        ).when(
            (A.n >= 10) & (F.size(rows) >= min_connections) & (top["count"] >= min_same_host),
            warn("network", "medium", "repeated_beacon",
                 F.format_string("Repeated connections to %s (%dx)", top["key"], top["count"]),
                 command=F.lit(None), host=top["key"], connection_count=top["count"]),
        ),
    )


def dns_exfiltration(name: str = "dns_exfiltration", window: int = 15) -> Detector:
    return _command_rule(
        name, "exfiltration", "Potential DNS exfiltration detected", fv.DNS_COMMANDS, window, "high", "dns_exfil",
        "Potential DNS exfiltration pattern", 80, False,
    )


# --- privilege -----------------------------------------------------------------------------

def privilege_escalation(name: str = "privilege_escalation", window: int = 10) -> Detector:
    return _command_rule(
        name, "privilege", "Privilege escalation attempt detected", fv.PRIVILEGE_COMMANDS, window, "critical",
        "privilege_escalation", "Privilege escalation command detected", 100, True,
    )


def dangerous_command(name: str = "dangerous_command", window: int = 10) -> Detector:
    return _command_rule(
        name, "privilege", "Potentially dangerous command detected", fv.DANGEROUS_COMMANDS, window, "critical",
        "dangerous_command", "Dangerous command detected", 100, True,
    )


def mass_file_operation(name: str = "mass_file_operation", threshold: int = 10, window: int = 20) -> Detector:
    deletes, writes = F.col(f"{name}__deletes"), F.col(f"{name}__writes")
    mass = deletes >= threshold
    return Detector(
        name, "privilege", "Mass file operation detected",
        aggs={
            f"{name}__deletes": F.count_if(within(window) & c.contains_any(A.command, ["rm ", "unlink", "shred"])),
            f"{name}__writes": F.count_if(within(window) & A.edit),
        },
        warning=F.when(
            (A.n >= window) & (mass | (writes >= threshold * 2)),
            warn(
                "privilege",
                F.when(mass, "high").otherwise("medium"),
                F.when(mass, "mass_delete").otherwise("mass_overwrite"),
                F.when(mass, F.format_string("Mass file deletion detected (%d operations)", deletes)).otherwise(
                    F.format_string("Unusual volume of file modifications (%d)", writes)
                ),
                delete_count=F.when(mass, deletes), overwrite_count=F.when(~mass, writes),
            ),
        ),
    )


def sensitive_directory(name: str = "sensitive_directory", window: int = 10) -> Detector:
    path = F.coalesce(A.file, A.command)
    hit = F.col(f"{name}__hit")
    return Detector(
        name, "privilege", "Access to sensitive system directory",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & path.rlike(fv.any_of(fv.SENSITIVE_DIRECTORIES, ignore_case=False)),
                _struct(path=path, edit=A.edit),
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn(
                "privilege",
                F.when(hit["edit"], "high").otherwise("medium"),
                "sensitive_directory",
                F.concat(F.lit("Access to sensitive directory: "), _cut(hit["path"], 50)),
                path=hit["path"], operation=F.when(hit["edit"], "write").otherwise("read"),
            ),
        ),
    )


# --- supply chain -----------------------------------------------------------------------------

def malicious_skill(name: str = "malicious_skill", window: int = 15) -> Detector:
    signal = F.when(A.command.rlike(fv.any_of(fv.SKILL_COMMANDS)), "malicious_skill").when(
        A.file.rlike(fv.any_of(fv.SKILL_PATHS)), "skill_credential_access"
    )
    hit = F.col(f"{name}__hit")
    runs = hit["signal"] == "malicious_skill"
    return Detector(
        name, "supply_chain", "Skill exhibiting suspicious behavior",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & A.skill.isNotNull() & signal.isNotNull(),
                _struct(signal=signal, skill=A.skill, command=_cut(A.command, 80), path=A.file),
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn(
                "supply_chain",
                F.when(runs, "critical").otherwise("high"),
                hit["signal"],
                F.concat(
                    F.lit("Skill '"), hit["skill"],
                    F.when(runs, "' executing suspicious command").otherwise("' accessing sensitive file"),
                ),
                skill=hit["skill"], command=F.when(runs, hit["command"]), path=F.when(~runs, hit["path"]),
            ),
        ),
    )


def skill_network(name: str = "skill_network", window: int = 20) -> Detector:
    hit = F.col(f"{name}__hit")
    return Detector(
        name, "supply_chain", "Skill making network requests",
        aggs={
            f"{name}__hit": first_hit(
                within(window) & A.skill.isNotNull() & A.network,
                _struct(skill=A.skill, host=F.col("network_host"), port=F.col("network_port")),
            )
        },
        warning=F.when(
            hit.isNotNull(),
            warn(
                "supply_chain", "medium", "skill_network",
                F.format_string("Skill '%s' making network request", hit["skill"]),
                skill=hit["skill"], host=hit["host"], port=hit["port"],
            ),
        ),
    )


def new_skill(name: str = "new_skill", window: int = 10) -> Detector:
    """A single evaluation knows no skill yet: the window's first skill is new."""
    skill = F.col(f"{name}__skill")
    return Detector(
        name, "supply_chain", "New skill started executing",
        aggs={f"{name}__skill": first_hit(within(window) & A.skill.isNotNull(), A.skill)},
        warning=new_skill_warning(skill),
    )


def new_skill_warning(skill: Column) -> Column:
    """Null where ``skill`` is."""
    return F.when(
        skill.isNotNull(),
        warn("supply_chain", "low", "new_skill", F.concat(F.lit("New skill started: "), skill), skill=skill),
    )


def skill_chain(name: str = "skill_chain", window: int = 20, min_transitions: int = 3) -> Detector:
    skills = F.transform(F.col(f"{name}__rows"), lambda r: r["skill"])
    kept = F.col(f"{name}__skills")
    pairs = F.filter(
        F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))),
                   F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))),
                   lambda a, b: F.array(a, b)),
        lambda p: p[0] != p[1],
    )
    moves = F.col(f"{name}__moves")
    return Detector(
        name, "supply_chain", "Suspicious skill chaining detected",
        aggs={f"{name}__rows": rows_in_order(within(window) & A.skill.isNotNull(), skill=A.skill)},
        derive=[{f"{name}__skills": skills}, {f"{name}__moves": pairs}],
        warning=F.when(
            (A.n >= 5) & (F.size(moves) >= min_transitions),
            warn(
                "supply_chain", "medium", "skill_chain",
                F.format_string("Multiple skill transitions detected (%d)", F.size(moves)),
                transitions=js(F.slice(moves, 1, 5)), count=F.size(moves),
            ),
        ),
    )


def skill_install(name: str = "skill_install", window: int = 10) -> Detector:
    return _command_rule(
        name, "supply_chain", "New skill being installed", fv.SKILL_INSTALLS, window, "high", "skill_install",
        "New skill being installed", 80, False,
    )


def all_security() -> list[Detector]:
    return [
        credential_access(), secret_in_output(), credential_exfiltration(),
        prompt_injection(), hidden_instruction(), indirect_injection(),
        network_anomaly(), data_exfiltration(), c2_communication(), dns_exfiltration(),
        privilege_escalation(), dangerous_command(), mass_file_operation(), sensitive_directory(),
        malicious_skill(), skill_network(), new_skill(), skill_chain(), skill_install(),
    ]


# --- whole history ------------------------------------------------------------------------------

def first_seen_skills(actions):
    """Position of every skill's first use per session, over the whole history."""
    return actions.where(c.present(A.skill).isNotNull()).groupBy("session_id", "skill_name").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("uses")
    )
