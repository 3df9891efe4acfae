"""Small hand-made sessions."""

from datetime import datetime, timedelta

from tracewarden.model import ACTION_COLUMNS, ACTION_SCHEMA

T0 = datetime(2025, 1, 1, 12, 0, 0)
TYPES = {"Read": "read", "Edit": "edit", "Write": "write", "Bash": "bash", "Grep": "search", "WebFetch": "browser"}


def act(tool="Read", **fields):
    seconds = fields.pop("at", None)
    return {"tool_name": tool, "tool_type": TYPES.get(tool, "unknown"), "success": True, "at": seconds, **fields}


def read(path, **f):
    return act("Read", file_path=path, **f)


def edit(path, **f):
    return act("Edit", file_path=path, **f)


def ok(command="pytest", **f):
    return act("Bash", command=command, **f)


def fail(command="pytest", error="boom", **f):
    return act("Bash", command=command, success=False, error_message=error, **f)


def say(text, **f):
    return act("text", outgoing_data=text, **f)


def sessions(spark, cases):
    """One session per case: name -> list of actions."""
    rows = []
    for name, actions in cases.items():
        for i, a in enumerate(actions):
            seconds = a.get("at")
            row = {
                "session_id": name, "seq": i, "sub": 0, "duration_ms": 0, "cost_usd": 0.0, "tokens_in": 0, "tokens_out": 0,
                "cache_creation_tokens": 0, "cache_read_tokens": 0,
                "timestamp": T0 + timedelta(seconds=i if seconds is None else seconds),
            }
            row.update({k: v for k, v in a.items() if k != "at"})
            rows.append(tuple(row.get(c) for c in ACTION_COLUMNS))
    return spark.createDataFrame(rows, ACTION_SCHEMA)
