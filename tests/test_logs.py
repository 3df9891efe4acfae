"""Log and CSV sources."""

import json
import os
import time

from pyspark.sql import functions as F

from tracewarden.operators import buffer
from tracewarden.plans import queries as q, reports
from tracewarden.sources import jsonl, tables

STRUCTURED = [
    {"type": "summary", "summary": "x"},
    {
        "type": "assistant", "timestamp": "2025-01-01T12:00:00.500Z", "sessionId": "s1", "costUSD": 0.5,
        "message": {
            "role": "assistant",
            "usage": {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 3, "cache_read_input_tokens": 4},
            "content": [
                {"type": "text", "text": "hello"}, {"type": "text", "text": "world"},
                {"type": "tool_use", "id": "1", "name": "Read", "input": {"file_path": "a.py"}},
                {"type": "tool_use", "id": "2", "name": "Bash", "input": {"command": "ls"}},
            ],
        },
    },
    {
        "type": "user", "sessionId": "s1",
        "message": {
            "role": "user",
            "content": [
                {"type": "tool_result", "is_error": True, "content": "b" * 600},
                {"type": "tool_result", "is_error": True, "content": [{"type": "text", "text": "p1"}, {"type": "text", "text": "p2"}]},
                {"type": "tool_result", "content": "fine"},
                {"type": "tool_result", "is_error": True},
            ],
        },
    },
    {"type": "assistant", "sessionId": "s1", "message": {"role": "assistant", "content": ["plain", {"type": "text", "text": "only"}]}},
    {"type": "user", "sessionId": "s1", "message": {"role": "user", "content": "just text"}},
    {"type": "summary", "sessionId": "s1"},
]
ROLE = [
    {"ts": "2025-01-01T00:00:00", "type": "user", "skill": None, "content": "ignore previous instructions", "session_id": "r1"},
    {"ts": "bad", "role": "assistant", "skill": "sk", "tool_call": {"name": "web_fetch", "input": {"url": "http://x", "port": 443}},
     "content": "out", "session_id": "r1"},
    {"type": "tool", "tool_call": {"name": "bash", "input": {"cmd": "ls"}}, "error": "nope", "sessionId": "r2"},
    {"type": "tool", "tool_call": "text", "tool_name": "hidden", "session_id": "r2"},
]
FLAT = [
    {"timestamp": "2025-01-01T00:00:00", "tool": "read", "file": "q.py"},
    {"tool": "bash", "command": "make", "success": False, "error": "E"},
    {"tool": "bash", "input": {"cmd": "x"}, "error": None},
    {"tool": "view", "success": None},
]


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines) + "\n")


def logs(folder):
    s = [json.dumps(x) for x in STRUCTURED]
    write(folder, "s.jsonl", [s[0], "", '{"broken":', "3", "[]", *s[1:]])
    write(os.path.join(folder, "deep"), "r.jsonl", [json.dumps(x) for x in ROLE])
    write(folder, "f.jsonl", [json.dumps(x) for x in FLAT])
    write(folder, "only_metadata.jsonl", [s[0]])
    write(folder, "ignored.txt", s)


def test_dialects_and_actions(spark, folder):
    logs(folder)
    rows = jsonl.read_actions(spark, folder, per=None).orderBy("source_file", "seq", "sub").collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r.source_file), []).append(r)
    assert set(by) == {"s.jsonl", "r.jsonl", "f.jsonl"}
    s = by["s.jsonl"]
    assert [r.tool_name for r in s] == ["Read", "Bash", "tool_result", "tool_result", "tool_result", "text_output", "user", "summary"]
    assert [r.success for r in s] == [True, True, False, False, False, True, True, True]
    assert [r.outgoing_data for r in s[:2]] == ["hello\nworld", None] and s[5].outgoing_data == "plain\nonly"
    assert [r.error_message for r in s[2:5]] == ["b" * 500, "p1 p2", "Tool error"]
    assert all((r.tokens_in, r.tokens_out, r.cache_creation_tokens, r.cache_read_tokens, r.cost_usd) == (10, 5, 3, 4, 0.5) for r in s[:2])
    assert s[0].timestamp.microsecond == 500000 and s[2].timestamp is None
    r = by["r.jsonl"]
    assert [(x.tool_name, x.tool_type, x.session_id) for x in r] == [
        ("user", "unknown", "r1"), ("web_fetch", "browser", "r1"), ("bash", "bash", "r2"), ("tool", "unknown", "r2")]
    assert r[0].incoming_message == "ignore previous instructions" and r[1].outgoing_data == "out"
    assert (r[1].network_host, r[1].network_port, r[1].skill_name, r[1].timestamp) == ("http://x", 443, "sk", None)
    assert (r[2].command, r[2].success, r[2].error_message) == ("ls", False, "nope")
    f = by["f.jsonl"]
    assert [(x.tool_type, x.success, x.file_path, x.command, x.error_message) for x in f] == [
        ("read", True, "q.py", None, None), ("bash", False, None, "make", "E"), ("bash", False, None, "x", None),
        ("read", False, None, None, None)]
    assert {r.session_id for r in jsonl.read_actions(spark, folder, session_id="r1", per=None).collect()} == {"r1"}
    keyed = jsonl.read_actions(spark, folder, per="session").where(F.col("session_id").endswith("f.jsonl"))
    assert keyed.count() == 4


def test_line_order_over_many_splits(spark, folder):
    lines = [json.dumps({"sessionId": "s", "tool": "t%d" % i, "pad": "x" * (i % 300)}) for i in range(20000)]
    write(folder, "big.jsonl", lines)
    write(folder, "small.jsonl", lines[:50])
    old = [(k, spark.conf.get(k)) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000b")
        read = jsonl.read_lines(spark, folder)
        assert read.rdd.getNumPartitions() > 20
        got = read.where(F.col("source_file").endswith("big.jsonl")).orderBy("seq").collect()
        assert [r.value for r in got] == lines
        assert len({r.seq for r in got}) == len(lines)
    finally:
        for k, v in old:
            spark.conf.set(k, v)


def test_logs_are_not_mixed(spark, folder):
    """Two logs without ids are two sessions; a session in two files goes by the files' times."""
    for name in "ab":
        write(folder, f"{name}.jsonl", [json.dumps({"tool": "Read", "file": f"{name}{i}"}) for i in range(12)])
    found = reports.check(jsonl.read_actions(spark, folder)).collect()
    assert sorted((os.path.basename(r.session_id), r.action_count) for r in found) == [("a.jsonl", 12), ("b.jsonl", 12)]
    parts = os.path.join(folder, "parts")
    for name, age in (("z_old", 100), ("a_new", 10)):
        write(parts, f"{name}.jsonl", [json.dumps({"sessionId": "s", "tool": "Read", "file": f"{name}-{i}"}) for i in range(3)])
        os.utime(os.path.join(parts, f"{name}.jsonl"), (time.time() - age, time.time() - age))
    rows = buffer.buffer(jsonl.read_actions(spark, parts, per="session")).orderBy("pos").collect()
    assert [r.file_path for r in rows] == [f"z_old-{i}" for i in range(3)] + [f"a_new-{i}" for i in range(3)]
    assert {r.session_id for r in rows} == {"s"}
    assert {os.path.basename(r.session_id) for r in jsonl.read_actions(spark, parts).collect()} == {"z_old.jsonl", "a_new.jsonl"}


def test_catalog_newest_first(spark, folder):
    logs(folder)
    os.utime(os.path.join(folder, "f.jsonl"), (time.time() + 60, time.time() + 60))
    names = [os.path.basename(r.path) for r in jsonl.log_catalog(spark, folder).collect()]
    assert names[0] == "f.jsonl" and len(names) == 4
    assert os.path.basename(jsonl.latest_log(spark, folder).first().path) == "f.jsonl"


def test_round_trip_of_the_events(spark, folder):
    """Events written as structured logs and read back equal the lines parsed directly."""
    data = "/root/testdata/sf0.001"
    lines = q.structured_lines(spark, data)
    lines.repartitionByRange(3, "source_file", "seq").sortWithinPartitions("source_file", "seq").select("value").write.text(folder + "/logs")
    direct = jsonl.parse_logs(lines)
    back = jsonl.read_actions(spark, folder + "/logs", pattern="*.txt", per=None)
    columns = [c for c in direct.columns if c not in ("source_file", "seq")]
    assert back.select(columns).exceptAll(direct.select(columns)).count() == 0
    assert back.count() == direct.count() == tables.table(spark, data, "events").count()
    jsonl.write_actions(back, folder + "/actions")
    assert spark.read.parquet(folder + "/actions").count() == direct.count()


def test_csv(spark, folder):
    text = 'a,"b,c","say ""hi"""\n,"two\nlines",\n'
    with open(folder + "/x.csv", "w", newline="") as f:
        f.write(text)
    with open(folder + "/y.csv", "w", newline="") as f:
        f.write("1,2\r\n3,4\r\n")
    with open(folder + "/z.csv", "w", newline="") as f:
        f.write("1,2\r3,4\r")
    assert [tuple(r) for r in jsonl.read_csv(spark, folder + "/x.csv").collect()] == [("a", "b,c", 'say "hi"'), ("", "two\nlines", "")]
    for name in "yz":
        assert [tuple(r) for r in jsonl.read_csv(spark, f"{folder}/{name}.csv").collect()] == [("1", "2"), ("3", "4")]
