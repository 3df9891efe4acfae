"""Health detectors on hand-made sessions: guards, ties, boundaries."""

import json

import pytest

from helpers import act, edit, fail, ok, read, sessions
from tracewarden.operators import buffer as b, health as h
from tracewarden.operators.detector import detect

FILL = [ok("ls %d" % i) for i in range(40)]

CASES = {
    # loop: first seen wins the tie; guard at 9 and 10 actions
    "loop_short": [ok("x")] * 9,
    "loop_10": [ok("x")] * 10,
    "loop_tie": [read("a"), read("b")] * 4 + [ok("1"), edit("z")],
    "loop_failing": [ok(str(i)) for i in range(5)] + [fail("make", "E1"), read("q")] + [fail("make2", "E2")] * 3,
    # reread: the first file to qualify, not the worst
    "reread_first": [read("a")] * 3 + [read("b")] * 5 + FILL[:7],
    "reread_two": [read("a")] * 2 + [ok(str(i)) for i in range(13)],
    # thrash: an edit among the last two actions does not count
    "thrash": FILL[:11] + [edit("f"), ok("n"), fail(error="E" * 200)] * 3,
    "thrash_tail": FILL[:14] + [edit("f"), fail()] * 2 + [edit("f"), fail()],
    "thrash_far": FILL[:5] + [edit("f"), ok(), ok(), ok(), fail()] * 3,
    # stall
    "stall": [read("f%d" % i) for i in range(9)] + [act("WebFetch")] * 6,
    "stall_edit": [read("f%d" % i) for i in range(9)] + [edit("z")] + [act("WebFetch")] * 5,
    # same outcome: nearest failure in the next four actions
    "same_outcome": FILL[:16] + [edit("a"), fail(error="TypeError: 1"), ok()] * 3,
    "same_outcome_far": FILL[:7] + [edit("a"), ok(), ok(), ok(), ok(), fail(error="TypeError")] * 3,
    # file churn: a successful command resets
    "churn": FILL[:24] + [edit("a"), edit("b"), edit("a"), edit("a"), edit("a"), fail(error="X")],
    "churn_reset": FILL[:24] + [edit("a"), edit("a"), edit("a"), ok(), edit("a"), edit("a")],
    # exploration stall
    "explore_stuck": [read("a"), read("b")] + FILL[:8] + [read("a"), fail()] * 10,
    "explore_new": [read("a"), read("b")] + FILL[:8] + [read("a"), fail()] * 9 + [read("c"), ok()],
    "explore_short": [read("a")] * 4 + [read("a")] * 20,
    # error class persistence
    "persist": FILL[:10] + [edit("a"), edit("b")] + [fail(error="KeyError: %d" % (i % 2)) for i in range(4)] + FILL[:4],
    "persist_no_edit": FILL[:12] + [fail(error="KeyError: %d" % i) for i in range(4)] + FILL[:4],
    # error spiral looks at five actions at most
    "spiral": [ok()] + [fail(error="e%d" % i) for i in range(8)],
    "spiral_two": [ok(), fail(), fail()],
    "spiral_all": [fail(), fail(), fail()],
    # error blindness ignores line numbers
    "blind": FILL[:12] + [fail(error="bad at line %d" % i) for i in range(3)],
    "blind_differs": FILL[:12] + [fail(error="bad %s" % c) for c in "abc"],
    # syntax loop counts messages of successful actions, too
    "syntax": FILL[:12] + [act("Bash", error_message="SYNTAXERROR here")] * 3,
    # high error rate
    "rate": [ok()] * 4 + [fail()] * 6,
    "rate_high": [ok()] * 2 + [fail()] * 8,
    "rate_short": [fail()] * 9,
    # context rot
    "rot": [edit("a"), edit("b"), edit("c")] + [read("w%d" % i) for i in range(60)],
    "rot_again": [edit("a"), edit("b"), edit("c")] + [read("w%d" % i) for i in range(50)] + [read(x) for x in "abc"] + FILL[:7],
    "rot_only_read": [read("a"), read("b"), read("c")] + [read("w%d" % i) for i in range(60)],
    "rot_short": [edit("a"), edit("b"), edit("c")] + [read("w%d" % i) for i in range(27)],
    # context pressure
    "pressure_low": [read("a", tokens_in=100, tokens_out=50)] * 20,
    "pressure_mid": [read("a", tokens_in=900, tokens_out=100)] * 130,
    "pressure_high": [read("a", tokens_in=900, tokens_out=100)] * 160,
    "pressure_estimate": [read("a")] * 260,
}


@pytest.fixture(scope="module")
def found(spark):
    rows = detect(b.buffer(sessions(spark, CASES)), h.all_health()).collect()
    return {(r.session_id, r.signal): r for r in rows}


@pytest.mark.parametrize(
    "case, signal, severity",
    [
        ("loop_10", "loop", "high"), ("loop_tie", "loop", "medium"), ("loop_failing", "loop", "high"),
        ("reread_first", "reread", "low"), ("thrash", "thrash", "high"), ("stall", "stall", "medium"),
        ("same_outcome", "same_outcome", "medium"), ("churn", "file_churn", "medium"),
        ("explore_stuck", "exploration_stall", "high"), ("persist", "error_class_persistence", "medium"),
        ("spiral", "error_spiral", "high"), ("spiral_all", "error_spiral", "high"), ("blind", "error_blindness", "high"),
        ("syntax", "syntax_loop", "medium"), ("rate", "high_error_rate", "medium"), ("rate_high", "high_error_rate", "high"),
        ("rot", "context_rot", "medium"), ("pressure_mid", "context_pressure", "medium"),
        ("pressure_high", "context_critical", "high"), ("pressure_estimate", "context_pressure", "medium"),
    ],
)
def test_fires(found, case, signal, severity):
    assert found[case, signal].severity == severity


@pytest.mark.parametrize(
    "case, signal",
    [
        ("loop_short", "loop"), ("reread_two", "reread"), ("thrash_tail", "thrash"), ("thrash_far", "thrash"),
        ("stall_edit", "stall"), ("same_outcome_far", "same_outcome"), ("churn_reset", "file_churn"),
        ("explore_new", "exploration_stall"), ("explore_short", "exploration_stall"),
        ("persist_no_edit", "error_class_persistence"), ("spiral_two", "error_spiral"), ("blind_differs", "error_blindness"),
        ("rate_short", "high_error_rate"), ("rot_again", "context_rot"), ("rot_only_read", "context_rot"),
        ("rot_short", "context_rot"), ("pressure_low", "context_pressure"), ("pressure_low", "context_critical"),
    ],
)
def test_quiet(found, case, signal):
    assert (case, signal) not in found


def test_details(found):
    tie = found["loop_tie", "loop"]
    assert tie.details["path"] == "a" and tie.details["count"] == "4"
    failing = found["loop_failing", "loop"]
    assert failing.details["last_command"] == "make2" and failing.details["last_error"] == "E2"
    assert "keeps failing" in failing.suggestion
    assert found["reread_first", "reread"].details["path"] == "a"
    assert found["thrash", "thrash"].details["last_error"] == "E" * 120
    assert json.loads(found["stall", "stall"].details["files_being_read"]) == ["f0", "f1", "f2", "f3", "f4"]
    assert found["churn", "file_churn"].details["edit_count"] == "4"
    assert json.loads(found["churn", "file_churn"].details["other_churned_files"]) == {}
    persisting = found["persist", "error_class_persistence"].details
    assert json.loads(persisting["sample_errors"]) == ["KeyError: 0", "KeyError: 1"]
    assert json.loads(persisting["all_error_classes"]) == {"KeyError": 4}
    spiral = found["spiral", "error_spiral"].details
    assert spiral["consecutive_failures"] == "5"
    assert json.loads(spiral["recent_errors"]) == ["e7", "e6", "e5"]
    assert found["rate", "high_error_rate"].message == "High error rate: 60% of actions failing (6/10)"
    assert json.loads(found["rot", "context_rot"].details["forgotten_files"]) == ["a", "b", "c"]


def test_rediscovery(spark):
    gap = [ok(str(i)) for i in range(32)]
    cases = {
        "twice": [read("a")] + gap + [read("a")] + gap + [read("a")] + FILL[:13],
        "once": [read("a")] + gap + [read("a")] + FILL + FILL[:20],
        "close": [read("a")] * 5 + FILL + FILL,
    }
    rows = detect(b.buffer(sessions(spark, cases)), [h.rediscovery(window=80, rediscovery_gap=30)]).collect()
    assert [(r.session_id, r.details["rediscovery_count"]) for r in rows] == [("twice", "2")]
