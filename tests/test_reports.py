"""Registry, reports, functions."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import act, edit, fail, ok, read, sessions
from tracewarden.functions import classify as c, fixed_values as fv, status, text
from tracewarden.operators import buffer as b, registry as r, score
from tracewarden.plans import reports

CASES = {
    "bad": [fail("make", "TypeError: x at line %d" % i) for i in range(20)],
    "hacked": [ok("ls")] * 5 + [ok("sudo rm -rf /")],
    "fine": [ok("ls %d" % i) for i in range(8)],
}


@pytest.fixture(scope="module")
def actions(spark):
    return sessions(spark, CASES)


def test_registry_modes():
    assert len(r.create_registry("health").detectors) == 15
    assert len(r.create_registry("security").detectors) == 19
    assert len(r.create_registry("all").detectors) == 34
    with pytest.raises(ValueError):
        r.create_registry("other")


def test_catalog_and_changes(spark):
    registry = r.create_registry("all")
    assert registry.catalog(spark).where("is_security").count() == 19
    assert registry.remove("loop") and not registry.remove("loop") and registry.get("loop") is None
    assert registry.by_category()["errors"][0].startswith("error_class_persistence: ")
    with pytest.raises(ValueError):
        registry.add(registry.get("stall"))


def test_custom_detector(actions):
    def check(buffered, keys):
        def one(pdf):
            return pdf[keys].head(1).assign(
                category="goal", severity="critical", signal="odd", message="%d actions" % len(pdf), suggestion=None)

        found = buffered.groupBy(*keys).applyInPandas(
            one, "session_id string, category string, severity string, signal string, message string, suggestion string")
        return found.withColumn("details", F.create_map().cast("map<string,string>"))

    registry = r.create_registry("health", [r.FrameDetector("odd", "goal", "always", check)])
    rows = registry.check_all(b.buffer(actions)).where("session_id = 'bad'").orderBy("rank").collect()
    assert [x.detector for x in rows][:2] == ["odd", "loop"]
    assert rows[0].message == "20 actions"
    order = [(x.severity_ord, x.detector_ord) for x in rows]
    assert order == sorted(order) and len(order) == len(set(order))


def test_reports(actions):
    health = {x.session_id: x for x in reports.check(actions, security=True).collect()}
    assert health["fine"].overall_score == 100 and health["fine"].exit_code == 0
    assert health["bad"].categories["errors"].score < 60 and health["bad"].overall_score < 100
    assert health["bad"].health_warning_count == len(health["bad"].warnings)
    security = {x.session_id: x for x in reports.security_scan(actions).collect()}
    assert (security["hacked"].security_score, security["hacked"].status, security["hacked"].exit_code) == (0, "compromised", 2)
    assert (security["fine"].security_score, security["fine"].status, security["fine"].exit_code) == (100, "secure", 0)
    text_rows = reports.report_json(reports.check(actions)).collect()
    parsed = {x.session_id: json.loads(x.report) for x in text_rows}
    assert parsed["fine"]["status"] == "productive" and parsed["bad"]["warnings"][0]["signal"] == "loop"


def test_audit(actions):
    rows = r.create_registry("security").audit(b.buffer(actions)).collect()
    assert len(rows) == 3 * 19
    hit = {(x.session_id, x.detector) for x in rows if x.triggered}
    assert ("hacked", "privilege_escalation") in hit and ("fine", "privilege_escalation") not in hit


def test_blended_report(actions):
    rows = {x.session_id: x for x in reports.session_health(actions).collect()}
    for x in rows.values():
        expected = int(x.detector_score * 0.4 + x.efficiency_score * 0.3 + int((1 - x.rot_score) * 100) * 0.3)
        assert x.overall_score == max(0, min(100, expected))


def test_security_gate_at_fifty(spark):
    rows = spark.createDataFrame([(100,), (99,), (51,), (50,), (49,)], "s int").select(
        score.security_status(F.col("s")).alias("status"), score.security_gate(F.col("s")).alias("code")).collect()
    assert [tuple(x) for x in rows] == [
        ("secure", 0), ("at_risk", 1), ("at_risk", 1), ("compromised", 1), ("compromised", 2)]


def test_status_and_themes(spark):
    df = spark.createDataFrame([(100,), (80,), (79,), (60,), (59,), (40,), (39,)], "overall_score int")
    labels = [x[0] for x in df.select(status.status_label(F.col("overall_score"))).collect()]
    assert labels == ["productive", "productive", "struggling", "struggling", "spinning", "spinning", "stuck"]
    assert status.with_all_themes(df).count() == 7 * len(fv.THEMES)
    with pytest.raises(ValueError):
        status.status_label(F.col("overall_score"), "none")
    bars = spark.range(1).select(status.score_bar(F.lit(57)).alias("a"), status.mini_bar(F.lit(0.25)).alias("b")).first()
    assert bars.a == "█" * 11 + "░" * 9 and bars.b == "██" + "░" * 8


def test_functions(spark):
    names = {"str_replace_editor": "edit", "create_file": "write", "mcp__cat_x": "read", "Bash": "bash", "Glob": "search",
             "LS": "list", "WebFetch": "browser", "mcp_tool": "mcp", "Task": "unknown"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {x.n: x.t for x in df.select("n", c.classify_tool(F.col("n")).alias("t")).collect()} == names
    row = spark.range(1).select(
        c.flatten_nested(F.expr("array(array(array(1, 2)), array(array(3)))"), 2).alias("flat"),
        c.project_name(F.lit("/a/b/")).alias("project"),
        c.error_signature(F.lit(" Line 12 at 0xff in /x/y.py took 300 ")).alias("signature"),
        c.normalize_error(F.lit("File /a/b-c.py:10:22 line 7 ")).alias("normal"),
        c.classify_error(F.lit("connection timed out")).alias("kind"),
        text.repeated_share(text.trigrams(text.content_words(F.lit("a b foo bar baz foo bar baz")))).alias("share"),
        text.sentences(F.lit("Short. This one is long enough to count! \n tiny")).alias("sentences"),
        text.hedge_count(F.lit("Maybe maybes could-be COULD")).alias("hedges"),
        text.apology_density(F.lit("I'm sorry, my mistake")).alias("sorry"),
    ).first()
    assert row.flat == [1, 2, 3] and row.project == "b"
    assert row.signature == "<X> at <X> in <X> took <X>"
    assert row.normal == "File FILE.py:N:N line N" and row.kind == "TimeoutError"
    assert row.share == 0.25
    assert row.sentences == ["this one is long enough to count!"]
    assert row.hedges == 3 and row.sorry == 1.0
