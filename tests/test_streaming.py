"""Streams give what the batch operators give."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import agents as ag, buffer as b, rot
from tracewarden.plans import reports
from tracewarden.sources import jsonl, tables
from tracewarden.streaming import dialects, presence, watch as w

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def land(df, folder, parts, order="seq"):
    """Write ``df`` as ``parts`` files that a stream picks up one per batch, in order."""
    edges = [df.agg(F.expr(f"percentile({order}, {i / parts})")).first()[0] for i in range(parts)] + [None]
    for i in range(parts):
        piece = df.where(F.col(order) >= edges[i]) if i else df
        piece = piece.where(F.col(order) < edges[i + 1]) if edges[i + 1] is not None else piece
        piece.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 1_600_000_000 + parts:
                os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))


def stream_of(spark, df, folder, parts, order="seq"):
    land(df, folder, parts, order)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_actions(spark):
    return tables.event_actions(spark, DATA).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_watch_equals_batch(spark, folder):
    actions = event_actions(spark).withColumn("session_id", F.when(F.col("session_id") != "u3", F.col("session_id")))
    stream = stream_of(spark, actions, folder + "/in", 4)
    run(w.watch(stream, folder + "/reports", folder + "/checkpoint", max_size=40, remember_skills=False))
    ticks = spark.read.parquet(folder + "/reports")
    assert ticks.select("tick").distinct().count() == 4
    columns = ["overall_score", "detector_score", "efficiency_score", "raw_score"]
    latest = ticks.groupBy("session_id").agg(F.max_by(F.struct(*columns), "tick").alias("r")).select("session_id", "r.*")
    batch = reports.session_health(actions, include_security=True, max_size=40).withColumnRenamed("rot_score", "raw_score")
    got = {r.session_id: tuple(r[1:]) for r in latest.collect()}
    expected = {r.session_id: tuple(r[1:]) for r in batch.select("session_id", *columns).collect()}
    assert got.keys() == expected.keys()
    for session, values in expected.items():
        assert got[session] == pytest.approx(values, abs=1e-9)
    live = w.live_reports(spark, folder + "/reports").writeStream.format("parquet").option("path", folder + "/live")
    run(live.option("checkpointLocation", folder + "/live-checkpoint"))
    found = {(r.session_id, r.tick): r for r in spark.read.parquet(folder + "/live").collect()}
    smoothed = {}
    rows = sorted(ticks.collect(), key=lambda r: r.tick)
    assert len(found) == len(rows) and None in {r.session_id for r in rows}
    for r in rows:
        before = smoothed.get(r.session_id)
        s = smoothed[r.session_id] = r.raw_exact if before is None else rot.ALPHA * r.raw_exact + (1 - rot.ALPHA) * before
        mixed = 0.4 * r.detector_score + 0.3 * r.efficiency_score + 0.3 * int((1.0 - round(s, 4)) * 100)
        assert found[r.session_id, r.tick].smoothed_score == round(s, 4)
        assert abs(found[r.session_id, r.tick].overall_score - mixed) <= 1 and found[r.session_id, r.tick].overall_score <= mixed + 1e-9


def test_ingest_of_landed_segments(spark, folder):
    segments = {"a-1": [{"sessionId": "s", "tool": "read", "file": "f%d" % i} for i in range(5)],
                "a-2": [{"sessionId": "s", "tool": "bash", "command": "c%d" % i} for i in range(5)]}
    os.makedirs(folder + "/in")
    for i, (name, lines) in enumerate(segments.items()):
        path = f"{folder}/in/{name}.jsonl"
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    run(w.ingest(w.log_segments(spark, folder + "/in", max_files=1), folder + "/actions", folder + "/checkpoint", 1))
    rows = spark.read.parquet(folder + "/actions").orderBy("seq", "sub").collect()
    assert [r.file_path or r.command for r in rows] == ["f%d" % i for i in range(5)] + ["c%d" % i for i in range(5)]


def test_smoothing(spark, folder):
    actions = event_actions(spark)
    ticks = b.numbered(actions).where("idx <= 12").select(
        "session_id", F.col("idx").cast("bigint").alias("tick"), (F.col("tokens_in") % 100 / 100.0).alias("raw_score"),
        F.lit(0.0).alias("constraint"), F.lit(0.0).alias("thrash"),
    )
    stream = stream_of(spark, ticks, folder + "/in", 2, "tick")
    run(w.smooth_stream(stream).writeStream.format("parquet").option("path", folder + "/out")
        .option("checkpointLocation", folder + "/checkpoint"))
    got = {(r.session_id, r.tick): (r.smoothed_score, r.state) for r in spark.read.parquet(folder + "/out").collect()}
    batch = rot.smooth(ticks.withColumnRenamed("tick", "snapshot_id")).collect()
    assert len(got) == len(batch)
    for r in batch:
        assert got[r.session_id, r.snapshot_id][0] == pytest.approx(r.smoothed_score, abs=1e-12)
        assert got[r.session_id, r.snapshot_id][1] == r.state


def test_new_skills(spark, folder):
    actions = event_actions(spark)
    stream = stream_of(spark, actions, folder + "/in", 2)
    run(w.new_skills(stream).writeStream.format("parquet").option("path", folder + "/out")
        .option("checkpointLocation", folder + "/checkpoint"))
    got = spark.read.parquet(folder + "/out").select("session_id", "skill_name")
    expected = actions.where("skill_name is not null").select("session_id", "skill_name").distinct()
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0


def test_live_spans(spark, folder):
    rows = [("a", 0), ("a", 30), ("a", 85), ("a", 300), ("b", 10), ("z", 1000)]
    df = spark.createDataFrame(rows, "agent_key string, s int").select(
        "agent_key", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("taken_at"))
    df.coalesce(1).write.parquet(folder + "/in")
    stream = spark.readStream.schema(df.schema).parquet(folder + "/in")
    run(w.live_spans(stream).writeStream.format("parquet").option("path", folder + "/out")
        .option("checkpointLocation", folder + "/checkpoint"))
    got = spark.read.parquet(folder + "/out").select(
        "agent_key", (F.unix_timestamp("seen_from") - 1_700_000_000).alias("a"),
        (F.unix_timestamp("expired_at") - 1_700_000_000).alias("z"), "sightings").collect()
    # "z" is still alive when the stream ends.
    assert sorted(tuple(r) for r in got) == [("a", 0, 145, 3), ("a", 300, 360, 1), ("b", 10, 70, 1)]


def test_each_action_survives_errors(spark, folder):
    marker = tempfile.mkdtemp(prefix="seen-")

    def callback(row):
        open(f"{marker}/{row.session_id}-{row.seq}-{row.sub}", "w").close()
        raise ValueError("ignored")

    actions = event_actions(spark).where("session_id = 'u1'")
    stream = stream_of(spark, actions, folder + "/in", 1)
    run(w.each_action(stream, callback, folder + "/checkpoint"))
    assert len(os.listdir(marker)) == actions.count()


def test_dialects_wait_for_missing_segments(spark, folder):
    """Segments land late; metadata decides nothing; beyond ``hold`` lines what is there decides."""
    skip, role, flat = '{"type":"summary"}', '{"role":"user","content":"hi"}', '{"tool":"read","file":"f"}'
    lands = [
        [("late", 1, [flat, flat]), ("full", 1, [flat] * 4), ("plain", 0, [skip, "no json", flat, role])],
        [("late", 2, [role]), ("plain", 1, [skip, role])],
        [("late", 0, [skip, role, skip]), ("full", 0, [role])],
        [("late", 3, [flat]), ("full", 2, [role])],
    ]
    schema = "log string, segment long, seq long, value string"
    got = []
    for land_now in lands:
        rows = [(log, segment, i, line) for log, segment, lines in land_now for i, line in enumerate(lines)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(schema).parquet(folder + "/in")
        run(dialects.locked_lines(stream, hold=3).writeStream.format("parquet").option("path", folder + "/out")
            .option("checkpointLocation", folder + "/checkpoint"))
        got.append(sorted((r.log, r.segment, r.seq, r.dialect) for r in spark.read.parquet(folder + "/out").collect()))
    full = [("full", 1, i, "unknown") for i in range(4)]
    plain = [("plain", 0, 2, "unknown"), ("plain", 0, 3, "unknown")]
    assert got[0] == full + plain
    assert got[1] == full + plain + [("plain", 1, 0, "unknown"), ("plain", 1, 1, "unknown")]
    late = [("late", 0, 1, "role"), ("late", 0, 2, "role"), ("late", 1, 0, "role"), ("late", 1, 1, "role"), ("late", 2, 0, "role")]
    assert [r for r in got[2] if r[0] == "late"] == late and [r for r in got[2] if r[0] == "full"] == full
    assert [r for r in got[3] if r[0] == "late"] == [*late, ("late", 3, 0, "role")]
    assert [r for r in got[3] if r[0] == "full"] == [*full, ("full", 2, 0, "unknown")]


def test_logs_are_named_by_their_segments(spark, folder):
    os.makedirs(folder + "/in")
    for i, lines in enumerate(['{"type":"summary"}\n', '{"sessionId":"s","tool":"read","file":"a"}\n', '{"sessionId":"s","tool":"read","file":"b"}\n']):
        with open(f"{folder}/in/one-{i}.jsonl", "w") as f:
            f.write(lines)
        stream = dialects.log_actions(dialects.numbered_lines(spark, folder + "/in"))
        run(stream.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/checkpoint"))
    rows = spark.read.parquet(folder + "/out").orderBy("seq").collect()
    assert [r.file_path for r in rows] == ["a", "b"] and len({r.source_file for r in rows}) == 1


def test_a_skill_warns_once(spark, folder):
    """One skill a tick, in order of use; known ones never again."""
    used = [["a", "b"], ["b"], ["a", "c"], ["c", "b"], []]
    rows = [(t, "s", 100 * t + i, skill) for t, skills in enumerate(used) for i, skill in enumerate([*skills, None])]
    actions = event_actions(spark)
    blank = actions.where("session_id = 'u1'").limit(1).drop("session_id", "seq", "skill_name")
    every = spark.createDataFrame(rows, "t int, session_id string, seq bigint, skill_name string").crossJoin(blank).select("t", *actions.columns)
    for t in range(len(used)):
        every.where(f"t = {t}").drop("t").coalesce(1).write.mode("append").parquet(folder + "/in")
        run(w.watch(spark.readStream.schema(actions.schema).parquet(folder + "/in"), folder + "/reports", folder + "/checkpoint"))
    found = spark.read.parquet(folder + "/reports").select("tick", F.explode("warnings").alias("x")).where("x.signal = 'new_skill'")
    assert sorted((r.tick, r.x.details["skill"]) for r in found.collect()) == [(0, "a"), (1, "b"), (2, "c")]


@pytest.mark.parametrize("parts, late", [(1, 0), (6, 0), (4, 75)])
def test_live_presence_equals_batch(spark, folder, parts, late):
    """Snapshots every 25 s; with ``late``, sightings arrive up to three snapshots after newer ones."""
    seen = {"a": [0, 1, 2, 5, 6, 20], "b": [0, 1, 9, 10], "c": [8, 9, 30], "d": [3, 7, 11, 12, 29], "e": list(range(31)), "f": [5, 9]}
    rows = [(key, n, n + (n * 7 + ord(key)) % 3 if late else n) for key, numbers in seen.items() for n in numbers]
    rows += rows[:5] + [(None, 4, 4)]
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 25)
    df = spark.createDataFrame(rows, "agent_key string, n long, arrives long").withColumn("taken_at", at)
    stream = stream_of(spark, df, folder + "/in", parts, "arrives")
    told = presence.live_presence(stream, 25.0, 60.0, f"{late} seconds")
    run(told.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state"))
    # The watermark stays behind by the lateness: later moments are not told yet.
    last = 30 - late // 25
    snapshots = spark.range(31).select(F.col("id").alias("snapshot_no"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 25).alias("taken_at"))
    sightings = df.where("agent_key is not null").select("agent_key", F.col("n").alias("snapshot_no"))
    expected = ag.presence(sightings, snapshots, 60.0).where(F.col("snapshot_no") <= last)
    got = spark.read.parquet(folder + "/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select("agent_key", "taken_at", "event").collect()))
