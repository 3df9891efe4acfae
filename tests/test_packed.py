"""State by buckets of keys: rows travel packed, and a bucket's keys stay apart."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tracewarden.plans import queries
from tracewarden.streaming import dialects, packed, presence, watch


class State:
    """What a processor sees of map and value state."""

    def __init__(self):
        self.map, self.value = {}, None

    def getValue(self, key):
        return self.map.get(key)

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getMapState(self, *_):
        return State()

    def getValueState(self, *_):
        return State()

    def registerTimer(self, _):
        pass


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def started(processor):
    processor.init(Handle())
    return processor


def told(processor, table, now=None):
    parts = [pd.DataFrame({"bucket": [0] * table.num_rows, "rows": [packed.closed(table.slice(i, 1)) for i in range(table.num_rows)]})]
    frames = [f for f in processor.handleInputRows((0,), iter(parts), now) if len(f)]
    return pd.concat(frames).astype(object).where(lambda f: f.notna(), None).to_dict("records") if frames else []


def test_rows_come_back_whole(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"), F.lit(None).cast("int").alias("none"))
    rows = packed.packed(df, "k")
    assert rows.groupBy("bucket").count().count() <= packed.BUCKETS
    got = [r for p in rows.collect() for t in packed.unpacked([pd.DataFrame([p], columns=rows.columns)], packed.schema_of(df)) for r in t.to_pylist()]
    assert sorted((r["k"], r["n"], r["none"]) for r in got) == sorted((str(i), i if i % 3 else None, None) for i in range(5000))


def test_sessions_of_a_bucket_keep_their_own_buffers():
    schema = pa.schema([(n, pa.int64()) for n in ("seq", "sub", "timestamp", "tokens_in", "tokens_out", "cache_creation_tokens", "cache_read_tokens")]
                       + [("session_key", pa.string()), ("skill_name", pa.string()), ("error_message", pa.string()), ("success", pa.bool_()), ("cost_usd", pa.float64())])
    processor = started(watch._RollingBuffer(2, schema))

    def rows(*found):
        return pa.Table.from_pylist([{"session_key": k, "seq": q, "sub": 0, "timestamp": t, "tokens_in": 1, "skill_name": s, "success": q != 7, "error_message": "no"} for k, q, t, s in found], schema)

    def seen(*found):
        return [(r["seq"], r["action_count"], r["total_input_tokens"], r["error_count"], r["start_time"], r["last_time"], r["fresh_skill"]) for r in told(processor, rows(*found))]

    assert seen(("b", 5, 50, "x"), ("a", 3, None, None), ("a", 2, 20, "x"), ("a", 1, 30, None)) == [
        (2, 3, 3, 0, 30, 30, "x"), (3, 3, 3, 0, 30, 30, "x"), (5, 1, 1, 0, 50, 50, "x")]
    # A late row counts and is not kept; one without place is the last; only touched sessions are told.
    assert seen(("a", 0, 10, "y"), ("a", None, 90, None)) == [(3, 5, 5, 0, 30, 90, None), (None, 5, 5, 0, 30, 90, None)]
    assert seen(("b", 7, 10, "y"), ("b", 6, None, "x")) == [(6, 3, 3, 1, 50, 50, "y"), (7, 3, 3, 1, 50, 50, "y")]


def test_logs_of_a_bucket_are_locked_apart():
    schema = pa.schema([("log", pa.string()), ("segment", pa.int64()), ("seq", pa.int64()), ("value", pa.string()), ("code", pa.int32())])
    processor = started(dialects._DialectLock(2, schema))

    def seen(*found):
        return sorted((r["log"], r["segment"], r["seq"]) for r in told(processor, pa.Table.from_pylist([dict(zip(schema.names, (log, a, b, "v", code))) for log, a, b, code in found], schema)))

    assert seen(("a", 0, 0, 0), ("a", 1, 0, 1), ("a", 1, 1, 0), ("b", 1, 0, 2), ("c", 2, 0, 1), ("c", 2, 1, 1), ("c", 1, 0, 0)) == [
        ("a", 1, 0), ("a", 1, 1), ("c", 2, 0), ("c", 2, 1)]
    assert seen(("a", 0, 1, 1), ("a", 2, 0, 0), ("c", 3, 0, 0)) == [("a", 2, 0), ("c", 3, 0)]
    assert seen(("b", 0, 0, 0), ("b", 0, 1, 3)) == [("b", 0, 1), ("b", 1, 0)]


def test_agents_of_a_bucket_are_told_apart():
    processor = started(presence._Presence(10, 15))

    def seen(found, now):
        frames = processor.handleInputRows((0,), iter([pd.DataFrame(found, columns=["agent_key", "at_ms"])]), Now(now))
        return sorted(tuple(r) for f in frames for r in f.itertuples(index=False))

    assert seen([("a", 0), ("a", 10), ("b", 0), ("a", 0), ("c", 90)], 30) == [
        ("a", 0, "new"), ("a", 20, "stopped"), ("b", 0, "new"), ("b", 10, "stopped"), ("b", 30, "reaped")]
    assert seen([("a", 40), ("b", 60)], 70) == [
        ("a", 40, "returned"), ("a", 50, "stopped"), ("a", 70, "reaped"), ("b", 60, "returned"), ("b", 70, "stopped")]
    last = processor.handleExpiredTimer((0,), Now(100), None)
    assert sorted(tuple(r) for f in last for r in f.itertuples(index=False)) == [("b", 90, "reaped"), ("c", 90, "new"), ("c", 100, "stopped")]


def test_rows_land_once_and_leave_the_settings(spark):
    before, places = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        df = spark.range(9).withColumn("step", F.col("id") % 3)
        counted = spark.sparkContext.accumulator(0)

        def start(stream, place):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= spark.sparkContext.defaultParallelism
            stream.writeStream.foreachBatch(lambda b, i: places.append(sorted(r.id for r in b.collect()))).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()

        watched = df.rdd.map(lambda r: (counted.add(1), r)[1]).toDF("id long, step long")
        queries._landed(watched, [2, 0, 1], start)
        assert places == [[2, 5, 8], [0, 3, 6], [1, 4, 7]] and counted.value == 9
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
