"""Presence of agents as it happens: new, stopped, returned, reaped, told by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewarden.streaming import packed
from tracewarden.streaming.watch import ROCKSDB

EVENTS = "agent_key string, at_ms long, event string"


AGENTS = pa.schema([("agent_key", pa.string()), ("last", pa.int64()), ("gone", pa.bool_()), ("reaped", pa.bool_())])
SEEN = pa.schema([("agent_key", pa.string()), ("at_ms", pa.int64())])


class _Presence(StatefulProcessor):
    """The agents of a bucket: sightings the watermark has not reached, the last certain ones, and what became of each since.

    A moment (a sighting, the snapshot an agent is missing from, the one that reaps it) is told once the watermark has
    come to it, so the order in which sightings arrive does not matter as long as they are not late.
    """

    def __init__(self, every_ms: int, reap_ms: int):
        self.every = every_ms
        # The first snapshot at or after the stop plus the wait.
        self.reap = -(-reap_ms // every_ms) * every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")
        self.life = handle.getValueState("life", "rows binary, next long")

    def _advance(self, new: pd.DataFrame | None, now: int) -> pd.DataFrame:
        """Events of all moments up to ``now``; a timer is set for the next one of any agent."""
        blob, following = self.life.get() if self.life.exists() else (None, None)
        if new is None and (following is None or following > now):
            return pd.DataFrame([], columns=["agent_key", "at_ms", "event"])
        agents = _frame(blob, AGENTS).set_index("agent_key")
        seen = _frame(self.held.get()[0] if self.held.exists() else None, SEEN)
        if new is not None:
            last = new["agent_key"].map(agents["last"])
            seen = pd.concat([seen, new[last.isna() | (new["at_ms"] > last)]]).drop_duplicates()
        seen = seen.sort_values(["agent_key", "at_ms"], ignore_index=True)
        due, waiting = seen[seen["at_ms"] <= now], seen[seen["at_ms"] > now]
        told = []

        def tell(rows: pd.DataFrame, at: pd.Series, event: str, which: pd.Series) -> None:
            told.append(pd.DataFrame({"agent_key": rows["agent_key"][which], "at_ms": at[which].astype("int64"), "event": event}))

        # From sighting to sighting: the one before is the agent's last certain one at first.
        at, first = due["at_ms"], due["agent_key"] != due["agent_key"].shift()
        before = at.shift().where(~first, due["agent_key"].map(agents["last"])).astype("float64")
        gone = first & due["agent_key"].map(agents["gone"]).eq(True)
        reaped = first & due["agent_key"].map(agents["reaped"]).eq(True)
        stops = ~gone & (before + self.every < at)
        gone |= stops
        tell(due, at, "new", before.isna())
        tell(due, before + self.every, "stopped", stops)
        tell(due, before + self.every + self.reap, "reaped", gone & ~reaped & (before + self.every + self.reap < at))
        # Back at the very snapshot that would have reaped it: not reaped.
        tell(due, at, "returned", gone)
        # From the last sighting to now.
        newest = due.drop_duplicates("agent_key", keep="last").rename(columns={"at_ms": "last"}).assign(gone=False, reaped=False)
        agents = pd.concat([agents.drop(newest["agent_key"], errors="ignore").reset_index(), newest], ignore_index=True)
        stops = ~agents["gone"] & (agents["last"] + self.every <= now)
        agents["gone"] |= stops
        ends = agents["gone"] & ~agents["reaped"] & (agents["last"] + self.every + self.reap <= now)
        agents["reaped"] |= ends
        tell(agents, agents["last"] + self.every, "stopped", stops)
        tell(agents, agents["last"] + self.every + self.reap, "reaped", ends)
        later = (agents["last"] + self.every + self.reap * agents["gone"])[~agents["reaped"]]
        moments = [int(m.min()) for m in (waiting["at_ms"], later) if len(m)]
        self.life.update((_blob(agents, AGENTS), min(moments, default=None)))
        self.held.update((_blob(waiting, SEEN),))
        if moments:
            # Timers before the watermark fire: one millisecond less, so that a watermark at the moment suffices.
            self.handle.registerTimer(min(moments) - 1)
        return pd.concat(told, ignore_index=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat([part[["agent_key", "at_ms"]].drop_duplicates() for part in rows], ignore_index=True)
        yield self._advance(new, timer_values.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _frame(blob: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (schema.empty_table() if blob is None else packed.opened(blob, schema)).to_pandas()


def _blob(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    return packed.closed(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))


def live_presence(
    sightings: DataFrame, every_seconds: float, reap_after_seconds: float = 60.0, lateness: str = "0 seconds"
) -> DataFrame:
    """Stream of ``agent_key, taken_at, event`` over a stream of ``sightings(agent_key, taken_at)``.

    Snapshots are taken every ``every_seconds``; ``taken_at`` is the time of the snapshot. Events are those of the batch
    operator ``agents.presence`` and stand at the snapshot they happen in. An agent is missing from a snapshot once the
    watermark (the newest sighting less ``lateness``) has come to it, so agents are told apart from late rows by the
    sightings of others; rows behind the watermark are dropped by Spark. Repeated sightings count once; rows without
    key or time are left out. State per agent: one row, and its sightings that the watermark has not reached; it is kept,
    and timers are set, by buckets of agents.
    """
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = (
        sightings.select(F.col("agent_key").cast("string"), F.col("taken_at").cast("timestamp"))
        .where("agent_key is not null and taken_at is not null")
        .withWatermark("taken_at", lateness)
        .withColumn("at_ms", F.unix_millis("taken_at"))
    )
    told = rows.withColumn("bucket", packed.bucket("agent_key")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Presence(round(every_seconds * 1000), round(reap_after_seconds * 1000)),
        outputStructType=EVENTS,
        outputMode="Append",
        timeMode="EventTime",
    )
    return told.select("agent_key", F.timestamp_millis("at_ms").alias("taken_at"), "event")
