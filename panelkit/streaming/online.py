"""Online scoring: stateless record streams, and streams of hourly measurements.

The stateful operator keeps, per entity, the last known value of every channel with its order
key, and the first positive order key: the streaming form of ``panel.patient_vector``. Late rows
are merged by order key within ``lateness``; beyond it a superseded value is forgotten. State is
typed and split by channel, so a batch rewrites what it measures and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelkit.functions import clinical
from panelkit.plans.model import RecordModel
from panelkit.sources import records

def score_stream(stream: DataFrame, model: RecordModel, keep: Sequence[str] = (),
                 body: str = "value") -> DataFrame:
    """Score JSON records, in a stream or a batch: the same plan serves both."""
    return model.score_records(records.from_json(stream, body), keep)


class CurrentVector(StatefulProcessor):
    """Last known values of an entity, each channel in a map state of its own: order key to value.

    A batch rewrites only the channels that it measures; a positive row earlier than what is known also cuts the
    others. Values that a newer one from before the horizon supersedes are removed when their channel is next touched.
    """

    def __init__(self, entity: str, order: str, channels: Sequence[str], label: str, lateness: float,
                 event_time: str | None, ttl_ms: int | None):
        self.entity, self.order, self.channels, self.label = entity, order, list(channels), label
        self.lateness, self.event_time, self.ttl_ms = lateness, event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        at, value = T.StructType().add("at", "double"), T.StructType().add("value", "double")
        course = T.StructType().add("boundary", "double").add("latest", "double").add("leaves", "long")
        self.course = handle.getValueState("course", course, self.ttl_ms)
        self.seen = [handle.getMapState(f"seen_{i}", at, value, self.ttl_ms) for i in range(len(self.channels))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        boundary, latest, leaves = self.course.get() if self.course.exists() else (None, None, None)
        before, fresh, left = boundary, [{} for _ in self.channels], leaves
        for pdf in rows:
            if self.event_time:
                times = pdf[self.event_time].dropna()
                if len(times):
                    last = int(times.max().timestamp() * 1000)
                    leaves = last if leaves is None else max(leaves, last)
            for row in pdf[[self.order, self.label, *self.channels]].itertuples(index=False):
                at = float(row[0])
                if pd.isna(at) or (latest is not None and at < latest - self.lateness):
                    continue
                latest = at if latest is None else max(latest, at)
                if row[1] == 1 and (boundary is None or at < boundary):
                    boundary = at
                for own, value in zip(fresh, row[2:]):
                    if not pd.isna(value):
                        own[at] = float(value)
        if latest is None:
            return
        end = latest if boundary is None else boundary
        horizon, cut = min(end, latest - self.lateness), boundary != before
        values = []
        for state, own in zip(self.seen, fresh):
            known = {at: value for (at,), (value,) in state.iterator()}
            merged = {at: value for at, value in {**known, **own}.items() if at <= end}
            if own or cut:
                # The newest value from before the horizon still counts, those before it never will again.
                first = max((at for at in merged if at <= horizon), default=float("-inf"))
                merged = {at: value for at, value in merged.items() if at >= first}
                for at in known.keys() - merged.keys():
                    state.removeKey((at,))
                for at, value in merged.items():
                    if known.get(at) != value:
                        state.updateValue((at,), (value,))
            values.append(merged[max(merged)] if merged else None)
        self.course.update((boundary, latest, leaves))
        if leaves != left:
            if left is not None:
                self.handle.deleteTimer(left)
            self.handle.registerTimer(leaves)
        yield pd.DataFrame({self.entity: [key[0]], "as_of": [end], **{c: [v] for c, v in zip(self.channels, values)},
                            self.label: [int(boundary is not None)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the stay's last row: all of its state goes."""
        self.course.clear()
        for state in self.seen:
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def current_vectors(stream: DataFrame, entity: str, order: str, channels: Sequence[str], label: str,
                    lateness: float = 24.0, expire_ms: int | None = None, sirs: bool = True,
                    event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Current vector and label of each entity touched by a micro-batch (update mode).

    Rows arrive in any order; an entity's features freeze at its first positive row. With ``event_time``, a timestamp
    column, rows more than ``delay`` behind the newest are late and dropped, and a stay's state goes once the
    watermark has passed its last row. Without it ``expire_ms`` gives what a silent entity has kept a time to live.
    Needs RocksDB as the state store, which is set here; the session has to keep it while the query runs.
    """
    if event_time and expire_ms:
        raise ValueError("either event_time or expire_ms")
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    schema = T.StructType(
        [stream.schema[entity], T.StructField("as_of", T.DoubleType())]
        + [T.StructField(c, T.DoubleType()) for c in channels] + [T.StructField(label, T.IntegerType())])
    rows = stream.withWatermark(event_time, delay) if event_time else stream
    rows = rows.select(entity, F.col(order).cast("double").alias(order), label,
                       *[F.col(c).cast("double").alias(c) for c in channels], *([event_time] if event_time else []))
    processor = CurrentVector(entity, order, channels, label, lateness, event_time, expire_ms)
    vectors = rows.groupBy(entity).transformWithStateInPandas(
        processor, schema, "update", "eventTime" if event_time else "processingTime" if expire_ms else "none")
    return clinical.with_sirs(vectors) if sirs else vectors


def drop_repeats(stream: DataFrame, event_time: str, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Drop rows delivered twice, with state bounded by a watermark on the event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
