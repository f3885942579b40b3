"""Live department state by stateful operators: the newest row per hospital, the national minutes.

Both operators take a stream of department rows (one per hospital and minute, in any order, perhaps more
than once) and keep their state in RocksDB. Event-time timers bound it: a hospital that is silent for
longer than `idle` minutes is forgotten, and told so once; a minute is closed `lateness` minutes after it,
rows that come later are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.dedup import keep_latest
from .department import SUMS

STATE = T.StructType([
    T.StructField("minute_ts", T.TimestampType()), T.StructField("hospital_id", T.StringType()),
    *[T.StructField(c, T.LongType()) for c in SUMS], T.StructField("occupancy_pct", T.DoubleType()),
])
NEWEST = T.StructType([*STATE.fields, T.StructField("is_live", T.BooleanType())])
MINUTE = T.StructType([
    T.StructField("minute_ts", T.TimestampType()), T.StructField("hospitals", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in SUMS], T.StructField("occupancy_pct", T.DoubleType()),
    T.StructField("is_closed", T.BooleanType()),
])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VALUES = (*SUMS, "occupancy_pct")
_MINUTE_MS = 60_000


def _in_ms(schema: T.StructType) -> T.StructType:
    """The schema with the minute as milliseconds, which mean the same in every time zone."""
    return T.StructType([T.StructField("minute_ms", T.LongType()) if f.name == "minute_ts" else f for f in schema.fields])


_NEWEST_MS, _MINUTE_SUMS_MS = _in_ms(NEWEST), _in_ms(MINUTE)
_NEWEST, _MINUTE = Row(*_NEWEST_MS.names), Row(*_MINUTE_SUMS_MS.names)


def _rank(values: tuple) -> tuple:
    """Orders rows of one minute, so that a redelivery in another order leaves the same one."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


class NewestState(StatefulProcessor):
    """Newest row of one hospital; of several rows of its minute the greatest."""

    def __init__(self, idle: int):
        self.idle_ms = idle * _MINUTE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", T.StructType([f for f in _in_ms(STATE).fields if f.name != "hospital_id"]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for row in rows:
            now = (row["minute_ms"], *[row[c] for c in _VALUES])
            if best is None or (now[0], _rank(now[1:])) > (best[0], _rank(best[1:])):
                best = now
        if best is not None and best != before:
            self.newest.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[0] + self.idle_ms)
            yield _NEWEST(best[0], key[0], *best[1:], True)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = tuple(self.newest.get()) if self.newest.exists() else None
        self.newest.clear()
        if last is not None:
            yield _NEWEST(last[0], key[0], *last[1:], False)

    def close(self) -> None:
        pass


class NationalMinute(StatefulProcessor):
    """Sums over the hospitals of one minute; a hospital's later row replaces its earlier one."""

    def __init__(self, lateness: int):
        self.lateness_ms = lateness * _MINUTE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = T.StructType([f for f in STATE.fields if f.name in _VALUES])
        self.rows = handle.getMapState("rows", T.StructType([T.StructField("hospital_id", T.StringType())]), value)

    def _sums(self, minute, closed: bool) -> Row:
        held = [tuple(v) for _, v in self.rows.iterator()]
        sums = [sum(v[i] or 0 for v in held) for i in range(len(SUMS))]
        known = [v[-1] for v in held if v[-1] is not None]
        return _MINUTE(minute, len(held), *sums, sum(known) / len(known) if known else None, closed)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changed = False
        for row in rows:
            hospital, now = (row["hospital_id"],), tuple(row[c] for c in _VALUES)
            before = tuple(self.rows.getValue(hospital)) if self.rows.containsKey(hospital) else None
            if before is None or _rank(now) > _rank(before):
                self.rows.updateValue(hospital, now)
                changed = True
        if changed:
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(key[0] + self.lateness_ms)
            yield self._sums(key[0], False)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._sums(key[0], True)
        self.rows.clear()

    def close(self) -> None:
        pass


def _timed(states: DataFrame, lateness: int) -> DataFrame:
    known = states.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE.fields])
    known = known.dropna(subset=["minute_ts", "hospital_id"]).withColumn("minute_ms", F.unix_millis("minute_ts"))
    return known.withWatermark("minute_ts", f"{lateness} minutes")


def _told(changes: DataFrame, schema: T.StructType) -> DataFrame:
    return changes.withColumn("minute_ts", F.timestamp_millis("minute_ms")).select(*schema.names)


def _use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def newest_states(states: DataFrame, idle: int = 180, lateness: int = 60) -> DataFrame:
    """Stream of changes of each hospital's newest row; is_live is false once it has been silent too long."""
    _use_rocksdb(states.sparkSession)
    changes = _timed(states, lateness).groupBy("hospital_id").transformWithState(
        NewestState(idle), _NEWEST_MS, "Update", "EventTime"
    )
    return _told(changes, NEWEST)


def national_minutes(states: DataFrame, lateness: int = 60) -> DataFrame:
    """Stream of changes of each minute's national sums; is_closed is true on its last one."""
    _use_rocksdb(states.sparkSession)
    changes = _timed(states, lateness).groupBy("minute_ms").transformWithState(
        NationalMinute(lateness), _MINUTE_SUMS_MS, "Update", "EventTime"
    )
    return _told(changes, MINUTE)


def start_live(changes: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the changes as a log, one folder per micro-batch; a replayed batch replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_live(spark: SparkSession, table: str, schema: T.StructType, key: str) -> DataFrame:
    """The newest version of each key: what the stream holds now."""
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(table)
    return keep_latest(log, [key], ["batch_id"]).drop("batch_id")
