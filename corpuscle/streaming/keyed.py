"""State by key that survives restarts (T02, T03, T06): the first row of each key, and looked-up
records with a time to live, on transformWithState.

State lives in the query's checkpoint, a row for each key, and is kept on disk by the RocksDB state
store that store() sets; every change of a micro-batch is committed with its offsets, so a batch
that is run again after a crash finds the state as it was before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuscle.functions.dates import FRESH_DAYS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def store(spark: SparkSession) -> None:
    """The state store that keyed state needs; for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _First(StatefulProcessor):
    """Lets the first row of a key pass, once."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        least = min(rows, key=lambda r: tuple(r[c] for c in self.order), default=None)
        if least is not None:
            self.seen.update((True,))
            yield least

    def close(self) -> None:
        pass


#: Rows that are reduced together, and firsts that a task holds before it lets them go.
CHUNK, HELD = 1 << 16, 1 << 18


def _local_first(keys: list[str], order: list[str]):
    """A task's first row of each key, as far as HELD of them go: of a key with very many rows few reach
    the task of its state."""

    def firsts(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in order])
        at = t.select(keys).append_column("_at", pa.array(np.arange(len(t)))).group_by(keys, use_threads=False).aggregate([("_at", "min")])
        return t.take(at["_at_min"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new = [], 0
        for b in batches:
            held.append(b)
            new += b.num_rows
            if new >= CHUNK:
                held, new = firsts(held), 0
                if sum(x.num_rows for x in held) > HELD:
                    yield from held
                    held = []
        if held:
            yield from firsts(held)

    return run


def slim(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Fewer rows of df, among them the first of each key by order."""
    return df.mapInArrow(_local_first(keys, order), df.schema)


def first_seen(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A stream of the first row of each key: of the micro-batch in which the key comes for the
    first time, the first by order (columns without nulls). Later rows of a key never pass, whatever
    their dates, and no row is too late. Null keys are one key; an empty micro-batch gives nothing.
    """
    store(stream.sparkSession)
    return slim(stream, keys, order).groupBy(*keys).transformWithState(statefulProcessor=_First(order), outputStructType=stream.schema, outputMode="Append", timeMode="None")


CACHE = "key string, event string, status string, body string, checked_at timestamp, error string"


class _Cache(StatefulProcessor):
    """The last good record of a key, and a timer for when it wants to be looked up again."""

    def __init__(self, days: dict[str, int], retry: int):
        self.days, self.retry = days, retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.good = handle.getValueState("good", "status string, body string, checked long")

    def _again_at(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(ms)

    def _row(self, key: str, event: str, error: str | None) -> tuple:
        status, body, checked = self.good.get() if self.good.exists() else (None, None, None)
        return key, event, status, body, None if checked is None else pd.Timestamp(checked, unit="ms"), error

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        all_ = pd.concat(list(rows)).sort_values(["checked_at", "status"], kind="stable")
        out = []
        for r in all_.itertuples():
            at = int(pd.Timestamp(r.checked_at).timestamp() * 1000)
            if self.good.exists() and at <= self.good.get()[2]:
                continue  # an answer older than what is held
            if r.status in self.days:
                self.good.update((r.status, r.body, at))
                self._again_at(at + self.days[r.status] * DAY_MS)
                out.append(self._row(key[0], "updated", None))
            else:
                self._again_at(at + self.retry * DAY_MS)
                out.append(self._row(key[0], "kept" if self.good.exists() else "failed", r.error or r.status or "unknown"))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame([self._row(key[0], "refresh", None)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "event", "status", "body", "checked_at", "error"])
    out["checked_at"] = pd.to_datetime(out["checked_at"])
    return out


def cached_records(answers: DataFrame, days: dict[str, int] | None = None, retry: int = 1, late: str = "0 seconds") -> DataFrame:
    """A stream of what happens to cached records, from a stream of answers (key, status, body,
    checked_at, error): `updated` by a known status other than error; `kept`, with the last good record, where an answer
    is an error, or `failed` without one; and `refresh` once a record is past its days, or a failure past
    `retry` days, of event time. Answers not newer than the record held change nothing, so a replay is
    harmless. Rows without a key or a time go."""
    store(answers.sparkSession)
    good = {k: v for k, v in (days or FRESH_DAYS).items() if k != "error"}
    rows = answers.filter("key is not null and checked_at is not null").withWatermark("checked_at", late)
    schema = T.StructType.fromDDL(CACHE)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Cache(good, retry), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def run_available(out: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream until its source is drained; its rows are appended to a Parquet table once each."""
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def held(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a stream has written so far."""
    return spark.read.schema(schema).parquet(path)
