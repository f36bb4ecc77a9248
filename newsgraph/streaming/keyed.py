"""State by key on the state store: values, lists and timers of ``transformWithState``, without an action inside a batch.

Every operator keeps a bounded state a key and forgets a key by a timer in event time.  Progress, state and timers lie in
the checkpoint of the query, so a job that is started again goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _millis(rows: pd.DataFrame) -> int:
    return int(rows["ts"].max().timestamp() * 1000)


def _plain(value):
    """None for what pandas has for it, and Python's own kinds."""
    if value is None or pd.isna(value):
        return None
    return value.item() if hasattr(value, "item") else value


class Expiring(StatefulProcessor):
    """A value a key, and one timer that clears it a number of days after the key's last row."""

    def __init__(self, key: str, kind: str, days: int):
        self.key, self.kind, self.days = key, kind, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.kind}, last_ms bigint")

    def held(self) -> tuple | None:
        return tuple(self.value.get())[:-1] if self.value.exists() else None

    def store(self, value: tuple, seen_ms: int, timers) -> None:
        last = self.value.get()[-1] if self.value.exists() else None
        newest = seen_ms if last is None else max(last, seen_ms)
        if newest != last:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            # a time at or before the watermark would not fire: such a key goes with the next batch
            self.handle.registerTimer(max(newest + self.days * DAY_MS, timers.getCurrentWatermarkInMs() + 1))
        self.value.update((*value, newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class Maxima(Expiring):
    def __init__(self, key: str, kind: str, days: int, names: list[str]):
        super().__init__(key, kind, days)
        self.names = names

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, seen = self.held(), 0
        for batch in rows:
            seen = max(seen, _millis(batch))
            tops = [_plain(batch[n].max()) for n in self.names]
            now = tuple(tops) if now is None else tuple(b if a is None else a if b is None else max(a, b) for a, b in zip(now, tops))
        self.store(now, seen, timerValues)
        yield pd.DataFrame([[*key, *now]], columns=[self.key, *self.names])


class Newest(Expiring):
    """The value of the newest row by (ts, event_id)."""

    def __init__(self, key: str, kind: str, days: int, name: str):
        super().__init__(key, kind, days)
        self.name = name

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, seen = self.held(), 0
        for batch in rows:
            seen = max(seen, _millis(batch))
            row = batch.sort_values(["stored_us", "stored_id"]).iloc[-1]
            new = (_plain(row[self.name]), int(row["stored_us"]), int(row["stored_id"]))
            now = new if now is None or new[1:] > now[1:] else now
        self.store(now, seen, timerValues)
        yield pd.DataFrame([[*key, *now]], columns=[self.key, self.name, "stored_us", "stored_id"])


class Once(StatefulProcessor):
    """The first row of a key passes; the next one passes a number of days after it at the earliest."""

    def __init__(self, columns: list[str], days: int):
        self.columns, self.days = columns, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "at_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["at_us", "tie"])
        last = self.sent.get()[0] if self.sent.exists() else None
        take = []
        for at, us in enumerate(every["at_us"].tolist()):
            if last is None or us >= last + self.days * DAY_MS * 1000:
                take.append(at)
                last = us
        if take:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(last // 1000 + self.days * DAY_MS, timerValues.getCurrentWatermarkInMs() + 1))
            self.sent.update((last,))
            yield every.iloc[take][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        return iter(())

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """A ring of the last rows of a key, by (order, tie); emits their number, the sum of a column and the oldest one's tie."""

    def __init__(self, key: str, size: int):
        self.key, self.size = key, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "us bigint, tie bigint, amount bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        for batch in rows:
            ring += zip(batch["at_us"].tolist(), batch["tie"].tolist(), batch["amount"].tolist())
            ring = sorted(ring)[-self.size:]
        self.ring.put(ring)
        yield pd.DataFrame([[*key, len(ring), sum(x[2] for x in ring), ring[0][1]]], columns=[self.key, "records", "total", "oldest"])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: StructType, mode: str, time: str = "EventTime") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, time)


def _fields(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def running_maxima(stream: DataFrame, key: str, counters: dict[str, Column], lateness: str, days: int) -> DataFrame:
    names = list(counters)
    rows = stream.withWatermark("ts", lateness).select(key, "ts", *[v.alias(n) for n, v in counters.items()])
    return _run(rows, key, Maxima(key, _fields(rows, names), days, names), StructType.fromDDL(_fields(rows, [key, *names])), "Update")


def newest_values(stream: DataFrame, key: str, value: str, lateness: str, days: int) -> DataFrame:
    rows = stream.withWatermark("ts", lateness).select(key, "ts", value, F.unix_micros("ts").alias("stored_us"), F.col("event_id").cast("bigint").alias("stored_id"))
    names = [value, "stored_us", "stored_id"]
    return _run(rows, key, Newest(key, _fields(rows, names), days, value), StructType.fromDDL(_fields(rows, [key, *names])), "Update")


def once(stream: DataFrame, key: str, condition: Column, columns: list[str], lateness: str, days: int) -> DataFrame:
    """Rows that meet ``condition``, the first by (ts, event_id) a key and again after ``days``: ``columns``."""
    rows = stream.filter(condition).withWatermark("ts", lateness)
    rows = rows.select(*dict.fromkeys([key, *columns, "ts"]), F.unix_micros("ts").alias("at_us"), F.col("event_id").cast("bigint").alias("tie"))
    return _run(rows, key, Once(columns, days), StructType.fromDDL(_fields(rows, columns)), "Append")


def latest_records(stream: DataFrame, key: str, amount: Column, size: int) -> DataFrame:
    """Totals of the last ``size`` records of each key: ``key``, ``records``, ``total``, ``oldest`` (event id)."""
    rows = stream.select(key, F.unix_micros("ts").alias("at_us"), F.col("event_id").cast("bigint").alias("tie"), amount.cast("bigint").alias("amount"))
    return _run(rows, key, Latest(key, size), StructType.fromDDL(f"{_fields(rows, [key])}, records bigint, total bigint, oldest bigint"), "Update", "None")
