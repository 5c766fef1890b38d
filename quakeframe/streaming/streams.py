"""Streaming forms of the station jobs: pick counts, close picks, carried-over tails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quakeframe.sources.io import scratch


def pick_counts(picks: DataFrame, delay: str) -> DataFrame:
    """Picks of each station and UTC day, given out when the day is `delay` behind; later picks are dropped with their day."""
    return picks.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "station").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day_start"), "station", "n")


def lone_picks(picks: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """Picks with no other one of their station nearer than the gap.

    Sessions that end exactly a gap apart are merged, while such picks aren't close, so the session gap is a microsecond less.
    """
    gap = f"{gap_seconds - 1} seconds 999999 microseconds"
    s = picks.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "station").agg(F.count(F.lit(1)).alias("n"), F.min("pick_id").alias("pick_id"))
    return s.filter("n = 1").select("station", "pick_id")


CARRIED = "station long, day long, previous_appended boolean, starttime double, data array<double>, late boolean"

#: Samples that go out in one frame, or a day if that has more.
FRAME = 1 << 20


class CarryOver(StatefulProcessor):
    """Keyed state of `carry_over`: days that wait for the watermark, and the end of the last day that went out.

    A timer stands at the earliest end that waits. When it fires, all days that the watermark has passed go out by one
    reading of the list of ends; the samples of a day are read and removed by its key. So work grows with the days, however
    many wait.
    """

    def __init__(self, n: int, rate: float, keep: float):
        self.n, self.rate, self.keep = n, rate, int(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long", "starttime double, data binary")
        self.ends = handle.getListState("ends", "day long, ends long")
        self.timer = handle.getValueState("timer", "ends long")
        self.last = handle.getValueState("last", "day long, ends long, until double, tail array<double>")

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["station", "day", "previous_appended", "starttime", "data", "late"])

    def _wake(self, ends: int) -> None:
        self.handle.registerTimer(ends)
        self.timer.update((ends,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        first = self.timer.get()[0] if self.timer.exists() else None
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:  # one part at a time; no list of all days
            late, fresh = [], []
            for day, start, data, ends in zip(part["day"], part["starttime"], part["data"], part["ends"], strict=True):
                day, ends, data = int(day), int(ends), np.asarray(data, float)
                if last is not None and day <= last[0] or ends <= now:
                    late.append((key[0], day, False, float(start), data, True))
                    continue
                self.waiting.updateValue((day,), (float(start), data.tobytes()))
                fresh.append((day, ends))
            if fresh:
                self.ends.appendList(fresh)
                soonest = min(ends for _, ends in fresh)
                if first is None or soonest < first:
                    first = soonest
                    self._wake(first)
            yield self._out(late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get() if self.last.exists() else None
        if not self.timer.exists() or self.timer.get()[0] > now:
            if last is not None and last[1] + self.keep <= at:
                self.last.update((last[0], last[1], last[2], []))  # nothing can join it any more: the day stays, to tell late ones, its samples go
            return
        ends_of = dict(self.ends.get())  # of a day that came twice the later row counts, as in `waiting`
        rows, samples = [], 0
        for day in sorted(day for day, ends in ends_of.items() if ends <= now):
            ends = ends_of.pop(day)
            start, data = self.waiting.getValue((day,))
            self.waiting.removeKey((day,))
            data = np.frombuffer(data, float)
            gap = None if last is None else start - last[2] + 1 / self.rate
            joined = gap is not None and len(last[3]) > 0 and 0 < gap < 1.5 / self.rate and last[1] + self.keep >= ends
            tail = np.asarray(last[3], float) if joined else np.empty(0)
            rows.append((key[0], day, joined, start - len(tail) / self.rate, np.concatenate([tail, data]), False))
            last = (day, ends, start + len(data) / self.rate, data[max(len(data) - self.n, 0) :].tolist())
            samples += len(data)
            if samples >= FRAME:
                yield self._out(rows)
                rows, samples = [], 0
        if last is not None:
            self.last.update(last)
            self.handle.registerTimer(last[1] + self.keep)
        if ends_of:
            self.ends.put(list(ends_of.items()))
            self._wake(min(ends_of.values()))
        else:
            self.ends.clear()
            self.timer.clear()
        yield self._out(rows)


def carry_over(days: DataFrame, n: int, rate: float, delay: str, keep: float = 172800.0) -> DataFrame:
    """Station-days with the last n samples of the day before put before them, if that ended less than 1.5 samples ago.

    A day has to come with `ends`, the event time of its end; it goes out when the watermark, `delay` behind the latest
    end, has passed it. So days of a station may come out of order within the delay; those that come later are given out as
    they are, with `late` set, and change nothing. A missing day breaks the chain. State holds what waits inside the
    delay, and n samples of a station's last day for `keep` seconds of event time.
    """
    # Spark drops late rows by a column that has the watermark; a copy without it lets them through to be told apart.
    plain = days.withWatermark("ends", delay).select("station", "day", "starttime", "data", F.unix_millis(F.col("ends").cast("timestamp")).alias("ends"))
    grouped = plain.groupBy("station")
    return grouped.transformWithStateInPandas(CarryOver(n, rate, keep), CARRIED, "Append", "EventTime")


#: The state store that keyed timers and maps need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """A stream run over all its input there is now into Parquet, and read."""
    out = scratch(spark, name)
    name_of, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name_of, ROCKS)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        spark.conf.set(name_of, before)
    return spark.read.schema(stream.schema).parquet(out)
