"""Sessions of a stream by keyed state and event-time timers, and the same of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SESSION = "key long, start timestamp, last timestamp, n long, total double"
STATE = "start long, last long, n long, total double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(spans: list[tuple], gap: int) -> list[tuple]:
    """(start, last, n, total) in order, those that are less than gap apart together."""
    out: list[tuple] = []
    for start, last, n, total in sorted(spans):
        if out and start - out[-1][1] < gap:
            a, b, m, t = out[-1]
            out[-1] = a, max(b, last), m + n, t + total
        else:
            out.append((start, last, n, total))
    return out


class Sessions(StatefulProcessor):
    """Open sessions of a key (microseconds) are its state. Rows may come out of order within the watermark's delay and join sessions.

    A session is told once the watermark is gap beyond its last row; then its state goes. Each batch sums its rows before state is read.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getListState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(x) for x in self.open.get()]
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            spans = merged(spans + [(t, t, 1, v) for t, v in zip(at.tolist(), pdf["value"].tolist(), strict=True)], self.gap)
        yield from self.settled(key, spans, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settled(key, [tuple(x) for x in self.open.get()], timerValues.getCurrentWatermarkInMs())

    def ends(self, span: tuple) -> int:
        return (span[1] + self.gap) // 1000

    def settled(self, key, spans: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        over, left = [s for s in spans if self.ends(s) <= watermark], [s for s in spans if self.ends(s) > watermark]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(map(self.ends, left)))
        else:
            self.open.clear()
        if over:
            when = lambda i: pd.to_datetime([s[i] for s in over], unit="us", utc=True)
            yield pd.DataFrame({"key": [key[0]] * len(over), "start": when(0), "last": when(1), "n": [s[2] for s in over], "total": [float(s[3]) for s in over]})


def of_stream(rows: DataFrame, gap_seconds: int, delay_seconds: int) -> DataFrame:
    """Sessions of a stream of key, ts (a timestamp) and value: rows of a key less than the gap apart. Rows that come later than the delay are left out.

    Null keys, times and values are left out. The state store has to be one that keeps timers (`prepared`).
    """
    known = rows.where("key IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", f"{delay_seconds} seconds")
    return known.groupBy("key").transformWithStateInPandas(Sessions(gap_seconds * 1_000_000), SESSION, "append", "eventTime")


def prepared(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def of_table(rows: DataFrame, gap_seconds: int, delay_seconds: int) -> DataFrame:
    """What `of_stream` has told when all rows have come in order: sessions that ended gap before the last time but the delay."""
    own = Window.partitionBy("key").orderBy("ts")
    micros = F.unix_micros("ts")
    known = rows.where("key IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    fresh = F.coalesce(micros - F.lag(micros).over(own) >= gap_seconds * 1_000_000, F.lit(True)).cast("int")
    marked = known.withColumn("_f", fresh).withColumn("_s", F.sum("_f").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    each = marked.groupBy("key", "_s").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("value").alias("total")).drop("_s")
    end = known.agg((F.unix_millis(F.max("ts")) - delay_seconds * 1000).alias("_end"))
    return each.join(F.broadcast(end), F.unix_millis("last") + gap_seconds * 1000 <= F.col("_end")).drop("_end")
