"""Bouts over streams: session windows by event time, and a builder with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def session_bouts(events: DataFrame, keys: list[str], on: Column, gap: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(keys, start, end, n): hits less than ``gap`` apart, once the watermark has passed them; works on batches too."""
    hits = events.withWatermark(time, late).where(F.coalesce(on, F.lit(False)))
    found = hits.groupBy(*keys, F.session_window(time, gap)).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
    return found.drop("session_window")


def window_totals(events: DataFrame, keys: list[str], value: str, width: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(keys, start, n, total) of tumbling windows."""
    grouped = events.withWatermark(time, late).groupBy(*keys, F.window(time, width))
    found = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(*keys, F.col("window.start").alias("start"), "n", "total")


class BoutBuilder(StatefulProcessor):
    """Bouts of one key from frames in any order, held back until the watermark has passed them.

    State: hits that wait for the watermark (their frames, by event time), the open run and the
    open bout, and how far the key is settled. Event-time timers settle what the watermark has
    passed, also when the key sends nothing more; a key without open work leaves no state behind.
    """

    def __init__(self, fps: float, min_len: int, merge_gap: int):
        self.frame_ms, self.min_len, self.merge_gap = 1000.0 / fps, min_len, merge_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame long", "on boolean")
        self.open = handle.getValueState("open", "bs long, be long, rs long, re long, done long")

    def _settled(self, watermark_ms: int) -> int:
        """The last frame that can no longer come: frame n stands for the times from n to n + 1 periods."""
        return int(watermark_ms / self.frame_ms) - 1

    def _now(self) -> tuple[int, int, int, int, int]:
        return self.open.get() if self.open.exists() else (-1, -1, -1, -1, -1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, last = self._now()[4], -1
        for pdf in rows:
            hits = pdf.loc[pdf["on"].fillna(False).astype(bool), "frame"]
            for frame in hits[hits > done].unique().tolist():
                self.waiting.updateValue((int(frame),), (True,))
                last = max(last, int(frame))
        if last >= 0:
            self._call_at(last)
        yield from self._settle(key, self._settled(timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._settled(timerValues.getCurrentWatermarkInMs()))

    def _call_at(self, frame: int) -> None:
        """A timer for the time at which a bout that ends with ``frame`` is closed."""
        self.handle.registerTimer(int((frame + self.merge_gap + 3) * self.frame_ms) + 1)

    def _settle(self, key, upto: int) -> Iterator[pd.DataFrame]:
        bs, be, rs, re, done = self._now()
        if upto <= done:
            return
        out: list[tuple] = []

        def end_bout() -> None:
            nonlocal bs, be
            if bs >= 0 and be - bs + 1 >= self.min_len:
                out.append((*key, bs, be))
            bs = be = -1

        def end_run() -> None:
            nonlocal bs, be, rs, re
            if rs >= 0 and re - rs + 1 >= self.min_len:
                if bs >= 0 and rs - be <= self.merge_gap:
                    be = re
                else:
                    end_bout()
                    bs, be = rs, re
            rs = re = -1

        for frame in sorted(k[0] for k in self.waiting.keys() if k[0] <= upto):
            if rs < 0 or frame != re + 1:
                end_run()
                rs = frame
            re = frame
            self.waiting.removeKey((frame,))
        if rs >= 0 and re < upto:
            end_run()
        # A run that begins later than this can no longer join the bout.
        if bs >= 0 and (rs if rs >= 0 else upto + 1) - be > self.merge_gap:
            end_bout()
        if bs < 0 and rs < 0 and next(iter(self.waiting.keys()), None) is None:
            self.open.clear()
        else:
            self.open.update((bs, be, rs, re, upto))
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "end"])


def online_bouts(frames: DataFrame, key: str, on: str, min_len: int, merge_gap: int, fps: float, late: str = "0 seconds", time: str = "ts") -> DataFrame:
    """(key, start, end) of a stream of (key, ts, on): runs of at least ``min_len`` frames, at most ``merge_gap`` apart made one.

    A time belongs to frame floor(seconds * ``fps``) since the epoch; a frame is on if any of its rows is. Rows may come in any order;
    those behind the watermark (``late`` behind the newest time) are dropped by Spark. A bout is
    given out once the watermark has passed ``merge_gap`` frames after it, also of a key that
    sends nothing more. State holds open runs and the hits of about ``late``, not the stream.
    """
    kind = frames.schema[key].dataType.simpleString()
    seconds = F.unix_micros(time) / 1_000_000
    numbered = frames.withWatermark(time, late).select(F.col(key).alias("key"), time, F.floor(seconds * fps).alias("frame"), F.col(on).alias("on"))
    found = numbered.groupBy("key").transformWithStateInPandas(
        statefulProcessor=BoutBuilder(fps, min_len, merge_gap), outputStructType=f"key {kind}, start long, end long", outputMode="append", timeMode="eventTime"
    )
    return found.withColumnRenamed("key", key)
