"""Runs with gap tolerance over a stream of frames, with state for each recording; and the same rule as a table function.

A session window closes a run at its last active frame. The rule here is another: a run that is still within
the gap when its recording ends is held to the last frame. So the end has to be known: a marker row, or, where
none comes, a time without new frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: next frame; runs emitted; begin and last active frame of the open run (-1: none); last frame by the marker (-1: not come); frames that wait
_STATE = "next bigint, seg bigint, start bigint, active bigint, last bigint, waiting bigint"
_EMPTY = (0, 0, -1, -1, -1, 0)


class Runs:
    """The open run of a recording whose frames come in order."""

    def __init__(self, max_gap: int, min_frames: int, seg: int = 0, start: int = -1, active: int = -1) -> None:
        self.max_gap, self.min_frames, self.seg, self.start, self.active = max_gap, min_frames, seg, start, active
        self.closed: list[tuple[int, int, int]] = []

    def _close(self, end: int) -> None:
        if self.start >= 0 and end - self.start + 1 >= self.min_frames:
            self.seg += 1
            self.closed.append((self.seg, self.start, end))
        self.start = self.active = -1

    def add(self, active: np.ndarray) -> None:
        """Numbers of active frames, ascending and beyond those before."""
        for i in active.tolist():
            if self.start >= 0 and i - self.active - 1 > self.max_gap:
                self._close(self.active)
            if self.start < 0:
                self.start = i
            self.active = i

    def end(self, last: int) -> None:
        """The recording ends with frame ``last``."""
        if self.start >= 0:
            self._close(last if last - self.active <= self.max_gap else self.active)


class RunsOfStream(StatefulProcessor):
    """Frames ``(key, i, active, last)`` in any order; ``last`` is null but in the marker row, which has no ``i``.

    Frames are worked off as far as they follow on without a hole; others wait in the state, as little as the
    stream is out of order. A frame that comes twice counts once. ``patience``: milliseconds without
    new rows after which a recording counts as ended with the greatest frame it has; holes are then silent.
    """

    def __init__(self, key: str, max_gap: int, min_frames: int, patience: int | None) -> None:
        self.key, self.max_gap, self.min_frames, self.patience = key, max_gap, min_frames, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.early = handle.getListState("early", "i bigint, active boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        frames = pd.concat(list(rows))
        now = list(self.state.get() or _EMPTY)
        ends = frames["last"].dropna()
        if len(ends):
            now[4] = int(ends.max())
        frames = frames.dropna(subset=["i"])
        i, active = frames["i"].to_numpy(np.int64), frames["active"].eq(True).to_numpy(bool)
        if now[5]:
            held = list(self.early.get())
            i, active = np.r_[i, [h[0] for h in held]].astype(np.int64), np.r_[active, [h[1] for h in held]].astype(bool)
        if self.patience:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)
        yield self._worked(key, now, i, active, over=False)

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, held = list(self.state.get() or _EMPTY), list(self.early.get())
        if now[4] < now[0] or now[5]:  # not ended before
            yield self._worked(key, now, np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], bool), over=True)

    def _worked(self, key: tuple, now: list, i: np.ndarray, active: np.ndarray, over: bool) -> pd.DataFrame:
        next_, seg, start, last_active, last, _ = now
        i, first = np.unique(i, return_index=True)
        active = active[first]
        fresh = i >= next_
        i, active = i[fresh], active[fresh]
        ready = len(i) if over else int((i == next_ + np.arange(len(i))).cumprod().sum())
        runs = Runs(self.max_gap, self.min_frames, seg, start, last_active)
        runs.add(i[:ready][active[:ready]])
        next_ = int(i[ready - 1]) + 1 if ready else next_
        if over:
            last = next_ - 1
        if 0 <= last < next_:
            runs.end(last)
        late = list(zip(i[ready:].tolist(), active[ready:].tolist(), strict=True))
        if late or now[5]:
            self.early.put(late) if late else self.early.clear()
        self.state.update((next_, runs.seg, runs.start, runs.active, last, len(late)))
        out = runs.closed
        numbers = {c: np.array([o[k] for o in out], np.int64) for k, c in enumerate(("seg", "start_f", "end_f"))}
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(out), dtype=object), **numbers})

    def close(self) -> None:
        pass


def runs_of_stream(frames: DataFrame, key: str, max_gap: int, min_frames: int, patience: int | None = None) -> DataFrame:
    """Closed runs ``(key, seg, start_f, end_f)`` of a stream of ``(key, i, active, last)``, see ``RunsOfStream``; equal to ``runs.runs`` with ``hold_open``."""
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "i", "active", "last").groupBy(key).transformWithStateInPandas(
        RunsOfStream(key, max_gap, min_frames, patience), f"`{key}` {kind}, seg bigint, start_f bigint, end_f bigint", "Append", "ProcessingTime" if patience else "None"
    )


@udtf(returnType="recording string, seg bigint, start_f bigint, end_f bigint")
class Segments:
    """Table function: runs of the rows ``(recording, i, active)`` of one partition, in the order of ``i``."""

    def __init__(self) -> None:
        self.runs: Runs | None = None
        self.recording, self.last = None, -1

    def eval(self, frame: Row, max_gap: int, min_frames: int):
        if self.runs is None:
            self.runs, self.recording = Runs(max_gap, min_frames), frame["recording"]
        if frame["active"]:
            self.runs.add(np.array([frame["i"]]))
        self.last = frame["i"]
        yield from self._out()

    def terminate(self):
        if self.runs is not None:
            self.runs.end(self.last)
            yield from self._out()

    def _out(self):
        closed, self.runs.closed = self.runs.closed, []
        for seg, start, end in closed:
            yield self.recording, seg, start, end


def register(spark: SparkSession) -> None:
    """Makes ``segments(TABLE(...) PARTITION BY (recording) ORDER BY (i), max_gap, min_frames)`` known to SQL; it holds one frame at a time."""
    spark.udtf.register("segments", Segments)
