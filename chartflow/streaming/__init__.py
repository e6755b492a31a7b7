"""Streaming forms of the batch operators: windows, sessions, and suppression of repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(events: DataFrame, key: str, time: str, value: str, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count, mean, least and greatest value by key and clock hour; late rows are waited for so long."""
    return events.withWatermark(time, late).groupBy(F.col(key), F.window(time, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def sessions(events: DataFrame, key: str, time: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events without a gap: the streaming form of courses."""
    return events.withWatermark(time, late).groupBy(F.col(key), F.session_window(time, gap)).agg(F.count("*").alias("n"))


def suppress_repeats(events: DataFrame, key: str, time: str, days: int) -> DataFrame:
    """Keep an event if more than so many whole days have passed since the last one kept of its key.

    The state of a key is one time.  Rows of a batch go by time; across batches
    they count in the order in which they come.
    """
    kept = events.schema

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(frames)).sort_values(time)
        keep = []
        for t in rows[time]:
            ok = last is None or (t - last).days > days
            keep.append(ok)
            last = t if ok else last
        if last is not None:
            state.update((last.value // 1000,))
        yield rows[keep]

    return events.groupBy(key).applyInPandasWithState(step, kept, "last long", "append", GroupStateTimeout.NoTimeout)


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pd.DataFrame | None:
    return pa.ipc.open_stream(data).read_all().to_pandas() if data else None


def _millis(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def _waiting(frames: Iterator[pd.DataFrame], state: GroupState, data: bytes | None, time: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows that the watermark has passed, in order, and those that wait."""
    parts = [p for p in (_unpacked(data), *([] if state.hasTimedOut else frames)) if p is not None and len(p)]
    rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({time: pd.Series([], dtype="datetime64[ns]")})
    rows = rows.sort_values([time, *(c for c in rows.columns if c != time)], kind="stable")
    due = rows[time] <= pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
    return rows[due], rows[~due]


def suppress_repeats_in_order(events: DataFrame, key: str, time: str, days: int, *, late: str = "10 minutes") -> DataFrame:
    """sequences.suppress_repeats as a stream: rows wait until the watermark has passed them, and so count in order of time.

    Late rows are waited for so long, later ones are dropped.  A key's state is
    the last time kept and the rows that wait; a timer takes it away once so
    many days have passed that whatever comes is kept, so state does not grow
    with keys that are gone.  The session's zone should be UTC.
    """
    names = events.columns

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, data = state.get if state.exists else (None, None)
        due, rest = _waiting(frames, state, data, time)
        keep, now = [], None if last is None else pd.Timestamp(last, unit="us")
        for t in due[time]:
            ok = now is None or (t - now).days > days
            keep.append(ok)
            now = t if ok else now
        gone = now is None or _millis(now + pd.Timedelta(days=days + 1)) <= state.getCurrentWatermarkMs()
        if len(rest):
            state.update((None if now is None else now.value // 1000, _packed(rest)))
            state.setTimeoutTimestamp(_millis(rest[time].iloc[0]) + 1)
        elif not gone:
            state.update((now.value // 1000, None))
            state.setTimeoutTimestamp(_millis(now + pd.Timedelta(days=days + 1)))
        elif state.exists:
            state.remove()
        if any(keep):
            yield due[keep][names]

    marked = events.withWatermark(time, late)
    return marked.groupBy(key).applyInPandasWithState(step, events.schema, "last long, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def windows_from_first(events: DataFrame, key: str, time: str, value: str, hours: int, *, late: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """Windows of so many hours counted from a key's first event (R7): key, window_number, window_start, n, total, least, greatest.

    A window comes out once the watermark has passed its end, when nothing can
    be added to it any more.  A key without events for idle is forgotten: its
    windows begin anew with what comes later.  A null value counts as an event without one.
    """
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("window_number", T.LongType()), T.StructField("window_start", T.TimestampType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("total", "least", "greatest"))])
    width, patience = pd.Timedelta(hours=hours), pd.Timedelta(idle)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, latest, data, open_ = state.get if state.exists else (None, None, None, None)
        due, rest = _waiting(frames, state, data, time)
        windows = _unpacked(open_)
        if len(due):
            first = due[time].iloc[0].value // 1000 if first is None else first
            latest = due[time].iloc[-1].value // 1000
            number = (due[time] - pd.Timestamp(first, unit="us")) // width
            new = due.groupby(number.rename("window_number"))[value].agg(n="size", total=lambda v: v.sum(min_count=1), least="min", greatest="max").reset_index()
            both = new if windows is None else pd.concat([windows, new])
            windows = both.groupby("window_number").agg(n=("n", "sum"), total=("total", lambda v: v.sum(min_count=1)), least=("least", "min"), greatest=("greatest", "max")).reset_index()
        mark, done = state.getCurrentWatermarkMs(), None
        if windows is not None and len(windows):
            start = pd.Timestamp(first, unit="us") + windows["window_number"] * width
            windows = windows.assign(window_start=start)
            over = start + width <= pd.Timestamp(mark, unit="ms")
            done, windows = windows[over], windows[~over].drop(columns="window_start")
        until = []
        if len(rest):
            until.append(_millis(rest[time].iloc[0]) + 1)
        if windows is not None and len(windows):
            until.append(_millis(pd.Timestamp(first, unit="us") + (int(windows["window_number"].min()) + 1) * width))
        if latest is not None:
            until.append(_millis(pd.Timestamp(latest, unit="us") + patience))
        until = [u for u in until if u > mark]
        if until:
            state.update((first, latest, _packed(rest) if len(rest) else None, _packed(windows) if windows is not None and len(windows) else None))
            state.setTimeoutTimestamp(min(until))
        elif state.exists:
            state.remove()
        if done is not None and len(done):
            yield done.assign(**{key: k[0]})[[f.name for f in out]]

    marked = events.withWatermark(time, late)
    return marked.groupBy(key).applyInPandasWithState(step, out, "first long, latest long, waiting binary, windows binary", "append", GroupStateTimeout.EventTimeTimeout)
