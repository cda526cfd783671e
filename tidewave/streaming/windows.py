"""Windows over live recordings with Structured Streaming: late data, triggers, stateful overlap removal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segments import hop_us


def windowed_counts(events: DataFrame, time_col: str, key: str, duration: str, hop: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per key and tumbling (or, with a hop, sliding) window. Works on
    batch and streaming frames alike; ``late`` sets the watermark of a stream, whose times must then be TIMESTAMP."""
    if late:
        events = events.withWatermark(time_col, late)
    window = F.window(time_col, duration, hop) if hop else F.window(time_col, duration)
    counted = events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, time_col: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Session windows that a gap without events closes."""
    if late:
        events = events.withWatermark(time_col, late)
    return events.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


STATE = "reach_us long"
OUT = "key long, id long, begin_us long, end_us long"
#: Rows that wait for their turn, how far rows have had theirs, the latest begin seen, and two numbers of the fold.
WAITING = "begins array<long>, ends array<long>, ids array<long>, turn_us long, newest_us long, a long, b long"
ORDERED = f"{OUT}, late boolean"


def trim_live(events: DataFrame) -> DataFrame:
    """For each key of a stream (key, id, begin_us, end_us) the part of every event that no event before
    it covers; the state is the furthest end so far, so it stays constant in size. Events count in the order in which they arrive, and by
    begin inside a trigger; ``trim_in_order`` waits for late ones."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reach = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for row in pdf.sort_values(["begin_us", "end_us"]).itertuples():
                begin = row.begin_us if reach is None else max(row.begin_us, reach)
                if begin < row.end_us:
                    out.append((key[0], row.id, begin, row.end_us))
                reach = row.end_us if reach is None else max(reach, row.end_us)
            yield pd.DataFrame(out, columns=["key", "id", "begin_us", "end_us"])
        if reach is not None:
            state.update((int(reach),))

    return events.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def in_order(events: DataFrame, late_us: int, fold: Callable) -> DataFrame:
    """Runs ``fold`` over the events of each key of a stream (key, id, begin_us, end_us) in the order of (begin, end, id), whatever the order of arrival: rows (key,
    id, begin_us, end_us, late).

    An event waits in the key's state until an event of the key lies ``late_us`` behind it, or, where its key falls silent, until the stream's
    watermark, which is twice as far back, has passed it. One that comes when its turn is over is handed out as ``late`` and not folded (beyond
    the watermark Spark drops it, and counts that). The state holds what came in the last ``late_us`` or so. ``fold(a, b, begin, end, id)`` gives the new
    two numbers (both null at first) and the rows (id, begin, end) that are final.
    """
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begins, ends, ids, turn, newest, a, b = state.get if state.exists else ([], [], [], None, None, None, None)
        waiting, out = list(zip(begins, ends, ids)), []
        for pdf in frames:
            for row in zip(pdf["begin_us"].tolist(), pdf["end_us"].tolist(), pdf["id"].tolist()):
                if turn is not None and row[0] < turn:
                    out.append((key[0], row[2], row[0], row[1], True))
                else:
                    waiting.append(row)
                    newest = row[0] if newest is None else max(newest, row[0])
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1_000
        until = passed if newest is None else max(passed, newest - late_us)
        n = 0
        while n < len(waiting) and waiting[n][0] < until:
            begin, end, own = waiting[n]
            a, b, done = fold(a, b, begin, end, own)
            out += [(key[0], i, x, y, False) for i, x, y in done]
            n += 1
        turn, waiting = until if turn is None else max(turn, until), waiting[n:]
        state.update(([r[0] for r in waiting], [r[1] for r in waiting], [r[2] for r in waiting], turn, newest, a, b))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "id", "begin_us", "end_us", "late"])

    timed = events.withColumn("_at", F.timestamp_micros("begin_us")).withWatermark("_at", f"{2 * late_us} microseconds")
    return timed.select("key", "id", "begin_us", "end_us", "_at").groupBy("key").applyInPandasWithState(step, ORDERED, WAITING, "append", "EventTimeTimeout")


def trim_in_order(events: DataFrame, late_us: int) -> DataFrame:
    """As ``trim_live``, by begin whatever the order of arrival: rows (key, id, begin_us, end_us, late)."""

    def fold(reach, _, begin, end, own):
        start = begin if reach is None else max(begin, reach)
        return end if reach is None else max(end, reach), None, [(own, start, end)] if start < end else []

    return in_order(events, late_us, fold)


def anchored_in_order(events: DataFrame, late_us: int, duration_us: int, overlap: float = 0.0) -> DataFrame:
    """The file-anchored chunks of a stream (key, null, begin_us, end_us, late), each when the file that begins the next has had its turn: a file joins the
    chunk if it begins no later than the chunk's last window ends. ``segments.windows_total`` cuts them into windows."""
    hop = hop_us(duration_us, overlap)

    def fold(first, last, begin, end, own):
        if first is not None and first + hop * (-(-(last - first) // hop) - 1) + duration_us >= begin:
            return first, end, []
        return begin, end, [] if first is None else [(None, first, last)]

    return in_order(events, late_us, fold)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there and stops; exactly once, by the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
