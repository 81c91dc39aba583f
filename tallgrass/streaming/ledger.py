"""Stateful folds over event streams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NEW_LINES = "session string, call long, path string, content_hash string, line long"
NEW_RANGES = "session string, call long, path string, content_hash string, start long, end long, late boolean"
_ROW = ["call", "path", "content_hash", "start", "end"]


def add_span(spans: list[int], start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
    """spans with [start, end] added, and the parts of it that were missing.

    spans are the bounds of disjoint closed intervals that do not touch, one after the other: a, b, c, d for [a, b], [c, d].
    """
    first = bisect_left(spans, start - 1)
    last = bisect_right(spans, end + 1)
    # An odd place lies inside an interval or at its end, so the merged interval reaches to that interval's other bound.
    first, last = first - first % 2, last + last % 2
    missing, at = [], start
    for a, b in zip(spans[first:last:2], spans[first + 1 : last : 2], strict=True):
        if at < a:
            missing.append((at, min(end, a - 1)))
        at = max(at, b + 1)
    if at <= end:
        missing.append((at, end))
    inside = spans[first:last]
    merged = [min([start, *inside[:1]]), max([end, *inside[-1:]])]
    return spans[:first] + merged + spans[last:], missing


class DeliveryLedger(StatefulProcessor):
    """Passes on the ranges of lines that a session has not been sent.

    What was sent is kept for each (path, content hash) as merged intervals, so a file that was read once, or many times
    in overlapping pieces, is one interval. Calls are numbered and count in their order. With a wait, rows are held
    back until the watermark has passed them by so long, and a timer then releases them by call; a call that comes after
    a later one was released is marked late and gets what is still missing. Without one, order holds inside a batch.
    """

    def __init__(self, wait_ms: int | None = None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "path string, content_hash string", "spans array<long>")
        self.last = handle.getValueState("last", "call long")
        if self.wait_ms is not None:
            self.waiting = handle.getListState("waiting", "due long, call long, path string, content_hash string, start long, end long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        import pandas as pd

        batch = pd.concat(rows)  # all of a batch, as its frames come in any order
        if self.wait_ms is None:
            yield from self._released(key, list(batch[_ROW].itertuples(index=False)))
            return
        due = batch["ts"].astype("datetime64[ms]").astype("int64") + self.wait_ms
        held = list(zip(due.tolist(), *(batch[c].tolist() for c in _ROW), strict=True))
        self.waiting.appendList(held)
        known = set(self.handle.listTimers())
        for at in {row[0] for row in held} - known:
            self.handle.registerTimer(at)
        yield pd.DataFrame(columns=[f.split()[0] for f in NEW_RANGES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        until = timerValues.getCurrentWatermarkInMs()
        held = [tuple(row) for row in self.waiting.get()]
        ready = [row[1:] for row in held if row[0] <= until]
        later = [row for row in held if row[0] > until]
        if ready and later:
            self.waiting.put(later)
        elif ready:
            self.waiting.clear()
        yield from self._released(key, ready)

    def _released(self, key, ready):
        import pandas as pd

        last = self.last.get()[0] if self.last.exists() else None
        spans: dict[tuple, list[int]] = {}
        out = []
        for call, path, digest, start, end in sorted(ready, key=lambda r: (r[0], r[3], r[4], r[1] or "", r[2] or "")):
            late = last is not None and call < last
            last = call if last is None else max(last, call)
            if start > end:
                continue
            place = (path, digest)
            if place not in spans:
                spans[place] = list(self.sent.getValue(place)[0]) if self.sent.containsKey(place) else []
            spans[place], missing = add_span(spans[place], int(start), int(end))
            out += [(key[0], int(call), path, digest, a, b, late) for a, b in missing]
        for place, held in spans.items():
            self.sent.updateValue(place, (held,))
        if last is not None:
            self.last.update((int(last),))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in NEW_RANGES.split(", ")])

    def close(self) -> None:
        pass


def new_ranges(deliveries: DataFrame, wait: str | None = None) -> DataFrame:
    """The not yet delivered ranges of a stream (session, call, path, content_hash, start, end).

    With wait, a time like "10 minutes", the stream also has ts and a watermark on it, behind which Spark drops rows, and
    calls are brought into order as
    far as rows arrive within that time; late marks the others. Ranges without a line are ignored. Needs the RocksDB
    state store. The rows that one session has in one batch are held together in a task; limit batches by
    maxFilesPerTrigger where a session can have very many.
    """
    wait_ms = None
    if wait is not None:
        number, unit = wait.split()
        wait_ms = int(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    return deliveries.groupBy("session").transformWithStateInPandas(
        DeliveryLedger(wait_ms), outputStructType=NEW_RANGES, outputMode="append", timeMode="none" if wait is None else "eventTime"
    )


def new_lines(deliveries: DataFrame) -> DataFrame:
    """The not yet delivered lines of a stream (session, call, path, content_hash, start, end); needs the RocksDB state store."""
    line = F.explode(F.sequence("start", "end")).alias("line")
    return new_ranges(deliveries).select("session", "call", "path", "content_hash", line)


def event_windows(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by kind and window of a stream or table (ts, event_type, value); rows later than late are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("window"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def first_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Of repeated events the first, remembered as long as the watermark asks."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet below path, exactly once, and reads it."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
