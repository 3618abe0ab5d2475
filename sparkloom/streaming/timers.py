"""State per key with timers: puts that settle after a delay of their own, and the last compaction of growing logs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The state store that timers need; set on sessions that run these streams.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def settle(puts: list[tuple[int, int, int, int]], watermark: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """((due, puts that it settles) that are sure by the watermark, puts still open) of one key.

    puts: (at, seq, delay, before) in milliseconds; before counts puts that a later one has
    superseded. The latest put in order of (at, seq) alone counts: an earlier one is due at
    its own time plus delay only if no later one came before that.
    """
    done, open_ = [], []
    for at, seq, delay, before in sorted(puts):
        if open_:
            last_at, last_seq, last_delay, last_before = open_[-1]
            if last_at + last_delay <= at:  # it was due before this put
                if last_at + last_delay > watermark:
                    open_.append((at, seq, delay, before))
                    continue
                done.append((last_at + last_delay, last_before + 1))
                open_.pop()
            elif at <= watermark:  # superseded for good, as nothing can come between any more
                open_.pop()
                before += last_before + 1
        open_.append((at, seq, delay, before))
    if len(open_) == 1 and open_[0][0] + open_[0][2] <= watermark:
        done.append((open_[0][0] + open_[0][2], open_[0][3] + 1))
        open_ = []
    return done, open_


class Debounce(StatefulProcessor):
    """Puts of a key that aren't settled, and a timer at each time at which one may become due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", StructType([StructField(n, LongType()) for n in ("at", "seq", "delay", "before")]))

    def _advance(self, key: Any, puts: list[tuple[int, int, int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        done, rest = settle(puts, watermark)
        if rest:
            self.open.put(rest)
            for due in {max(at + delay, watermark + 1) for at, _, delay, _ in rest}:
                self.handle.registerTimer(due)
        else:
            self.open.clear()  # nothing stays of a key that is quiet
        if done:
            yield pd.DataFrame({"key": key[0], "due": [d for d, _ in done], "puts": [n for _, n in done]})

    def _stored(self) -> list[tuple[int, int, int, int]]:
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        puts = self._stored()
        for f in rows:
            puts += [(int(a), int(s), int(d), 0) for a, s, d in zip(f["at"], f["seq"], f["delay"])]
        yield from self._advance(key, puts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._stored(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, ts: str, seq: str, delay: str, lateness: str) -> DataFrame:
    """key, due, puts of a streaming table: a key each time it was left alone for its delay.

    A put (ts, with delay in seconds, of any length down to 0) is due delay later; a later
    put of the key takes its place, shorter or longer delay and all. puts counts those that
    one row settles. Order is that of ts, then seq, whatever the order of arrival within the
    lateness; later ones are dropped, as always with a watermark. A put at the very time an
    earlier one is due comes after it. Repeated rows are puts of their own; null keys share
    one state; rows of null ts, seq or delay are left out. What is open at the end of a run
    is state, so the next run goes on with it. Times are milliseconds in the state.
    """
    ms = lambda c: F.unix_millis(c)
    puts = events.where(F.col(ts).isNotNull() & F.col(seq).isNotNull() & F.col(delay).isNotNull()).withWatermark(ts, lateness)
    puts = puts.select(F.col(key).cast("string").alias("key"), F.col(ts), ms(F.col(ts)).alias("at"), F.col(seq).cast("long").alias("seq"), F.round(F.col(delay) * 1000).cast("long").alias("delay"))
    out = StructType([StructField("key", StringType()), StructField("due", LongType()), StructField("puts", LongType())])
    done = puts.groupBy("key").transformWithStateInPandas(Debounce(), out, "Append", "EventTime")
    return done.select("key", F.timestamp_millis("due").alias("due"), "puts")


def debounced_batch(events: DataFrame, key: str, ts: str, seq: str, delay: str, until: str | None = None) -> DataFrame:
    """The rows that `debounced` gives of a whole table once its watermark is at `until` (a SQL expression; by default the last ts)."""
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("at", "seq")
    puts = events.where(F.col(ts).isNotNull() & F.col(seq).isNotNull() & F.col(delay).isNotNull())
    puts = puts.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts)).alias("at"), F.col(seq).cast("long").alias("seq"), F.round(F.col(delay) * 1000).cast("long").alias("delay"))
    end = puts.agg(F.max("at").alias("end")) if until is None else events.sparkSession.range(1).select(F.unix_millis(F.expr(until)).alias("end"))
    due = puts.withColumn("due", F.col("at") + F.col("delay")).withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("at").over(order))
    settled = due.where("next IS NULL OR next >= due").join(F.broadcast(end), F.col("due") <= F.col("end"))  # one row
    before = F.coalesce(F.lag("place").over(Window.partitionBy("key").orderBy("place")), F.lit(0))
    return settled.select("key", F.timestamp_millis("due").alias("due"), (F.col("place") - before).cast("long").alias("puts"))


class LastCompaction(StatefulProcessor):
    """Size of a log when it was last read, and the last compaction that it has named since it last shrank."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("size", LongType()), StructField("at", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        versions = pd.concat(list(rows)).groupby(["modified", "size"])["at"].max().reset_index().sort_values(["modified", "size"])
        size, last = self.seen.get() if self.seen.exists() else (0, -1)
        for now, at in zip(versions["size"].tolist(), versions["at"].tolist()):
            last = max(int(at), last if now >= size else -1)  # a log that shrank was written anew
            size = int(now)
        self.seen.update((size, last))
        yield pd.DataFrame({"file": [key[0]], "size": [size], "at": [last]})

    def close(self) -> None:
        pass


def compaction_times(lines: DataFrame) -> DataFrame:
    """file, size, at (seconds, or null) of each log of a streaming table each time it changed.

    lines: file, size, modified (bytes and a time of the file as read), value (a line), of
    whole versions of files as they come. The last compaction stays the latest ever named, until the log is shorter than before: then it starts over. Lines that are no JSON
    or end within a record say nothing. Lines are reduced to a few rows a batch and file
    before the state sees them.
    """

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(at=[compacted_at(v) if v is not None else -1 for v in f["value"]]).groupby(["file", "size", "modified"], as_index=False)["at"].max()

    marked = lines.select("file", "size", F.unix_micros("modified").alias("modified"), F.when(F.contains("value", F.lit("compact_boundary")), F.col("value")).alias("value"))
    few = marked.mapInPandas(reduced, "file string, size long, modified long, at long")
    out = StructType([StructField("file", StringType()), StructField("size", LongType()), StructField("at", LongType())])
    done = few.groupBy("file").transformWithStateInPandas(LastCompaction(), out, "Update", "None")
    return done.select("file", "size", F.when(F.col("at") >= 0, F.col("at") / 1e6).alias("at"))


def compacted_at(line: str) -> int:
    """Microseconds of the time that a line names as a compaction; -1 if it names none."""
    try:
        record = json.loads(line)
        if record.get("subtype") != "compact_boundary":
            return -1
        moment = datetime.fromisoformat(record["timestamp"].replace("Z", "+00:00"))
        return round(moment.timestamp() * 1e6) if moment.tzinfo else -1
    except (ValueError, KeyError, AttributeError, TypeError):
        return -1
