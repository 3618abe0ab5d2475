"""Latest-wins debouncing: in batch by a window, in a stream by session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.sync import plan_sync
from sparkloom.sources.store import Store


def settled(events: DataFrame, keys: list[str], ts: str, seq: str, gap: str) -> DataFrame:
    """keys, ts, seq of events after which the key was quiet for at least the gap, or for good."""
    nxt = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, seq))
    return events.withColumn("_next", nxt).where(f"_next IS NULL OR _next - {ts} >= {gap}").select(*keys, ts, seq)


def settled_stream(events: DataFrame, keys: list[str], ts: str, gap: str, lateness: str) -> DataFrame:
    """keys, due, n: one row for each burst of a streaming table once the watermark closes it."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("w.end").alias("due"), "n")
    )


def sync_batches(path: str, buckets: int = 16):
    """A foreachBatch function that keeps, at path, the action log of successive versions of files.

    Each micro-batch (file, digest, position, id) holds whole files; it is planned against
    their stored state, of which only the files' buckets are read, and the plan is written
    under its batch id before the state changes. A replayed batch that the state already has
    is passed over; one that died before overwrites its own plan.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        store = Store(batch.sparkSession, f"{path}/tables", buckets)
        files = batch.select("file").distinct()
        state = batch.select("file", "digest", "position", "id", F.lit(batch_id).alias("batch"))
        stored = store.rows("state", keys=files).join(files, "file", "left_semi") if store.exists("state") else state.limit(0)
        if not stored.where(F.col("batch") >= batch_id).isEmpty():
            return
        plan_sync(stored.drop("batch"), batch).write.mode("overwrite").parquet(f"{path}/plan/batch={batch_id}")
        store.put("state", ["file"], state, whole=True)

    return run
