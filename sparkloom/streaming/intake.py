"""Continuous intake of session logs: a file stream whose checkpoint says what was seen, and a rescan for what it can't see."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage, remove
from sparkloom.operators.sync import plan_sync
from sparkloom.sources.store import Store
from sparkloom.sources.transcripts import sessions_below

STATE = "file string, digest string, position long, id string, batch string, size long, modified timestamp"


def project_logs(home: str, root: str) -> str:
    """Pattern of the first agent's logs of a project: its folder is the project's path with a dash for all but ASCII letters and digits."""
    return f"{home.rstrip('/')}/projects/{re.sub(r'[^A-Za-z0-9]', '-', root)}/*.jsonl"


def dated_logs(home: str) -> str:
    """Pattern of the second agent's logs: one folder a year, month and day; of all projects."""
    return f"{home.rstrip('/')}/sessions/*/*/*/rollout-*.jsonl"


def log_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """file (a URI), size, modified of the logs that a pattern names; without any, no rows. Contents aren't read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return spark.createDataFrame([], "file string, size long, modified timestamp")
    return spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def logs_of(lines: DataFrame, root: str) -> DataFrame:
    """Lines of the second agent's logs whose recorded folder is root or below."""
    return lines.join(sessions_below(lines, root), "file", "left_semi")


def _described(lines: DataFrame) -> DataFrame:
    meta = F.col("_metadata")
    return lines.select(meta.file_path.alias("file"), meta.file_block_start.alias("block"), meta.file_size.alias("size"), meta.file_modification_time.alias("modified"), "value")


def log_stream(spark: SparkSession, pattern: str, files_at_once: int = 1000) -> DataFrame:
    """file, block, size, modified, value: lines of new logs as a stream; a batch holds whole files.

    Spark's file source keeps the paths that it took in the query's checkpoint and takes none
    twice, so a log that grew is left to `rescan`.
    """
    return _described(spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).load(pattern))


def placed(lines: DataFrame) -> DataFrame:
    """lines with `position`, their number within the file from 0, without a window over a file's lines.

    A task reads a block of a file in order, so a line's place in its block is its row number
    less the block's first; blocks are few and are summed up file by file.
    """
    rows = cut_lineage(lines.withColumn("_row", F.monotonically_increasing_id()))
    blocks = rows.groupBy("file", "block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.withColumn("_before", before), ["file", "block"]).withColumn("position", F.col("_before") + F.col("_row") - F.col("_first")).drop("_row", "_first", "_n", "_before")


def _bring(store: Store, home: str, lines: DataFrame, label: str) -> None:
    """Land the lines of whole files, plan them against the state and change it, in this order, all under a label.

    The state's change is what commits: a label that died before it is written anew by the
    next run, one that the state bears is passed over.
    """
    if lines.isEmpty():
        return
    lines = placed(lines).withColumn("position", F.col("position").cast("long"))
    files = cut_lineage(lines.select("file").distinct())
    stored = store.rows("state", keys=files, empty=STATE).join(files, "file", "left_semi") if store.exists("state") else store.rows("state", empty=STATE)
    if not stored.where(F.col("batch") == label).isEmpty():
        return
    lines.select("file", "size", "modified", "position", "value").write.mode("overwrite").parquet(f"{home}/lines/batch={label}")
    digest = F.sha2(F.coalesce("value", F.lit("")), 256)
    fresh = lines.select("file", digest.alias("digest"), "position", F.concat_ws(":", "file", "position").alias("id"), F.lit(label).alias("batch"), "size", "modified")
    columns = ["file", "digest", "position", "id"]
    plan_sync(stored.select(columns), fresh.select(columns)).write.mode("overwrite").parquet(f"{home}/plan/batch={label}")
    store.put("state", ["file"], fresh, whole=True)


def catch_up(spark: SparkSession, pattern: str, home: str, files_at_once: int = 1000, none_is_all_gone: bool = False) -> dict[str, int]:
    """Take new logs by the stream, then changed and vanished ones by a rescan; batches taken, logs changed and gone.

    The stream's run ends when all that was there at its start is taken, files_at_once in a
    batch; one that was killed goes on at its last batch.
    """
    store, taken = Store(spark, f"{home}/tables"), 0
    if not log_paths(spark, pattern).isEmpty():
        take = lambda batch, number: _bring(store, home, batch, f"new-{number:09d}")
        query = log_stream(spark, pattern, files_at_once).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{home}/offsets").foreachBatch(take).start()
        query.awaitTermination()
        taken = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    changed, gone = rescan(spark, pattern, home, files_at_once, none_is_all_gone)
    return {"batches": taken, "changed": changed, "gone": gone}


def _number(spark: SparkSession, store: Store, home: str) -> int:
    """The next number of a rescan's step. A step that died before it changed the state left a plan that never held: it goes, and its number is free."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/plan")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    labels = [x.getPath().getName().removeprefix("batch=") for x in fs.listStatus(path)] if fs.exists(path) else []
    last = max((x for x in labels if x.startswith(("scan-", "gone-"))), key=lambda x: x[5:], default=None)
    if last is None:
        return 1
    state = store.rows("state", empty=STATE)
    if last.startswith("scan-"):
        held = not state.where(F.col("batch") == last).isEmpty()
    else:
        held = state.join(plans(spark, home).where(F.col("batch") == last).select("file").distinct(), "file", "left_semi").isEmpty()
    if not held:
        remove(spark, f"{home}/plan/batch={last}")
    return int(last[5:]) + held


def rescan(spark: SparkSession, pattern: str, home: str, files_at_once: int = 1000, none_is_all_gone: bool = False) -> tuple[int, int]:
    """Take logs whose size or time isn't the state's, and retract those that are gone; how many each were.

    Listing and state meet in a join; the driver names files_at_once changed paths at a time
    to the reader. A pattern without any file is more likely a missing mount than a
    deletion, and retracts nothing unless none_is_all_gone. Logs without lines have no state
    and are looked at each time.
    """
    store = Store(spark, f"{home}/tables")
    there = cut_lineage(log_paths(spark, pattern))
    known = store.rows("state", empty=STATE).groupBy("file").agg(F.max(F.struct("modified", "size")).alias("v")).select("file", "v.modified", "v.size")
    same = there.join(known, ["file", "modified", "size"], "left_semi").select("file")
    changed = cut_lineage(there.join(same, "file", "left_anti").where("size > 0").withColumn("lot", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("file"), F.lit(64))).orderBy("file")) - 1) / max(1, files_at_once // 64))))
    lots = [r.lot for r in changed.select("lot").distinct().orderBy("lot").collect()]
    for lot in lots:
        paths = [r.path for r in changed.where(F.col("lot") == lot).select(F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"([\[\]{}*?\\\\])", r"\\$1").alias("path")).collect()]  # a path is no pattern
        _bring(store, home, _described(spark.read.text(paths)), f"scan-{_number(spark, store, home):09d}")
    n = changed.count()
    if not store.exists("state") or (there.isEmpty() and not none_is_all_gone):
        return n, 0
    stored = store.rows("state")
    gone = cut_lineage(stored.select("file").distinct().join(there, "file", "left_anti"))
    went = gone.count()
    if went:
        old = stored.join(gone, "file", "left_semi").select("file", "digest", "position", "id")
        plan_sync(old, old.limit(0)).write.parquet(f"{home}/plan/batch=gone-{_number(spark, store, home):09d}")
        store.delete_matching("state", gone)
    return n, went


def state(spark: SparkSession, home: str) -> DataFrame:
    """file, digest, position, id, batch, size, modified of all lines that are in."""
    return Store(spark, f"{home}/tables").rows("state", empty=STATE)


def plans(spark: SparkSession, home: str) -> DataFrame:
    """action, file, digest, stored_id, fresh_id, batch of all batches (new-), rescans (scan-) and retractions (gone-) so far."""
    return spark.read.schema("action string, file string, digest string, stored_id string, fresh_id string, batch string").parquet(f"{home}/plan")


def landed(spark: SparkSession, home: str) -> DataFrame:
    """file, size, modified, position, value: lines of all versions that were taken, as a stream; a batch that was run again may come twice."""
    return spark.readStream.schema("file string, size long, modified timestamp, position long, value string, batch string").parquet(f"{home}/lines")
