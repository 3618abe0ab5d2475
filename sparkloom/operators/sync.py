"""Bringing stored rows up to date: multiset differences as equi-joins on occurrence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def plan_sync(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """action, file, digest, stored_id, fresh_id from (file, digest, position, id) of both sides.

    Rows with equal file and digest pair up by occurrence: pairs are kept, other fresh rows
    added, other stored rows retracted. An added and a retracted row at the same file and
    position are also a revision. Stored rows must be the live ones.
    """
    keys = ["file", "digest"]
    side = lambda df, name: _numbered(df, keys, ["position", "id"]).select(*keys, "occurrence", F.col("position").alias(f"{name}_position"), F.col("id").alias(f"{name}_id"))
    both = side(stored, "stored").join(side(fresh, "fresh"), [*keys, "occurrence"], "full_outer")
    action = F.when(F.col("fresh_id").isNull(), "retract").when(F.col("stored_id").isNull(), "add").otherwise("keep")
    plan = both.withColumn("action", action)
    end = lambda kind, name: _numbered(plan.where(F.col("action") == kind).select("file", F.col(f"{name}_position").alias("position"), f"{name}_id", F.col("digest").alias(f"{name}_digest")), ["file", "position"], [f"{name}_id"])
    revised = end("retract", "stored").join(end("add", "fresh"), ["file", "position", "occurrence"])
    columns = ["action", "file", "digest", "stored_id", "fresh_id"]
    return plan.select(columns).unionByName(revised.select(F.lit("revise").alias("action"), "file", F.col("fresh_digest").alias("digest"), "stored_id", "fresh_id"))


def outdated(current: DataFrame, done: DataFrame) -> DataFrame:
    """path, action: todo where the recorded mtime is missing or another, gone where the source is."""
    todo = current.alias("c").join(done.alias("d"), "path", "left").where(F.col("d.mtime").isNull() | (F.col("c.mtime") != F.col("d.mtime")))
    gone = done.join(current, "path", "left_anti").where(~F.startswith("path", F.lit("memory://")))
    return todo.select("path", F.lit("todo").alias("action")).unionByName(gone.select("path", F.lit("gone").alias("action")))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of manifests (path, size, mtime, hash): added, removed, changed or touched."""
    both = old.alias("o").join(new.alias("n"), "path", "full_outer")
    same = (F.col("o.size") == F.col("n.size")) & (F.col("o.mtime") == F.col("n.mtime"))
    change = F.when(F.col("o.hash").isNull(), "added").when(F.col("n.hash").isNull(), "removed").when(~same & (F.col("o.hash") != F.col("n.hash")), "changed").when(~same, "touched")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def retire(entries: DataFrame, ids: DataFrame, when: float) -> DataFrame:
    """Entries with the listed live ones retracted at a time."""
    hit = ids.select("id", F.lit(True).alias("_hit"))
    live = F.col("_hit").isNotNull() & (F.col("status") == "active")
    return entries.join(hit, "id", "left").withColumns({"retracted_at": F.when(live, F.lit(when)).otherwise(F.col("retracted_at")), "status": F.when(live, "retracted").otherwise(F.col("status"))}).drop("_hit")
