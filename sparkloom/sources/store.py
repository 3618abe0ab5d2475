"""Stored tables: bucketed Parquet behind a manifest, with upserts, replacement, deletion, growth and compaction.

A table is a folder of immutable parts and a manifest that says, for each hash bucket of the
key, which part's files hold it. A write rewrites the buckets that it touches into a part of
its own and then puts a new manifest in the old one's place by a rename; readers see one
version or the other, and a job that dies leaves nothing but an unused part. One writer at
a time. Executors read and write Parquet; only manifests pass through the driver.

Buckets follow the table's size by linear hashing: a table that has outgrown its buckets
gets further ones at its next write, and only those that a new one splits are rewritten.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.selection import last_wins

#: Least buckets of a table, and rows for each of which it gets one.
BUCKETS, ROWS = 16, 1_000_000
#: Tasks that write one bucket.
SPLIT = 4
#: Parts that no manifest names are deleted once they are this old, so that running reads end first.
KEEP_SECONDS = 600


class Store:
    """The tables below one folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, home: str, buckets: int = BUCKETS, rows_each: int = ROWS):
        self.spark, self.home, self.buckets, self.rows_each = spark, home.rstrip("/"), buckets, rows_each
        #: Rows that the last write put into its part, those of touched buckets included.
        self.written = 0
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests

    def _manifest(self, name: str) -> dict | None:
        path = self._path(f"{self.home}/{name}/manifest.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> None:
        new, old = (self._path(f"{self.home}/{name}/{x}") for x in (f"manifest-{uuid.uuid4().hex}", "manifest.json"))
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri().resolve("/"), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, old, options)

    # ------------------------------------------------------------ reading

    def exists(self, name: str) -> bool:
        return self._manifest(name) is not None

    def names(self) -> list[str]:
        """The tables there are, sorted."""
        root = self._path(self.home)
        found = [s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()] if self._fs.exists(root) else []
        return sorted(n for n in found if self.exists(n))

    def _read(self, manifest: dict, name: str, buckets: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.home}/{name}/{manifest['parts'][b]}/_bucket={b}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, name: str, columns: Sequence[str] | None = None, where: str | None = None, empty: str = "id string", keys: DataFrame | None = None, values: Sequence[str] | None = None) -> DataFrame:
        """The table's rows, projected and filtered; a table that isn't there is empty, with the columns of `empty`.

        keys (a small frame of the table's key columns) restricts the read to their buckets.
        values (of a table with one key) gives those keys' rows only: their buckets are told
        without a job, and within them files, sorted by key, skip row groups.
        """
        manifest = self._manifest(name)
        if manifest is None:
            out = self.spark.createDataFrame([], empty)
        else:
            buckets = list(manifest["parts"])
            if keys is not None:
                wanted = {str(r[0]) for r in keys.select(self._bucket(manifest["keys"], manifest["buckets"])).distinct().collect()}  # at most one row a bucket
                buckets = [b for b in buckets if b in wanted]
            if values is not None:
                one = manifest["keys"][0]
                kind = StructType.fromJson(manifest["schema"])[one].dataType  # a hash depends on it
                each = F.array(*(self._bucket([F.lit(v).cast(kind)], manifest["buckets"]) for v in values)) if values else F.array().cast("array<int>")
                wanted = set(map(str, self.spark.sql("SELECT 1").select(each).first()[0]))  # folded by the planner
                buckets = [b for b in buckets if b in wanted]
            out = self._read(manifest, name, buckets)
            out = out if values is None else out.where(F.col(one).isin(*values))
        out = out.where(where) if where else out
        return out.select(*columns) if columns else out

    def count(self, name: str) -> int:
        return self.rows(name).count() if self.exists(name) else 0

    # ------------------------------------------------------------ writing

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int):
        """Bucket of a key: its hash modulo the least power of two that isn't below `buckets`, or half of that where there is no such bucket."""
        high = 1 << (buckets - 1).bit_length()
        h = F.xxhash64(*keys)
        wide = F.pmod(h, F.lit(high))
        return F.when(wide < buckets, wide).otherwise(F.pmod(h, F.lit(max(1, high // 2)))).cast("int").alias("_bucket")

    def _wanted(self, rows: int) -> int:
        return max(self.buckets, -(-rows // self.rows_each))

    @staticmethod
    def _parents(old: int, new: int) -> set[str]:
        """Buckets of `old` whose rows a table of `new` buckets has in others, too."""
        found = set()
        for b in range(old, new):
            while b >= old:
                b -= 1 << (b.bit_length() - 1)
            found.add(str(b))
        return found

    def _write(self, name: str, rows: DataFrame, keys: Sequence[str], buckets: int) -> tuple[str, list[str]]:
        """(part, buckets that it has) of rows written by bucket."""
        part = f"part-{int(time.time())}-{uuid.uuid4().hex}"
        # several tasks share a bucket, as one key may have very many rows; sorted files let readers skip row groups
        dealt = rows.withColumn("_bucket", self._bucket(keys, buckets)).repartition(F.col("_bucket"), F.pmod(F.xxhash64(*rows.columns), F.lit(SPLIT)))
        dealt.sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(f"{self.home}/{name}/{part}")
        there = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.home}/{name}/{part}"))]
        self.written = self.spark.read.schema(rows.schema).parquet(f"{self.home}/{name}/{part}").count()  # from the files' ends
        return part, [d.removeprefix("_bucket=") for d in there if d.startswith("_bucket=")]

    def put(self, name: str, keys: Sequence[str], rows: DataFrame, seq: str | None = None, whole: bool = False) -> int:
        """Upsert by keys; the table's number of rows. Of input rows of one key the last by seq stays.

        Without seq, input that repeats a key is an error, since no row of it would be the
        last. With whole a key may have several rows, and those put take the place of all it
        had. Null is a key like others. Without rows nothing is created. Only buckets that
        the input touches, or that the table's growth splits, are read and rewritten; their
        old rows meet the input in an anti-join on the key.
        """
        keys = list(keys)
        if not whole and seq is not None:
            rows = last_wins(rows.withColumn("_key", F.struct(*keys)), "_key", seq).drop("_key").select(rows.columns)
        elif not whole and not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"rows for {name} repeat a key; name their order in seq")
        manifest = self._manifest(name)
        if manifest is None:
            n = rows.count()
            if not n:
                return 0
            buckets = self._wanted(n)
            part, mine = self._write(name, rows, keys, buckets)
            self._commit(name, {"keys": keys, "buckets": buckets, "rows": self.written, "schema": rows.schema.jsonValue(), "parts": dict.fromkeys(mine, part)})
            return self.written
        if keys != manifest["keys"]:
            raise ValueError(f"{name} has the keys {manifest['keys']}")
        before = manifest["buckets"]
        buckets = max(before, self._wanted(manifest.get("rows", 0)))
        touched = {str(r[0]) for r in rows.select(self._bucket(keys, before)).distinct().collect()}  # at most one row a bucket
        touched |= self._parents(before, buckets)
        schema = StructType.fromJson(manifest["schema"])
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        old = self._read(manifest, name, [b for b in manifest["parts"] if b in touched])
        return self._rewrite(name, manifest, touched, rows.unionByName(self._without(old, rows, keys)), buckets)

    @staticmethod
    def _without(old: DataFrame, gone: DataFrame, columns: Sequence[str]) -> DataFrame:
        """old's rows but those whose columns are a row of gone; nulls are equal."""
        other = gone.select(*(F.col(c).alias(f"_gone{i}") for i, c in enumerate(columns)))
        same = [F.col(c).eqNullSafe(F.col(f"_gone{i}")) for i, c in enumerate(columns)]
        return old.join(other, same, "left_anti")

    def _rewrite(self, name: str, manifest: dict, touched: set[str], rows: DataFrame, buckets: int) -> int:
        """Put rows in the place of the touched buckets; the table's number of rows."""
        part, mine = self._write(name, rows, manifest["keys"], buckets)
        parts = {b: p for b, p in manifest["parts"].items() if b not in touched} | dict.fromkeys(mine, part)
        now = manifest | {"buckets": buckets, "parts": parts}
        now["rows"] = self._read(now, name, list(parts)).count()  # from the files' ends
        self._commit(name, now)
        return now["rows"]

    def replace(self, name: str, rows: DataFrame, keys: Sequence[str], guard: bool = False) -> int:
        """The table becomes rows; without rows it goes, or with guard stays as it was."""
        if rows.isEmpty():
            if not guard and self.exists(name):
                self._fs.delete(self._path(f"{self.home}/{name}/manifest.json"), False)
            return self.count(name)
        buckets = self._wanted(rows.count())
        part, mine = self._write(name, rows, keys, buckets)
        self._commit(name, {"keys": list(keys), "buckets": buckets, "rows": self.written, "schema": rows.schema.jsonValue(), "parts": dict.fromkeys(mine, part)})
        return self.written

    def delete(self, name: str, where: str) -> int:
        """Rows for which `where` is true go; the number of rows left."""
        manifest = self._manifest(name)
        if manifest is None:
            return 0
        kept = self._read(manifest, name, list(manifest["parts"])).where(f"NOT coalesce({where}, false)")
        return self._rewrite(name, manifest, set(manifest["parts"]), kept, manifest["buckets"])

    def delete_matching(self, name: str, gone: DataFrame) -> int:
        """Rows that equal a row of gone in all of its columns go; the number of rows left.

        Where gone has the table's keys, only their buckets are rewritten.
        """
        manifest = self._manifest(name)
        if manifest is None:
            return 0
        touched = set(manifest["parts"])
        if set(manifest["keys"]) <= set(gone.columns):
            touched &= {str(r[0]) for r in gone.select(self._bucket(manifest["keys"], manifest["buckets"])).distinct().collect()}  # at most one row a bucket
        old = self._read(manifest, name, sorted(touched))
        return self._rewrite(name, manifest, touched, self._without(old, gone, gone.columns), manifest["buckets"])

    def compact(self, keep_seconds: float = KEEP_SECONDS) -> int:
        """Delete parts and manifests that nothing names any more and that are old enough; how many went."""
        gone = 0
        for name in self.names():
            manifest = self._manifest(name)
            used = {"manifest.json", *manifest["parts"].values()}
            for status in self._fs.listStatus(self._path(f"{self.home}/{name}")):
                if status.getPath().getName() not in used and status.getModificationTime() / 1000 <= time.time() - keep_seconds:
                    gone += bool(self._fs.delete(status.getPath(), True))
        return gone
