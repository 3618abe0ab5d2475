"""Stored tables that grow, keys that are null, input without an order."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.store import Store


def test_buckets_by_linear_hashing():
    hashes = range(4096)
    of = lambda h, n: (h % (1 << (n - 1).bit_length())) if h % (1 << (n - 1).bit_length()) < n else h % max(1, (1 << (n - 1).bit_length()) // 2)
    for old, new in ((1, 2), (2, 3), (3, 5), (4, 9), (7, 40), (16, 17)):
        assert {of(h, new) for h in hashes} == set(range(new))
        moved = {str(of(h, old)) for h in hashes if of(h, old) != of(h, new)}
        assert Store._parents(old, new) == moved


def test_a_table_grows_to_a_hundred_buckets_without_being_rewritten(spark, tmp_path):
    store, total, moved = Store(spark, str(tmp_path / "s"), 2, rows_each=60), 0, []
    for k in range(4):
        n = 30 if k == 0 else total * 4  # from one bucket's worth to a hundred
        rows = spark.range(total, total + n).select("id", (F.col("id") * 2).alias("x"))
        total += n
        assert store.put("t", ["id"], rows) == total
        moved.append(store.written - n)
    manifest = store._manifest("t")
    assert manifest["rows"] == total == 3750 and manifest["buckets"] == 13  # grows at the next write
    assert store.put("t", ["id"], spark.createDataFrame([(-1, 0)], "id long, x long")) == total + 1
    assert store._manifest("t")["buckets"] == 63
    one = store.put("t", ["id"], spark.createDataFrame([(-2, 0)], "id long, x long"))
    assert one == total + 2 and store.written < 3 * 60 * 2  # a write touches its own bucket only
    assert store.rows("t").where("id >= 0 AND x = 2 * id").count() == total
    assert store.rows("t", values=[17, 99999]).collect()[0].x == 34
    assert store.rows("t", keys=spark.createDataFrame([(5,)], "id long")).where("id = 5").count() == 1


def test_null_keys_and_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    one = lambda v: spark.createDataFrame([(None, "k", v), (1, None, v)], "a long, b string, v long")
    store.put("t", ["a", "b"], one(1))
    assert store.put("t", ["a", "b"], one(2)) == 2 and {r.v for r in store.rows("t").collect()} == {2}
    twice = one(3).unionByName(one(4)).withColumn("seq", F.col("v"))
    with pytest.raises(ValueError, match="seq"):
        store.put("t", ["a", "b"], twice.drop("seq"))
    store.put("t", ["a", "b"], twice, "seq")
    assert {r.v for r in store.rows("t").collect()} == {4}
    assert store.delete_matching("t", spark.createDataFrame([(None, "k")], "a long, b string")) == 1
    assert store.delete_matching("t", spark.createDataFrame([(4,)], "v long")) == 0 and store.delete_matching("none", one(1)) == 0
