"""Streams: logs that come, grow, are replaced and vanish, runs that die, puts with delays, last compactions."""

import json
import os
import random
import time
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import intake, timers


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    spark.conf.set(*timers.STATE_STORE)
    yield
    spark.conf.unset(timers.STATE_STORE[0])


def write(path, lines, age=0.0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))
    now = time.time() + age
    os.utime(path, (now, now))


def lines_in(spark, home):
    """Lines by file's name, as the state has them."""
    out = {}
    for r in intake.state(spark, home).collect():
        out.setdefault(unquote(r.file.rsplit("/", 1)[1]), {})[r.position] = r.digest
    return {f: [x[i] for i in range(len(x))] for f, x in out.items()}


def digests(lines):
    import hashlib

    return [hashlib.sha256(x.encode()).hexdigest() for x in lines]


def test_logs_come_grow_change_and_vanish(spark, tmp_path):
    logs, home = tmp_path / "projects" / "-home-me-x-1", str(tmp_path / "home")
    pattern = intake.project_logs(f"file://{tmp_path}", "/home/me/x_1")
    assert intake.catch_up(spark, pattern, home) == {"batches": 0, "changed": 0, "gone": 0}
    want = {"a.jsonl": ["one", "two", "two"], "b.jsonl": ["b"], "c b.jsonl": ["x", "", "y"]}
    for name, lines in want.items():
        write(logs / name, lines, -50)
    write(logs / "d.txt", ["no log"])
    assert intake.catch_up(spark, pattern, home)["gone"] == 0
    assert lines_in(spark, home) == {f: digests(x) for f, x in want.items()}
    assert intake.catch_up(spark, pattern, home) == {"batches": 0, "changed": 0, "gone": 0}  # nothing is taken twice
    want |= {"a.jsonl": ["one", "two", "two", "three"], "c b.jsonl": ["z"], "e.jsonl": ["new"]}
    for name in ("a.jsonl", "c b.jsonl", "e.jsonl"):
        write(logs / name, want[name], 10)
    (logs / "b.jsonl").unlink()
    del want["b.jsonl"]
    assert intake.catch_up(spark, pattern, home, files_at_once=2)["gone"] == 1
    assert lines_in(spark, home) == {f: digests(x) for f, x in want.items()}
    last = intake.plans(spark, home).where("batch NOT LIKE 'new-%0'").groupBy(F.element_at(F.split("file", "/"), -1).alias("f"), "action").count().collect()
    assert {(unquote(r.f), r.action): r["count"] for r in last} == {("a.jsonl", "keep"): 3, ("a.jsonl", "add"): 1, ("b.jsonl", "retract"): 1, ("c b.jsonl", "retract"): 3, ("c b.jsonl", "add"): 1, ("c b.jsonl", "revise"): 1, ("e.jsonl", "add"): 1}
    for f in logs.iterdir():
        f.unlink()
    assert intake.catch_up(spark, pattern, home)["gone"] == 0  # a folder that is empty all at once may be a lost mount
    assert intake.catch_up(spark, pattern, home, none_is_all_gone=True)["gone"] == 3
    assert lines_in(spark, home) == {}


@pytest.mark.parametrize("moment", ["before", "after the plan", "after the state"])
@pytest.mark.parametrize("changed", [False, True])
def test_a_run_that_died_goes_on(spark, tmp_path, monkeypatch, moment, changed):
    logs, home, pattern = tmp_path / "l", str(tmp_path / "home"), f"file://{tmp_path}/l/*.jsonl"
    write(logs / "a.jsonl", ["one", "two"], -50)
    write(logs / "b.jsonl", ["three"], -40)
    if changed:  # the rescan dies, not the stream
        intake.catch_up(spark, pattern, home)
        write(logs / "a.jsonl", ["one", "two", "four"], -30)
    real, calls = intake._bring, []

    class Killed(Exception):
        pass

    def dying(store, home, lines, label):
        calls.append(label)
        if len(calls) == (1 if changed else 2):
            if moment == "before":
                raise Killed("Killed")
            if moment == "after the plan":
                monkeypatch.setattr(type(store), "put", lambda *a, **k: (_ for _ in ()).throw(Killed("Killed")))
            real(store, home, lines, label)
            raise Killed("Killed")
        real(store, home, lines, label)

    monkeypatch.setattr(intake, "_bring", dying)
    with pytest.raises(Exception, match="Killed"):
        intake.catch_up(spark, pattern, home, files_at_once=1)
    monkeypatch.undo()
    if changed and moment == "after the plan":
        write(logs / "a.jsonl", ["one", "five"], -20)  # what the dead run planned never comes to hold
    intake.catch_up(spark, pattern, home, files_at_once=1)
    a = ["one", "five"] if changed and moment == "after the plan" else ["one", "two", "four"] if changed else ["one", "two"]
    assert lines_in(spark, home) == {"a.jsonl": digests(a), "b.jsonl": digests(["three"])}
    made = intake.plans(spark, home)
    assert made.where("action IN ('add', 'retract')").selectExpr("sum(if(action = 'add', 1, -1))").first()[0] == len(a) + 1


def test_dated_logs_of_one_project(spark, tmp_path):
    meta = lambda cwd, sub=None: json.dumps({"type": "session_meta", "payload": {"id": "i", "cwd": cwd, "source": {"subagent": sub} if sub else {}}})
    for name, cwd in (("2026/01/02/rollout-a.jsonl", "/w/p"), ("2026/01/03/rollout-b.jsonl", "/w/p/sub"), ("2026/02/01/rollout-c.jsonl", "/w/pq")):
        write(tmp_path / "sessions" / name, [meta(cwd), "line"])
    write(tmp_path / "sessions/2026/rollout-d.jsonl", [meta("/w/p")])
    pattern = intake.dated_logs(f"file://{tmp_path}")
    assert intake.log_paths(spark, pattern).count() == 3
    stream = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    assert {r.file.rsplit("/", 1)[1] for r in intake.logs_of(stream, "/w/p/").collect()} == {"rollout-a.jsonl", "rollout-b.jsonl"}
    assert intake.log_paths(spark, f"file://{tmp_path}/none/*").collect() == []


def test_lines_of_a_file_in_many_blocks_are_numbered(spark, tmp_path):
    write(tmp_path / "big.jsonl", [f"{i:05d}" for i in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        lines = spark.read.text(f"file://{tmp_path}/*.jsonl").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        assert lines.rdd.getNumPartitions() > 5
        assert intake.placed(lines).where("position <> cast(value AS long)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---------------------------------------------------------------- puts with delays


def replayed(puts, watermark):
    """due, puts of a queue that takes puts (at, seq, delay) in order and gives out a key when its due time has passed."""
    out, due, n = [], None, 0
    for at, _, delay in sorted(puts):
        if due is not None and due <= at:
            out.append((due, n))
            n = 0
        due, n = at + delay, n + 1
    return out + ([(due, n)] if due is not None and due <= watermark else [])


def test_settling_in_any_order_of_arrival_is_the_replay():
    rng = random.Random(4)
    for _ in range(3000):
        puts = [(rng.randrange(40), k, rng.randrange(12)) for k in range(rng.randrange(1, 12))]
        puts += puts[: rng.randrange(3)]
        arrival, open_, done, mark = sorted(puts, key=lambda p: p[0] + rng.randrange(8)), [], [], -1
        seen = -1
        for at, seq, delay in arrival:
            open_.append((at, seq, delay, 0))
            seen = max(seen, at)
            if rng.random() < 0.6:
                mark = max(mark, seen - 8)
                more, open_ = timers.settle(open_, mark)
                done += more
        for mark in range(mark, 60):  # the watermark goes on without input, as timers do
            more, open_ = timers.settle(open_, mark)
            done += more
        assert sorted(done) == sorted(x for x in replayed(puts, 59)) and not open_


def test_puts_over_batches_late_repeated_and_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    base = 1_700_000_000
    puts = [(f"k{rng.randrange(6)}" if rng.random() < 0.95 else None, base + rng.randrange(4000), k, float(rng.choice((0, 2, 8, 600)))) for k in range(160)]
    puts += rng.sample(puts, 10)
    arrival = sorted(puts, key=lambda p: p[1] + rng.randrange(300))
    arrival.append(("late", base, 999, 1.0))  # far behind the watermark by then
    arrival.append(("end", base + 10_000, 1000, 5.0))
    schema = "key string, at long, seq long, delay double"
    for k in range(4):
        cut = arrival[k * len(arrival) // 4 : (k + 1) * len(arrival) // 4]
        cut = [p for p in cut if p[0] not in ("late", "end")] + ([] if k < 3 else [arrival[-2]])
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    spark.createDataFrame([arrival[-1]], schema).coalesce(1).write.parquet(str(tmp_path / "in/4"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withColumn("ts", F.timestamp_seconds("at"))
    for _ in range(2):  # the second run has nothing new and gives nothing again
        out = timers.debounced(src, "key", "ts", "seq", "delay", "300 seconds")
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = {}
    for r in spark.read.parquet(str(tmp_path / "out")).withColumn("due", F.unix_millis("due")).collect():
        found.setdefault(r.key, []).append((r.due, r.puts))
    want = {}
    for key in {p[0] for p in puts}:
        want[key] = replayed([(at * 1000, seq, int(d * 1000)) for k, at, seq, d in puts if k == key], (base + 9700) * 1000)
    assert {k: sorted(v) for k, v in found.items()} == want


def test_last_compaction_of_growing_and_shrinking_logs(spark, tmp_path):
    mark = lambda day: json.dumps({"subtype": "compact_boundary", "timestamp": f"2026-01-{day:02d}T00:00:00Z"})
    log, other, pattern = tmp_path / "l" / "a.jsonl", tmp_path / "l" / "b.jsonl", f"file://{tmp_path}/l/*.jsonl"

    def step():
        intake.catch_up(spark, pattern, str(tmp_path / "home"))
        src = intake.landed(spark, str(tmp_path / "home"))
        rows = []
        query = timers.compaction_times(src).writeStream.foreachBatch(lambda b, i: rows.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.file.rsplit("/", 1)[1]: r["at"] for r in rows}

    day = lambda d: 1767225600.0 + (d - 1) * 86400
    write(log, ["{", mark(3), mark(2), '{"subtype": "compact_boundary"}', '{"subtype": "compact_boundary", "timestamp": "x"}'], -60)
    write(other, ["nothing"], -60)
    assert step() == {"a.jsonl": day(3), "b.jsonl": None}
    assert step() == {}
    write(log, [*log.read_text().splitlines(), "more", mark(1)], -50)  # grew, with an older record
    assert step() == {"a.jsonl": day(3)}
    write(log, [mark(2)], -40)  # written anew, shorter
    assert step() == {"a.jsonl": day(2)}
    write(log, ["x"], -30)
    assert step() == {"a.jsonl": None}
