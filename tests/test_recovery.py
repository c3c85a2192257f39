"""Commit log, mergeable summaries, keyed state and copies: each broken off at every step and run again."""

import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.shared import new_dir
from corpusmill.sources import copying
from corpusmill.streaming import stateful, stream
from corpusmill.streaming.commitlog import CommitLog, committed
from corpusmill.streaming.partials import Summary, summarised

SCHEMA = "id long, k string, x double"
STEPS = ("begun", "staged", "written", "committed")


class Broken(Exception):
    pass


def breaker(step, times=1):
    left = [times]

    def hook(at):
        if at == step and left[0]:
            left[0] -= 1
            raise Broken(step)

    return hook


def source(spark, path, files=4, rows=50):
    for i in range(files):
        spark.range(i * rows, (i + 1) * rows).selectExpr("id", "CAST(id % 3 AS STRING) AS k", "CAST(id AS DOUBLE) AS x").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("step", STEPS)
def test_broken_appends(spark, step):
    root = new_dir(spark, "log")
    log = CommitLog(spark, root, breaker(step))
    assert log.progress() == (-1, 0) and log.read("id long").count() == 0
    assert CommitLog(spark, root).append(spark.range(5), 0)
    with pytest.raises(Broken):
        log.append(spark.range(5, 12), 1)
    assert log.progress() == ((1, 12) if step == "committed" else (0, 5))  # there is always a record of progress
    log.append(spark.range(5, 12), 1)
    assert not log.append(spark.range(100), 1)
    assert sorted(r.id for r in log.read("id long").collect()) == list(range(12)) and log.progress() == (1, 12)
    log.tidy()
    assert log.tidy() == 0 and log.read("id long").count() == 12


@pytest.mark.parametrize("step", STEPS)
def test_broken_stream(spark, step):
    place = new_dir(spark, "stream")
    source(spark, f"{place}/in")
    like = spark.read.parquet(f"{place}/in")
    log, calls = CommitLog(spark, f"{place}/out", breaker(step)), 0
    while True:
        calls += 1
        try:
            committed(stream.read_stream(spark, f"{place}/in", like, 1), log, f"{place}/state").awaitTermination()
            break
        except Exception:
            assert calls < 5
    assert calls == 2 and sorted(r.id for r in log.read(SCHEMA).collect()) == list(range(200)) and log.progress() == (3, 200)


def test_summary(spark):
    """The state alone is read again: earlier rows may be gone."""
    place = new_dir(spark, "stream")
    source(spark, f"{place}/in", files=5)
    log, state = CommitLog(spark, f"{place}/out"), CommitLog(spark, f"{place}/sums", breaker("staged"))
    spec = {"n": ("count", F.lit(1)), "total": ("sum", F.col("x")), "least": ("min", F.col("id")), "most": ("max", F.col("id")), "mean": ("mean", F.col("x"))}
    summary = Summary(state, ["k"], spec)
    assert summary.now() is None
    like = spark.read.parquet(f"{place}/in")
    for _ in range(2):
        try:
            summarised(stream.read_stream(spark, f"{place}/in", like, 1), log, summary, f"{place}/state").awaitTermination()
        except Exception:
            pass
    want = like.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("id").alias("least"), F.max("id").alias("most"), F.avg("x").alias("mean"))
    assert sorted(map(tuple, summary.now().collect())) == sorted(map(tuple, want.collect()))
    folders = [r.folder for r in state.entries().collect()]
    sizes = [sum(os.path.getsize(f"{place}/sums/{f}/{n}".replace("file:", "")) for n in os.listdir(f"{place}/sums/{f}".replace("file:", "")) if n.endswith(".parquet")) for f in folders]
    assert len(sizes) == 5 and max(sizes) < 2 * min(sizes)


def plain_windows(rows, size, idle, watermark):
    by, out = defaultdict(list), set()
    for r in sorted(rows, key=lambda r: (r.ts, r.id)):
        by[r.k].append((int(r.ts.timestamp() * 1000), r.x))
    for key, own in by.items():
        held, total = [], 0.0
        for i, (ms, x) in enumerate(own):
            held, total = [*held, x], total + x
            pause = own[i + 1][0] - ms > idle if i + 1 < len(own) else ms + idle < watermark
            if len(held) == size or pause:
                out.add((key, i + 1, len(held), round(sum(held) / len(held), 6), round(total / (i + 1), 6)))
                held = []
    return out


def test_keyed_state(spark):
    """In two runs of several batches, with pauses inside and between batches: as the batch version says."""
    place, size, idle = new_dir(spark, "stream"), 20, 3_600_000
    every = spark.range(160).selectExpr("id", "CAST(id % 3 AS STRING) AS k", "CAST(id * id % 101 AS DOUBLE) AS x", "timestamp_seconds(1700000000 + id * 60 + CASE WHEN id > 40 THEN 9000 ELSE 0 END + CASE WHEN id > 100 THEN 20000 ELSE 0 END) AS ts")
    like = every.limit(0)
    for low, high in ((0, 70), (70, 110), (110, 160)):
        every.filter(f"id >= {low} AND id < {high}").coalesce(1).write.mode("append").parquet(f"{place}/in")
        if low != 70:
            with stateful.rocksdb(spark):
                out = stateful.step_windows(stream.read_stream(spark, f"{place}/in", like, 1), "k", "ts", "id", "x", size, idle, "0 seconds")
                stream.to_table(out, f"{place}/out", f"{place}/state").awaitTermination()
    rows = every.collect()
    got = {(r.key, r.n, r.window_n, round(r.window_mean, 6), round(r.mean, 6)) for r in spark.read.parquet(f"{place}/out").collect()}
    assert got == plain_windows(rows, size, idle, max(int(r.ts.timestamp() * 1000) for r in rows)) and any(n < size for _, _, n, _, _ in got)


def tree(root, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)


@pytest.mark.parametrize("step", STEPS)
def test_copies(spark, tmp_path, step, monkeypatch):
    files = {f"a/b{i}/f{i}.bin": bytes([i]) * (i * 1000) for i in range(7)} | {"top.txt": b"x", "a/none": b""}
    tree(tmp_path / "from", files)
    with pytest.raises(Broken):
        copying.copy_tree(spark, str(tmp_path / "from"), str(tmp_path / "to"), hook=breaker(step))
    got = {r.name: (r.length, r.sha256) for r in copying.copy_tree(spark, str(tmp_path / "from"), str(tmp_path / "to")).collect()}
    assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in files.items()}
    assert all((tmp_path / "to" / n).read_bytes() == x for n, x in files.items())
    tree(tmp_path / "from", {"top.txt": b"longer"})
    log = CommitLog(spark, f"{tmp_path}/to/.manifest")
    before = log.progress()[1]
    copying.copy_tree(spark, str(tmp_path / "from"), str(tmp_path / "to"))
    assert log.progress()[1] == before + 1 and (tmp_path / "to/top.txt").read_bytes() == b"longer"
