"""Folders are taken up once, when they are left alone; k-means against the same steps in NumPy."""

import contextlib
import hashlib
import os
import time

import numpy as np
from pyspark.sql import functions as F

from kinetable.operators import clusters
from kinetable.streaming import polling


def put(folder, name, size=3):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(b"x" * size)


def one_partition(inner):
    @contextlib.contextmanager
    def inside(spark):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            with inner(spark):
                yield
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    return inside


def test_units_come_out_once_when_they_rest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(polling, "keeping_lists", one_partition(polling.keeping_lists))  # a store for each partition takes its time
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    put(folder, "step1/a.bin"), put(folder, "step1/b.bin", 5), put(folder, "step2/a.bin")
    handled = []
    q = polling.poll(spark, folder, log, str(tmp_path / "marks"), 1500, lambda df: handled.extend(r["unit"] for r in df.collect()), "300 milliseconds", "*.bin", 1)
    try:
        for k in range(4):  # one that keeps changing doesn't come out
            put(folder, f"step3/{k}.bin", 2)
            time.sleep(0.4)
        polling.wait(q, log, 3, 60)
    finally:
        polling.stop(q)
    rows = {r["unit"]: (r["n_files"], r["bytes"]) for r in polling.done(spark, log).collect()}
    assert rows == {"step1": (2, 8), "step2": (1, 3), "step3": (4, 8)} and sorted(handled) == sorted(rows)
    # another run over the same log, with a new checkpoint and a file that came late: nothing twice
    put(folder, "step1/late.bin"), put(folder, "step4/a.bin")
    q = polling.poll(spark, folder, log + "", str(tmp_path / "marks"), 300, lambda df: handled.extend(r["unit"] for r in df.collect()), "300 milliseconds", "*.bin", 1)
    try:
        polling.wait(q, log, 4, 60)
    finally:
        polling.stop(q)
    assert sorted(handled) == ["step1", "step2", "step3", "step4"]


def test_many_files_are_looked_up_in_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(polling, "keeping_lists", one_partition(polling.keeping_lists))
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(200):
        put(folder, f"step{k % 2}/{k}.bin")
    q = polling.poll(spark, folder, log, str(tmp_path / "marks"), 300, every="300 milliseconds", pattern="*.bin", depth=1)
    try:
        polling.wait(q, log, 2, 60)
    finally:
        polling.stop(q)
    assert {r["unit"]: r["n_files"] for r in polling.done(spark, log).collect()} == {"step0": 100, "step1": 100}
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(str(q.runId)) for s in told.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism


def steps(ids, x, k, passes, rounds):
    u = lambda i, r: (int(hashlib.sha256(f"{i}:{r}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
    c = x[[min(range(len(ids)), key=lambda i: (u(ids[i], 0), ids[i]))]]
    dist = lambda c: ((x[:, None] - c[None]) ** 2).sum(-1)
    for r in range(1, rounds + 1):
        d = dist(c).min(1)
        new = [i for i in range(len(ids)) if d.sum() and u(ids[i], r) < 2.0 * k / d.sum() * d[i]]
        c = np.vstack([c, x[new]])
    n = np.bincount(dist(c).argmin(1), minlength=len(c))
    c = c[np.lexsort((np.arange(len(c)), -n))[:k]]
    for _ in range(passes):
        at = dist(c).argmin(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
    return c, dist(c).argmin(1)


def test_kmeans_is_the_same_steps(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 3)), 3) + rng.integers(0, 5, (400, 1)) * 4.0
    x[50:60] = x[50]  # equal points
    df = spark.createDataFrame([(i, v.tolist(), "q") for i, v in enumerate(x)] + [(None, [0.0, 0.0, 0.0], "n"), (999, None, "n")], "k long, p array<double>, cluster string").repartition(5)
    centres, points = clusters.kmeans(df, "k", "p", 7, passes=4)
    want, at = steps(list(range(400)), x, 7, 4, 3)
    assert np.allclose(centres, want, atol=1e-9)
    assert {r["id"]: r["cluster"] for r in points.collect()} == dict(enumerate(at.tolist()))
    near = {r["cluster"]: r["id"] for r in clusters.representatives(points).collect()}
    assert near == {j: min(np.flatnonzero(at == j), key=lambda i: (round(((x[i] - want[j]) ** 2).sum(), 12), i)) for j in set(at.tolist())}


def test_few_or_no_points(spark):
    same = spark.range(20).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("p"))
    centres, points = clusters.kmeans(same, "id", "p", 5)
    assert centres.tolist() == [[1.0, 2.0]] and {r["cluster"] for r in points.collect()} == {0}
    centres, points = clusters.kmeans(same.where("false"), "id", "p", 5)
    assert not len(centres) and points.count() == 0
