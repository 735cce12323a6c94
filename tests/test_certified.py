"""Matchings with their proof, the buffered packer against all choices, its state over a kill, runs without empty ranks."""

import itertools
import os
import time

import numpy as np
from pyspark.sql import functions as F

from kinetable.operators import assignment, packing
from kinetable.operators.packing import Limit
from kinetable.streaming import events


def test_prices_prove_the_least_cost():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = (int(x) for x in rng.integers(1, 7, 2))
        c = rng.integers(-3, 4, (n, m)).astype(float) if rng.random() < 0.5 else rng.random((n, m))
        pairs, u, v = assignment.priced_assignment(c)
        slack = c - u[:, None] - v[None, :]
        assert slack.min() >= -1e-9 and all(abs(slack[i, j]) < 1e-9 for i, j in pairs)
        total = sum(c[i, j] for i, j in pairs)
        assert abs(u.sum() + v.sum() - total) < 1e-9
        big = c if n <= m else c.T
        assert abs(total - min(sum(big[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))) < 1e-9


def test_a_worse_matching_has_no_certificate(spark):
    rows = [("a", i, j, float(abs(i - j) + (i == 2))) for i in range(3) for j in range(4)] + [("b", 0, 0, None), ("c", 0, None, 1.0), ("d", 5, 6, 2.5)]
    got = assignment.assigned(spark.createDataFrame(rows, "f string, t long, s long, c double"), ["f"], "t", "s", "c")
    by = {r["f"]: r for r in assignment.certificate(got, ["f"]).collect()}
    assert set(by) == {"a", "d"} and all(r["feasible"] and r["tight"] for r in by.values())
    assert by["a"]["cost"] == by["a"]["price"] == 1.0 and by["a"]["n_pairs"] == 3 and by["d"]["cost"] == 2.5
    other = got.withColumn("taken", F.when(F.col("f") == "a", F.col("said_id") == (F.col("true_id") + 1)).otherwise(F.col("taken")))
    r = {x["f"]: x for x in assignment.certificate(other, ["f"]).collect()}["a"]
    assert r["feasible"] and not r["tight"] and r["cost"] > r["price"]
    cheap = got.withColumn("cost", F.when((F.col("true_id") == 0) & (F.col("said_id") == 3), -9.0).otherwise(F.col("cost")))
    assert not {x["f"]: x for x in assignment.certificate(cheap, ["f"]).collect()}["a"]["feasible"]


def test_choices_are_best_and_of_equals_the_earliest():
    rng = np.random.default_rng(1)
    for _ in range(120):
        items = [(int(a), int(b)) for a, b in rng.integers(0, 9, (7, 2))]
        limits = Limit(int(rng.integers(3, 30)), 1.0, int(rng.integers(1, 4))), Limit(int(rng.integers(3, 20)), float(rng.integers(0, 3)))
        worth, least = -1.0, 0
        for mask in range(1 << len(items)):
            own = [items[i] for i in range(len(items)) if mask >> i & 1]
            if all(sum(w.units(x[k]) for x in own) <= w.room() for k, w in enumerate(limits)):
                v = sum(x[0] * limits[0].worth + x[1] * limits[1].worth for x in own)
                if v > worth:
                    worth, least = v, mask
        assert sum(1 << i for i in packing.best_choice(items, limits)) == least
    many = [(1, 1)] * 70  # more items than a word has bits
    assert packing.best_choice(many, (Limit(66), Limit(100))) == list(range(66))


def test_items_at_a_limit_leave_alone():
    p = packing.BufferedPacker((Limit(10, alone=True), Limit(5)), 2)
    assert p.add("a", 10, 1) == [("a", 10, 1)] and p.add("b", 4, 1) is None and p.add("c", 7, 1) is None
    assert p.add("d", 6, 1) == [("c", 7, 1)] and [x[0] for x in p.take()] == ["b", "d"] and not p.held


def test_no_rank_is_empty_while_there_are_items():
    assert packing.balanced_boundaries([1, 10, 1, 1], 4) == [1, 1, 1, 1]
    assert packing.balanced_boundaries([100, 1, 1, 1, 1], 3) == [1, 1, 3]
    assert packing.balanced_boundaries([1, 1, 1, 100], 3) == [2, 1, 1] and packing.balanced_boundaries([5], 3)[::-1].count(0) == 2
    rng = np.random.default_rng(2)
    for _ in range(300):
        counts, ranks = [int(x) for x in rng.integers(1, 50, rng.integers(1, 9)) ** 2], int(rng.integers(1, 7))
        n = packing.balanced_boundaries(counts, ranks)
        assert sum(n) == len(counts) and sum(x > 0 for x in n) == min(ranks, len(counts))


def sizes(spark, folder, begin, end):
    rows = spark.range(begin, end).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") * 37 % 50 + 1).alias("n_chars"))
    rows.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return events.read_stream(spark, folder, "documents", files_per_trigger=1000).withColumn("one", F.lit(1))


LIMITS = (Limit(100), Limit(4, 0.0))


def test_a_kill_between_batches_changes_nothing(spark, tmp_path):
    src, marks, out = (str(tmp_path / n) for n in ("in", "marks", "out"))
    run = lambda: events.append_to(events.packed(stream(spark, src), "doc_id", "n_chars", "one", LIMITS, 5, 2, growing=True), out, marks)
    for k, (a, b) in enumerate([(0, 40), (40, 90), (20, 130)]):  # the last wave has rows again
        sizes(spark, src, a, b)
        run()
        if k == 1:  # the batch's mark isn't there, as after a kill: it runs again
            mark = max((tmp_path / "marks" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            os.remove(mark)
            (mark.parent / f".{mark.name}.crc").unlink(missing_ok=True)
            run()
    got = spark.read.parquet(out).unionByName(events.drained(spark, marks, LIMITS, 5)).toPandas()
    once = packing.knapsack_pack(spark.range(130).selectExpr("id", "id * 37 % 50 + 1 as n", "1 as one"), "id", "n", "one", LIMITS, 5, 2).toPandas()
    key = lambda df: sorted(map(tuple, df[["shard", "bin", "place", "key", "a"]].values.tolist()))
    assert key(got) == key(once)
    last = {r["shard"]: r["last"] for r in events.state_of(spark, marks, "last").collect()}
    assert last == {0: 128, 1: 129}


def test_idle_shards_let_go_of_what_waits(spark, tmp_path):
    src = str(tmp_path / "in")
    sizes(spark, src, 0, 12)
    seen = []
    with events.keeping_lists(spark):
        s = events.packed(stream(spark, src), "doc_id", "n_chars", "one", LIMITS, 20, 2, idle=300)
        q = s.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "marks")).trigger(processingTime="200 milliseconds").foreachBatch(lambda df, n: seen.extend(r["key"] for r in df.collect())).start()
        end = time.time() + 60
        while len(seen) < 12 and time.time() < end:
            time.sleep(0.3)
        q.stop()
    assert sorted(seen) == list(range(12))
