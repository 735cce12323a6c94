"""Operators against small references in NumPy and by hand, and properties that must hold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import codec, geometry, text
from kinetable.operators import joins, metrics, packing, sampling, sequences
from kinetable.operators.assignment import best_assignment
from kinetable.plans import catalogue
from kinetable.sources import manifests, tracks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_assignment_is_least_cost():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        c = rng.random((n, m))
        big = c if n <= m else c.T
        least = min(sum(big[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        pairs = best_assignment(c)
        assert len(pairs) == min(n, m) and abs(sum(c[i, j] for i, j in pairs) - least) < 1e-9
    assert best_assignment(np.zeros((0, 3))) == []


def test_asof_takes_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 40), ("a", 9, 90)], "k string, t long, v long")
    got = rows(joins.asof_join(left, right, ["k"], "t", "v", "m").select("id", "m"), "id")
    assert got == [(1, 50), (2, None), (3, None), (4, 50)]


def test_nearest_within_range(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, "a", 5.0), (3, "a", 20.0)], "id long, k string, t double")
    right = spark.createDataFrame([("a", 0.0, 7), ("a", 2.0, 3), ("a", 5.5, 9)], "k string, t double, v long")
    got = rows(joins.nearest_join(left, right, ["k"], "t", "id", "v", 1.0).select("id", "near_v"), "id")
    assert got == [(1, 3), (2, 9), (3, None)]


def test_islands_merge_and_drop(spark):
    active = [0, 1, 2, 5, 6, 10, 11, 12, 14]
    df = spark.createDataFrame([("u", i, i in active) for i in range(16)], "u string, f long, on boolean")
    got = rows(sequences.islands(df, ["u"], "f", F.col("on"), 2, 3).select("begin", "end"), "begin")
    assert got == [(0, 2), (10, 14)]


def test_evaluation_times_of_short_clips(spark):
    df = spark.createDataFrame([(0, 20), (0, 4), (0, 5)], "a long, b long")
    got = [r[0] for r in df.select(sequences.evaluation_times(F.col("a"), F.col("b"), 3, 3)).collect()]
    assert got == [[2, 9, 17], [2], [2]]


def test_fde_is_at_last_visible_frame(spark):
    df = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 3.0), ("p", 2, None), ("q", 2, 8.0), ("r", 0, None)], "p string, f long, e double")
    r = metrics.trajectory_scores(df, ["p"], "f", "e", ["p"], [2.0, 4.0]).first()
    assert (r["ade"], r["fde"], r["n_clips"]) == (4.0, 5.5, 2) and abs(r["pwt"] - 0.5) < 1e-12
    assert metrics.trajectory_scores(df.where("false"), ["p"], "f", "e", ["p"], [1.0]).first()["ade"] == 0.0


def test_trimmed_mean_needs_five(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 100)] + [("b", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double")
    got = dict(rows(metrics.trimmed_mean(df, ["k"], "v"), "k"))
    x = np.array([1, 2, 3, 4, 100.0])
    assert got["a"] == 26.5 and abs(got["b"] - x[x <= np.percentile(x, 80)].mean()) < 1e-12


def test_perfect_tracks_have_full_hota(spark):
    df = spark.createDataFrame([("v", f, i, i, 1.0) for f in range(4) for i in range(3)], "v string, f long, t long, s long, sim double")
    r = metrics.hota(df, "v", "f", "t", "s", "sim").first()
    assert abs(r["hota"] - 1) < 1e-9 and abs(r["loc_a"] - 1) < 1e-9
    half = df.withColumn("s", F.when(F.col("f") < 2, F.col("s")).otherwise(F.col("s") + 10))
    assert metrics.hota(half, "v", "f", "t", "s", "sim").first()["ass_a"] < 0.6


def test_round_robin_and_shards(spark):
    df = spark.createDataFrame([(c, i) for c, n in (("a", 5), ("b", 1), ("c", 3)) for i in range(n)], "c string, i long")
    got = [(r["c"], r["i"]) for r in sampling.round_robin_pick(df, "c", ["i"], 6).collect()]
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1)]
    s = sampling.shard(df, ["c", "i"], 4)
    assert s.count() == 9 and {r[0] for r in s.select("shard").collect()} == {0, 1, 2, 3}


def test_knapsack_matches_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = [(int(a), int(b)) for a, b in rng.integers(1, 30, (8, 2))]
        chosen = packing.best_subset(sizes, (60, 60))
        best = max((sum(sizes[i][0] for i in s) for k in range(9) for s in itertools.combinations(range(8), k) if sum(sizes[i][0] for i in s) <= 60 and sum(sizes[i][1] for i in s) <= 60))
        assert sum(sizes[i][1] for i in chosen) <= 60 and sum(sizes[i][0] for i in chosen) <= 60
        assert sum(sizes[i][0] for i in chosen) >= 0.8 * best


def test_packed_bins_hold_every_row_once(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") * 37 % 900 + 1).alias("n"), F.lit(1).alias("one"))
    out = packing.knapsack_pack(df, "id", "n", "one", (1024, 8), buffer=16, shards=4).toPandas()
    assert sorted(out["key"]) == list(range(300))
    bins = out.groupby(["shard", "bin"]).agg(a=("a", "sum"), b=("b", "sum"))
    assert bins["a"].max() <= 1024 and bins["b"].max() <= 8


def test_boundaries_are_even():
    assert packing.balanced_boundaries([1] * 8, 4) == [2, 2, 2, 2]
    assert sum(packing.balanced_boundaries([5, 1, 1, 1, 9, 1], 3)) == 6


def test_tracks_text_round_trip(spark):
    df = spark.createDataFrame([(1, 0, 1, 12, -3, 4), (1, 0, 2, 5, 6, 7), (1, 3, 1, 0, 0, 1)], "c long, f long, p long, x long, y long, z long")
    enc = codec.encode_tracks(df, ["c"], "f", "p", ["x", "y", "z"], "cup")
    assert enc.first()["tracks"] == '<tracks coords="0.0 1 12 -3 4 2 5 6 7;3.0 1 0 0 1">cup</tracks>'
    got = rows(codec.decode_tracks(enc, ["c"], "tracks"), "time", "point")
    assert got == [(1, 0.0, 1, 12, -3, 4), (1, 0.0, 2, 5, 6, 7), (1, 3.0, 1, 0, 0, 1)]


def test_damaged_tracks_text(spark):
    texts = ['<tracks coords="0.0 1 x 1 2 3 4;1.0 1 2 3 4">a</tracks> <tracks coords="1.0 9 9 9 9">b</tracks>', '<tracks coords="">n</tracks>', "nothing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert rows(codec.decode_tracks(df, ["i"], "t"), "time") == [(0, 0.0, 1, 2, 3, 4), (0, 1.0, 9, 9, 9, 9)]


def test_rigid_inverse_undoes(spark):
    df = spark.createDataFrame([(0.3, -0.2, 0.9, 0.1, 1.0, 2.0, 3.0, 0.5, -4.0, 0.25)], "w double, x double, y double, z double, a double, b double, c double, p double, q double, r double")
    rot = geometry.quaternion_rotation(*[F.col(c) for c in "wxyz"])
    t, p = [F.col(c) for c in "abc"], [F.col(c) for c in "pqr"]
    back, undo = geometry.rigid_inverse(rot, t)
    got = df.select(*geometry.transform_point(back, undo, geometry.transform_point(rot, t, p))).first()
    assert np.allclose(list(got), [0.5, -4.0, 0.25])


def test_quantize_is_half_even(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (-0.0005,), (-0.0015,)], "v double")
    assert [r[0] for r in df.select(geometry.quantize(F.col("v"))).collect()] == [int(np.rint(v * 1000)) for v in (0.0005, 0.0015, -0.0005, -0.0015)]


def test_time_texts(spark):
    df = spark.createDataFrame([("01:02:03.50",), ("02:03.5",), ("7.25",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(text.parse_time(F.col("s"))).collect()] == [3723.5, 123.5, 7.25, None, None]


def test_manifest_and_key_filter(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"train": [{"file": "a", "num_frames": 9, "fps": 3, "caption": "c", "clips_by_object": {"cup": [[0, 4], [5, 8]], "hand": [[1, 2]]}, "num_clips_total": 3}], "test": [{"file": "b", "num_frames": 3, "clips_by_object": {"x": [[0, 1]]}, "num_clips_total": 1}]}')
    m = manifests.read_manifest(spark, str(tmp_path / "m.json"), dataset="d")
    assert m.count() == 2 and manifests.clips(m).count() == 4
    keys = spark.createDataFrame([("a", ["cup"]), ("b", ["__flat__"])], "file string, keys array<string>")
    got = {r["file"]: (sorted(r["clips_by_object"]), r["num_clips_total"]) for r in manifests.keep_listed_objects(m, keys).collect()}
    assert got == {"a": (["cup"], 2), "b": (["x"], 1)}
    assert manifests.rescale_frames(m, 2).where("file = 'a'").first()["num_frames"] == 5


def test_results_survive_a_cut_line(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"example_id": "e1", "gt_future_raw": [[[0,0,0],[1,0,0]]], "pred_raw_combined": [[[0,0,3],[1,4,0]]], "gt_future_vis": [[true, false]]}\n{"example_id": "e2", "gt_fu')
    r = manifests.read_results(spark, str(tmp_path / "p.jsonl"))
    assert [(x["frame"], x["err"]) for x in manifests.explode_predictions(r).orderBy("frame").collect()] == [(0, 3.0), (1, None)]


def test_track_archives_round_trip(spark, tmp_path):
    p = np.random.default_rng(0).normal(size=(3, 4, 3)).astype(np.float32)
    p[1, 2] = np.nan
    (tmp_path / "in").mkdir()
    np.savez(tmp_path / "in" / "a.npz", points_3d=np.array({"cup": p}, object))
    tracks.register(spark)
    df = spark.read.format("tracks").load(str(tmp_path / "in"))
    assert df.count() == 12 and df.where("not visible").count() == 1 and df.where("x is null").count() == 1
    df.write.format("tracks").mode("append").save(str(tmp_path / "out"))
    again = spark.read.format("tracks").load(str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert spark.read.format("tracks").option("stride", "2").load(str(tmp_path / "in")).count() == 6


def test_unknown_query_and_catalogue():
    with pytest.raises(KeyError):
        catalogue.QUERIES["no_such_query"]
    assert {"traj_score", "asof_price", "tapvid", "encode_tracks", "knapsack_pack", "hota"} <= set(catalogue.QUERIES)
