"""Schedules, point texts, masks and archives."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import masks, points
from kinetable.operators import schedule
from kinetable.sources import archives


def test_epochs_are_permutations(spark):
    e = schedule.epoch_order(spark.range(50), "id", 3, seed=1).toPandas()
    assert e.groupby("epoch")["id"].nunique().tolist() == [50] * 3 and e.groupby("epoch")["place"].max().tolist() == [49] * 3
    a, b = (e[e["epoch"] == k].sort_values("place")["id"].tolist() for k in (0, 1))
    assert a != b


def test_draws_follow_rates(spark):
    rates = {"a": 5.0, "b": 3.0, "c": 2.0}
    m = schedule.multinomial_draws(spark, rates, 4000, 1).groupBy("source").count().toPandas().set_index("source")["count"]
    assert abs(m["a"] - 2000) < 200 and m.sum() == 4000
    s = schedule.stratified_draws(spark, rates, 200).toPandas().sort_values("position")
    assert s["position"].tolist() == list(range(200))
    for n in range(1, 201):
        seen = s["source"].iloc[:n].value_counts()
        assert all(abs(seen.get(k, 0) - n * r / 10) <= 1.5 for k, r in rates.items())


def test_every_position_has_one_owner(spark):
    df = spark.range(64).withColumnRenamed("id", "position")
    rank, worker = schedule.owner(F.col("position"), 2, 2, 4)
    got = df.select(rank.alias("r"), worker.alias("w")).groupBy("r", "w").count().collect()
    assert sorted((r["r"], r["w"], r["count"]) for r in got) == [(0, 0, 16), (0, 1, 16), (1, 0, 16), (1, 1, 16)]


def test_weighted_choice_picks_by_cdf(spark):
    df = spark.createDataFrame([("g", 0, 0.0), ("g", 1, 1.0), ("g", 2, 3.0)], "g string, i long, w double")
    pick = lambda u: schedule.weighted_choice(df, ["g"], "i", "w", F.lit(u)).first()["i"]
    assert [pick(u) for u in (0.0, 0.2, 0.25, 0.99)] == [1, 1, 2, 2]


def test_rollout_feeds_back(spark):
    start = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "key long, history array<double>")
    step = lambda df: df.select("key", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at("history", -1) + i).alias("future"))
    assert schedule.rollout(start, step, 3, 2, 3).first()["kept"] == [4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_descendants(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (9, 8)], "parent long, child long")
    got = schedule.descendants(edges, spark.createDataFrame([(1,), (9,)], "root long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (1, 3), (1, 4), (9, 8), (9, 9)]


def test_resample_like_numpy(spark):
    t, v = [0.0, 1.0, 3.0], [0.0, 10.0, 30.0]
    df = spark.createDataFrame([("k", a, b) for a, b in zip(t, v, strict=True)], "k string, t double, v double")
    at = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 4.0]
    got = schedule.resample(df, ["k"], "t", "v", spark.createDataFrame([("k", a) for a in at], "k string, at double"), "at").orderBy("at").collect()
    assert np.allclose([r["v"] for r in got], np.interp(at, t, v))


def test_points_round_trip(spark):
    df = spark.createDataFrame([(1, 0, 7, 12, 999), (1, 0, 5, 5, 6), (1, 2, 7, 500, 40)], "c long, f long, p long, x int, y int")
    enc = points.encode_points(df, ["c"], "f", "p", "x", "y", "cup")
    assert enc.first()["points"] == '<points coords="0 1 005 006 2 012 999;2 2 500 040">cup</points>'
    got = points.decode_points(enc, ["c"], "points").orderBy("time", "id").collect()
    assert [tuple(r)[1:] for r in got] == [(0.0, 1, 5, 6), (0.0, 2, 12, 999), (2.0, 2, 500, 40)]


def test_other_point_texts(spark):
    df = spark.createDataFrame([(1, "time 0.50\n{0: [52.4, 40.7, yes], 1: [1, 2]}"), (2, "0: ([1,2,0.5],[3,4,1.5]) 1: ([101,2,0],[5,5,1])")], "i long, t string")
    got = sorted(tuple(r) for r in points.frame_points(df, ["i"], "t").collect())
    assert got == [(1, 0.5, 0, 52.4, 40.7, False), (1, 0.5, 1, 1.0, 2.0, True)]
    got = sorted(tuple(r) for r in points.start_end_points(df, ["i"], "t").collect())
    assert got == [(2, 0, 0, 1.0, 2.0, 0.5), (2, 0, 1, 3.0, 4.0, 1.5), (2, 1, 1, 5.0, 5.0, 1.0)]


def test_names_and_prefixes(spark):
    df = spark.createDataFrame([("trajectory_3d_x_p8_h3_f30", 1.25), ("trajectory_3d_p8", 0.05)], "n string, s double")
    got = [tuple(r[0]) for r in df.select(points.dataset_parameters(F.col("n"))).collect()]
    assert got == [(8, 3, 30), (None, None, None)]
    assert [r[0] for r in df.select(points.frame_prefix("time2", F.lit(1), F.col("s"))).collect()] == ["time 1.25", "time 0.05"]


def test_masks(spark):
    assert masks.decode_rle([1, 2, 3], 3, 2).tolist() == [[False, False], [True, False], [True, False]]
    df = spark.createDataFrame([([1, 2, 3], 3, 2, x, y) for x, y in ((0.0, 1.0), (0.2, 0.4), (1.0, 2.0), (5.0, 1.0))], "c array<int>, h int, w int, x double, y double")
    assert [r[0] for r in df.select(masks.point_in_mask("c", "h", "w", "x", "y")).collect()] == [True, False, False, False]


def test_tar_members(spark, tmp_path):
    for name, n in (("a", 3), ("b", 1)):
        with tarfile.open(tmp_path / f"{name}.tar", "w") as t:
            for i in range(n):
                info = tarfile.TarInfo(f"img-{i:04d}.jpg")
                info.size = 2
                t.addfile(info, io.BytesIO(b"xy"))
    (tmp_path / "c.tar").write_bytes(b"broken")
    with pytest.raises(Exception, match="c.tar"):  # a broken archive is an error unless it may be skipped
        archives.tar_members(spark, str(tmp_path)).collect()
    m = archives.tar_members(spark, str(tmp_path), broken="skip")
    assert sorted(map(tuple, archives.number_of_frames(m).collect())) == [("a.tar", 3), ("b.tar", 1)]


def test_reports(spark):
    assert archives.text_table([{"name": "x", "ade": 0.5}]) == "name  ade\nx     0.500"
    assert "<td>&lt;b&gt;</td>" in archives.html_table(spark.createDataFrame([("<b>",)], "a string"))
