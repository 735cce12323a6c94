"""What the queries' tables don't hold: errors, odd inputs, bounds."""

import io
import math
import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import geometry, masks, points, pointtext, text
from kinetable.operators import decoding, joins, metrics, neighbours, ordering, packing, plugins, recovery, sampling, schedule
from kinetable.sources import files, manifests, pictures, tracks
from kinetable.sources.catalogue import Catalogue, Source
from kinetable.streaming import events


def test_a_miss_is_an_error(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    assert joins.strict_join(left.where("k = 1"), right, ["k"], "v").collect()[0]["v"] == "a"
    with pytest.raises(Exception, match="no match for"):
        joins.strict_join(left, right, ["k"], "v").collect()


def test_mixtures_and_plans_are_checked(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, n long")
    for bad in ({}, {"a": -1.0, "b": 2.0}, {"a": 0.0}):
        with pytest.raises(ValueError, match="manual"):
            sampling.mixture(df, "s", "manual", bad)
    with pytest.raises(Exception, match="no weight for source"):
        sampling.mixture(df, "s", "manual", {"a": 1.0}).collect()
    with pytest.raises(ValueError, match="no mixture"):
        sampling.mixture(df, "s", "other")
    with pytest.raises(ValueError, match="too few"):
        sampling.bucket_plan(df, "s", ["n"], {"a": 2, "b": 2}, strict=True)
    assert sampling.bucket_plan(df, "s", ["n"], {"a": 2, "b": 1}, strict=True).count() == 3


def test_what_isnt_a_number_is_an_error(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="x is not a number"):
        df.agg(metrics.checked(F.avg("x"), "x").alias("m")).collect()
    shapes = spark.createDataFrame([("a", [1, 2]), ("a", [3])], "k string, s array<long>")
    with pytest.raises(Exception, match="2 dimensions"):
        metrics.largest_shapes(shapes, "k", "s", 2).collect()


def test_macro_mean_leaves_out_what_isnt_a_number(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", float("nan")), ("c", 4.0)], "r string, x double")
    got = {r["r"]: r["x"] for r in metrics.record_then_macro(df, "r", ["x"]).collect()}
    assert got["a"] == 2.0 and got["b"] != got["b"] and got[None] == 3.0


def test_archives_run_no_code(tmp_path):
    class Bad:
        def __reduce__(self):
            return (print, ("never",))

    out = io.BytesIO()
    np.savez(out, points_3d=np.array({"a": np.zeros((1, 2, 3), np.float32)}, object))
    assert tracks.load_archive(out.getvalue())["points_3d"].item()["a"].shape == (1, 2, 3)
    evil = io.BytesIO()
    np.savez(evil, points_3d=np.array({"a": Bad()}, object))
    with pytest.raises(pickle.UnpicklingError, match="isn't allowed"):
        tracks.load_archive(evil.getvalue())
    assert zipfile.is_zipfile(io.BytesIO(evil.getvalue()))


def test_missing_arrays_give_no_rows(spark, tmp_path):
    np.savez(tmp_path / "a.npz", other=np.zeros(3))
    assert tracks.read_tracks(spark, str(tmp_path)).count() == 0
    with pytest.raises(KeyError, match="no source"):
        Catalogue(Source("a", "NO_SUCH_VARIABLE", str(tmp_path))).scan(spark, ["b"])


def test_source_roots_come_from_the_environment(monkeypatch):
    s = Source("a", "KINETABLE_TEST_ROOT", "/default")
    assert s.root == "/default"
    monkeypatch.setenv("KINETABLE_TEST_ROOT", "/other")
    assert s.root == "/other"
    with pytest.raises(ValueError, match="exists"):
        Catalogue(s, s)


def test_places_in_a_global_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("x").alias("_at"))
    got = ordering.global_position(df.drop("_at"), ["k"], "place").collect()
    assert all(r["k"] == r["place"] for r in got) and len(got) == 1000
    assert ordering.global_position(df.drop("_at").where("false"), ["k"], "place").count() == 0


def test_ranges_give_what_windows_give(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 500).alias("k"), (F.col("id") % 11).alias("n")).repartition(3)
    calls = {
        "sum": lambda: ordering.running_sum(df, ["g"], ["k"], F.col("n"), "at"),
        "chunks": lambda: sampling.full_chunks(df, "g", "k", 8),
        "shard": lambda: sampling.shard(df, ["k"], 4, ["g"]),
        "strided": lambda: sampling.strided_rows(df, "g", "k", 8),
        "parts": lambda: sampling.equal_parts(df, "g", "k", 7, "part"),
        "segments": lambda: packing.segments(df, ["g"], ["k"], "n", 64),
    }
    rows = lambda c: sorted(str(sorted(r.asDict().items())) for r in c().collect())
    want = {n: rows(c) for n, c in calls.items()}
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 10)
    assert {n: rows(c) for n, c in calls.items()} == want


def test_descendants_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(50, 1000), (200, 150)], "parent long, child long")
    got = schedule.descendants(edges, spark.createDataFrame([(0,), (199,)], "root long")).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in got} == {0: 202, 199: 51}  # the ring 150..200 closes


def test_endless_places_are_permutations():
    with pytest.raises(ValueError, match="common divisor"):
        schedule.endless_place(None, 14, 7, 1)


def test_samplers_on_known_scores(spark):
    df = spark.createDataFrame([(1, "a", math.log(0.5)), (1, "b", math.log(0.3)), (1, "c", math.log(0.2))], "c long, t string, l double")
    top = {r["t"]: round(np.exp(r["l"]), 6) for r in decoding.top_k(df, ["c"], "t", "l", 2).collect()}
    assert top == {"a": 0.625, "b": 0.375}
    assert decoding.multinomial_pick(df, ["c"], "t", "l", F.lit(0.75)).first()["t"] == "b"
    many = spark.range(4000).select(F.col("id").alias("c")).crossJoin(df.select("t", "l"))
    picks = decoding.gumbel_pick(many, ["c"], "t", "l", sampling.mixed(F.col("c") * 31 + F.ascii("t") * 977, 3)).groupBy("t").count().collect()
    share = {r["t"]: r["count"] / 4000 for r in picks}
    assert abs(share["a"] - 0.5) < 0.05 and abs(share["c"] - 0.2) < 0.05


def test_no_ngram_twice(spark):
    steps = spark.createDataFrame([("a", "b", -0.1), ("b", "a", -0.1), ("a", "c", -2.0), ("c", "a", -2.0), ("b", "c", -3.0)], "token string, next string, logp double")
    start = spark.createDataFrame([("x", "a")], "id string, token string")
    best = decoding.beam_search(start, steps, 3, 4, (decoding.no_repeated_ngrams(2),)).orderBy(F.desc("score")).first()["beam"]
    pairs = list(zip(best, best[1:], strict=False))
    assert len(pairs) == len(set(pairs))


def test_items_beyond_the_limits_have_bins_of_their_own(spark):
    df = spark.createDataFrame([(1, 100, 1), (2, 5000, 1), (3, 900, 1), (4, 1000, 1)], "k long, a long, b long")
    got = packing.knapsack_pack(df, "k", "a", "b", (1000, 16)).toPandas()
    assert sorted(zip(got["key"], got["a"], strict=True)) == [(1, 100), (2, 5000), (3, 900), (4, 1000)]
    assert (got.groupby(["shard", "bin"])["key"].transform("size")[got["key"] == 2] == 1).all()


def test_waiting_rows_come_out_at_the_end(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 50 + 1).alias("n_chars")).write.parquet(str(tmp_path / "documents"))
    s = events.read_stream(spark, str(tmp_path / "documents"), "documents").withColumn("one", F.lit(1))
    got = events.packed_table(s, "doc_id", "n_chars", "one", (64, 8)).toPandas()
    assert sorted(got["key"]) == list(range(100)) and got.groupby(["shard", "bin"])["a"].sum().max() <= 64


def test_caches_are_bounded():
    closed, c = [], recovery.BoundedCache(2, None)
    c.close = closed.append
    assert [c.get(k, lambda k=k: k * 10) for k in (1, 2, 1, 3, 1)] == [10, 20, 10, 30, 10] and closed == [10, 20]


def test_registry_says_what_there_is():
    r = plugins.Registry()
    r.add("sampler", "a")(1)
    with pytest.raises(ValueError, match="exists"):
        r.add("sampler", "a")(2)
    with pytest.raises(KeyError, match="there are"):
        r.get("sampler", "b")


def test_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(360_100.0, 1000, 7)], "s double, x long, y long")
    r = df.select(text.format_time(F.col("s")).alias("t"), text.at_least(F.col("x").cast("string"), 3).alias("x"), text.at_least(F.col("y").cast("string"), 3).alias("y")).first()
    assert tuple(r) == ("100:01:40.00", "1000", "007")


def test_odd_point_texts(spark):
    df = spark.createDataFrame([("nothing",), ("",), (None,), ("Click(1.0, 200.0)",), ("x Click(50.0,25.0) 1 500 250",)], "s string")
    got = [r[0] for r in df.select(pointtext.read_points(F.col("s"), F.lit(100.0), F.lit(100.0))).collect()]
    assert got[0] == [] and got[1] == [] and got[3] == [] and [tuple(p) for p in got[4]] == [(50.0, 25.0)]
    broken = df.select(pointtext.read_timed_points(F.lit("<points 1.0 1 2 />"), F.lit(1.0), F.lit(1.0)).alias("p")).first()["p"]
    assert broken is None
    assert df.select(points.frame_time(F.lit(30), F.lit(0))).schema  # lazily checked
    with pytest.raises(Exception, match="positive"):
        df.select(points.frame_time(F.lit(30), F.lit(0)).alias("t")).collect()


def test_pictures_and_ranges(spark, tmp_path):
    p = np.arange(12).reshape(3, 4)
    assert (pictures.grey(pictures.png(p)) == p).all()
    with pytest.raises(ValueError, match="no PNG"):
        pictures.grey(b"GIF89a..........")
    (tmp_path / "f.bin").write_bytes(bytes(range(256)))
    assert files.byte_range(spark, str(tmp_path / "f.bin"), 250, 4) == bytes([250, 251, 252, 253])
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "there"

    assert files.retried(flaky, wait=0.0) == "there"
    with pytest.raises(ZeroDivisionError):
        files.retried(lambda: 1 / 0, wait=0.0)


def test_summary_mark_goes_with_what_isnt_complete(spark, tmp_path):
    folder = str(tmp_path)
    files.write_summary(spark, folder, {"n": 1}, True)
    assert files.exists(spark, f"{folder}/DONE")
    files.write_summary(spark, folder, {"n": 2}, False)
    assert not files.exists(spark, f"{folder}/DONE") and '"n": 2' in (tmp_path / "summary.json").read_text()


def test_surfaces_hold_their_points(spark):
    df = spark.range(500).select(*[sampling.uniform(F.col("id") * k, s).alias(n) for k, s, n in ((3, 1, "u"), (5, 2, "v"), (7, 3, "w"))])
    size = [F.lit(2.0), F.lit(1.5), F.lit(3.0)]
    at = lambda kind: np.array([tuple(r) for r in df.select(*geometry.surface_point(F.lit(kind), size, F.col("u"), F.col("v"), F.col("w"))).collect()])
    assert np.allclose(np.sqrt((at("sphere") ** 2).sum(1)), 2)
    box = np.abs(at("box")) / [2, 1.5, 3]
    assert (box <= 1 + 1e-9).all() and np.allclose(box.max(1), 1)
    tube = at("cylinder")
    r = np.hypot(tube[:, 0], tube[:, 1])
    assert ((np.abs(r - 2) < 1e-9) | (np.abs(np.abs(tube[:, 2]) - 1.5) < 1e-9)).all()
    cap = at("capsule")
    past = np.maximum(np.abs(cap[:, 2]) - 1.5, 0)
    assert np.allclose(np.sqrt(cap[:, 0] ** 2 + cap[:, 1] ** 2 + past**2), 2)
    assert np.allclose(((at("ellipsoid") / [2, 1.5, 3]) ** 2).sum(1), 1)


def test_masks_of_polygons(spark):
    square = F.array(*[F.lit(float(v)) for v in (1, 1, 4, 1, 4, 3, 1, 3)])
    mask = np.array(spark.range(1).select(masks.polygon_mask(square, 5, 6)).first()[0]).reshape(5, 6)
    assert mask.sum() == 6 and mask[1:3, 1:4].all()


def test_neighbours_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 200)  # four queries
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(60, 5)), 1)
    x[40:50] = x[0]  # equal rows: the smaller key comes first
    df = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (None, [0.0] * 5), (99, None)], "id long, v array<double>").repartition(3)
    got = {(r["q"], r["n"]): r["id"] for r in neighbours.nearest_rows(df.where("id % 5 = 0"), df, "id", "v", 3).collect()}
    for q in range(0, 60, 5):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [got[q, n] for n in (1, 2, 3)] == np.argsort(d, kind="stable")[:3].tolist()
    assert neighbours.nearest_rows(df.where("false"), df, "id", "v", 3).count() == 0


def test_nearest_over_many_batches(monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    r = np.random.default_rng(5)
    x, ids = r.integers(-2, 3, (500, 3)).astype(float), r.permutation(500)  # many ties
    best = neighbours.Nearest(ids[:40], x[:40], 6)
    for a in range(0, 500, 33):
        best.add(ids[a : a + 33], x[a : a + 33])
    q, d, found = best.found
    for i in range(40):
        own = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, own)) if j != i][:6]
        assert found[q == i].tolist() == ids[order].tolist() and np.allclose(d[q == i], own[order])


def test_nested_names_and_alias(spark, tmp_path):
    spark.createDataFrame([('{"task": 1, "action": "go"}',), ('{"task": 2, "language_instruction": "stop"}',)], "value string").write.text(str(tmp_path / "t"))
    assert sorted(map(tuple, manifests.task_list(spark, str(tmp_path / "t")).collect())) == [(1, "go"), (2, "stop")]
