"""Files are written one at a time where they are made, and small files are read many to a task."""

import numpy as np
import pyarrow as pa
import pytest

from kinetable.sources import files, tracks, video
from kinetable.storage import OPEN_COST, ship


def test_one_content_at_a_time_and_in_the_task_that_makes_it(spark, tmp_path):
    def make(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield f"d{i % 2}/f{i}", b"%d" % i
                with open(f"{tmp_path}/out/d{i % 2}/f{i}", "rb") as f:  # it is there before the next is made
                    assert f.read() == b"%d" % i

    files.write_made(spark.range(0, 25, 1, 3).select("id"), f"{tmp_path}/out", make)
    assert sorted(r["path"] for r in files.directory(spark, f"{tmp_path}/out").collect()) == sorted(f"d{i % 2}/f{i}" for i in range(25))
    with pytest.raises(pa.ArrowInvalid):
        files.write_made(spark.range(1), "nowhere://x/y", make)


def test_videos_and_cuts_hold_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "write_files", None)  # contents cross to no second worker
    rows = [(f"v{v}.mp4", i, 10, 0, i % 5 == 0, bytes([v] * (3 + i))) for v in range(7) for i in reversed(range(12))]
    df = spark.createDataFrame(rows, "file string, place int, lasts int, later int, key boolean, data binary").repartition(4)
    folder = video.write_videos(df, f"{tmp_path}/v")
    got = video.read_videos(spark, folder).toPandas().sort_values(["file", "frame"])
    assert got["size"].tolist() == [3 + i for _ in range(7) for i in range(12)]
    ranges = spark.createDataFrame([(f"v{v}.mp4", 2, 9, f"v{v}.mp4") for v in range(7)], "file string, first int, last int, path string")
    cut = video.read_videos(spark, video.trim_videos(spark, folder, ranges, f"{tmp_path}/t"))
    assert cut.count() == 7 * 8 and np.isclose(cut.agg({"end": "max"}).first()[0], 0.08)


def test_small_archives_are_read_many_to_a_task(spark, tmp_path):
    ship(spark)
    n = 200
    rows = spark.range(n).selectExpr("concat('a', id, '.npz') as file", f"'{tracks.FLAT}' as obj", "0 as point_id", "0 as frame", "double(id) as x", "1d as y", "1d as z", "true as visible")
    back = tracks.read_tracks(spark, tracks.write_tracks(rows, f"{tmp_path}/a"))
    assert back.count() == n and int(spark.conf.get(OPEN_COST).rstrip("b")) < 1 << 20
    assert back.rdd.getNumPartitions() <= 4  # seven at 4 MB a file


def test_small_archives_cost_no_batch_each():
    b = lambda i, n: tracks.track_batch(f"f{i}", "o", np.full((n, 1, 3), i, np.float32), None)
    parts = [b(i, i % 4) for i in range(40)]
    got = list(tracks.joined(iter(parts), 25))
    assert len(got) <= 3 and pa.Table.from_batches(got).equals(pa.Table.from_batches(parts).combine_chunks())
    assert list(tracks.joined(iter([]))) == []
