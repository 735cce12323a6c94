"""Streams give the batch result, and go on where they stopped."""

import pyarrow.parquet as pq

from kinetable.streaming import events

SOURCE = "/root/testdata/sf0.001/events.parquet"


def parts(folder, n, of=4):
    t = pq.read_table(SOURCE)
    size = -(-t.num_rows // of)
    for i in range(n):
        pq.write_table(t.slice(i * size, size), folder / f"part-{i}.parquet")
    return t


def test_dedup_over_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    t = parts(src, 2)
    events.append_to(events.deduplicated(events.read_stream(spark, str(src)), ["event_id"], "400 days"), out, mark)
    first = spark.read.parquet(out).count()
    parts(src, 4)
    pq.write_table(t.slice(0, 50), src / "again.parquet")
    events.append_to(events.deduplicated(events.read_stream(spark, str(src)), ["event_id"], "400 days"), out, mark)
    got = [r[0] for r in spark.read.parquet(out).select("event_id").collect()]
    assert 0 < first < len(got) == len(set(got)) == t.num_rows


def test_packer_state_survives_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in (1, 2):
        parts(src, n, of=8)
        rows = events.read_stream(spark, str(src)).selectExpr("event_id", "event_id % 700 + 1 as n", "1 as one")
        events.append_to(events.packed(rows, "event_id", "n", "one", (1024, 8), buffer=8, shards=2), out, mark)
    got = spark.read.parquet(out).toPandas()
    assert len(got) and got["key"].is_unique
    assert got.groupby(["shard", "bin"])["a"].sum().max() <= 1024
    assert len(got) >= 2 * (-(-spark.read.parquet(SOURCE).count() // 8)) - 2 * 8
