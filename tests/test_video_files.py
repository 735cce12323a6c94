"""Video files made byte by byte, cuts against all frames, and writers that know where they write."""

import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.sources import files, stores, video


def box(kind, *parts, long=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if long else struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, version, *parts):
    return box(kind, struct.pack(">I", version << 24), *parts)


def foreign():
    """A file of another make: a sound track first, 64-bit sizes, a movie clock of its own, several runs of chunks, no list of keys, an empty edit."""
    size = [5, 3, 8, 1, 2, 7, 4]
    start = 32 + 16  # after a kind of 24 bytes, a free box of 8, a large head
    gap = 10
    places = [start, start + 5 + 3 + 8 + gap, start + 16 + gap + 3]
    data = bytes(range(16)) + b"-" * gap + b"abc" + b"defghijklmn"
    table = box(
        b"stbl", full(b"stsd", 0, struct.pack(">I", 0)), full(b"stts", 0, struct.pack(">IIIII", 2, 3, 20, 4, 30)), full(b"ctts", 0, struct.pack(">IIIIIII", 3, 1, 40, 2, 10, 4, 40)),
        full(b"stsc", 0, struct.pack(">IIIIIIIIII", 3, 1, 3, 1, 2, 2, 1, 3, 2, 1)), full(b"stsz", 0, struct.pack(">II7I", 0, 7, *size)), full(b"co64", 0, struct.pack(">IQQQ", 3, *places)),
    )
    media = box(b"mdia", full(b"mdhd", 1, struct.pack(">QQIQI", 0, 0, 600, 180, 0)), full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"name\0"), box(b"minf", box(b"vmhd"), table))
    edits = box(b"edts", full(b"elst", 1, struct.pack(">IQqIQqI", 2, 50, -1, 65536, 0, 40, 65536)))
    picture = box(b"trak", full(b"tkhd", 1, bytes(84), struct.pack(">II", 320 << 16, 240 << 16)), edits, media)
    sound = box(b"trak", full(b"tkhd", 0, bytes(80)), box(b"mdia", full(b"mdhd", 0, bytes(20)), full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"soun")), box(b"minf")))
    return box(b"ftyp", b"isom", bytes(12)) + box(b"free") + box(b"mdat", data, long=True) + box(b"moov", full(b"mvhd", 0, struct.pack(">IIII", 0, 0, 1000, 300), bytes(80)), sound, picture), size


def reader(data):
    asked = []

    def read(begin, n):
        asked.append(n)
        return data[begin : begin + n]

    return read, asked


def test_a_file_of_another_make():
    data, size = foreign()
    read, asked = reader(data)
    s = video.parse(read, len(data))
    assert sum(asked) < len(data) - 20 and (s.scale, s.width, s.height, s.start, s.stop) == (600, 320, 240, 40, None)
    assert s.size.tolist() == size and s.key.all()
    assert [data[o : o + n] for o, n in zip(s.offset.tolist(), size, strict=True)] == [bytes(range(5)), bytes(range(5, 8)), bytes(range(8, 16)), b"a", b"bc", b"defghij", b"klmn"]
    order, begin, end = s.shown()  # decoded at 0 20 40 60 90 120 150, shown later by 40 10 10 40 40 40 40: one comes before the edit
    assert order.tolist() == [0, 2, 3, 4, 5, 6] and np.allclose(begin * 600, [0, 10, 60, 90, 120, 150]) and np.allclose(end * 600, [10, 60, 90, 120, 150, 180])


@pytest.mark.parametrize("cut", [lambda d: d[:-40], lambda d: d.replace(b"moov", b"mxxv"), lambda d: d.replace(b"vide", b"soun"), lambda d: d[:20], lambda d: d.replace(b"stts", b"stxx")])
def test_broken_files_are_errors(cut, spark, tmp_path):
    data, _ = foreign()
    bad = cut(data)
    with pytest.raises((ValueError, KeyError, struct.error)):
        video.parse(reader(bad)[0], len(bad))
    (tmp_path / "a.mp4").write_bytes(data), (tmp_path / "b.mp4").write_bytes(bad)
    assert video.read_videos(spark, str(tmp_path), broken="skip").count() == 6


def test_cuts_show_the_same_frames():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 13, 40):
        data = [bytes([65 + i % 26]) * int(k) for i, k in enumerate(rng.integers(1, 9, n))]
        later = np.array([{0: 0, 1: 100, 2: -100}[i % 3] if i < n - n % 3 else 0 for i in range(n)])
        key = np.arange(n) % 4 == 0
        whole = video.mux(data, video.Samples(1000, np.full(n, 100), later, key, np.zeros(0), np.zeros(0), 0, 8, 6), int(rng.integers(1, 7)), bool(n % 2))
        s = video.parse(reader(whole)[0], len(whole))
        order, begin, end = s.shown()
        assert sorted(order.tolist()) == list(range(n)) and [whole[o : o + k] for o, k in zip(s.offset, s.size, strict=True)] == data
        for _ in range(20):
            a, b = sorted(rng.integers(0, n, 2).tolist())
            part = video.trim(reader(whole)[0], len(whole), a, b)
            t = video.parse(reader(part)[0], len(part))
            own, x, y = t.shown()
            assert [part[t.offset[i] : t.offset[i] + t.size[i]] for i in own] == [data[i] for i in order[a : b + 1]]
            assert np.allclose(x, begin[a : b + 1] - begin[a]) and np.allclose(y[:-1], end[a:b] - begin[a]) and (t.key[t.key_before()[own]]).all()
    with pytest.raises(ValueError):
        video.trim(reader(whole)[0], len(whole), 3, 99)


def test_seeks_of_gaps_and_missing_files(spark):
    frames = spark.createDataFrame([("a", i, i, i - i % 4) for i in range(10)], "file string, frame long, sample long, key_sample long")
    wanted = spark.createDataFrame([("a", 0, 3), ("a", 1, 3), ("a", 2, 4), ("b", 0, 0)], "file string, place long, frame long")
    got = {(r["file"], r["place"]): (r["shown"], r["seek"], r["from_sample"], r["to_sample"]) for r in video.seek_plan(frames, wanted).collect()}
    assert got == {("a", 0): (3, True, 0, 3), ("a", 1): (3, True, 0, 3), ("a", 2): (4, True, 4, 4), ("b", 0): (-1, False, None, None)}


def test_writers_go_where_they_are_told_or_fail(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.bin", bytearray(b"xyz")), ("c.bin", bytearray(b""))], "path string, content binary")
    for folder in (str(tmp_path / "one"), f"file://{tmp_path}/two", f"file:{tmp_path}/three"):
        files.write_files(rows, folder)
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()) == [f"{n}/{p}" for n in ("one", "three", "two") for p in ("a/b.bin", "c.bin")]
    for folder in ("nosuchstore://bucket/out", "viewfs://x/out"):
        with pytest.raises(Exception, match="(?i)unrecogni|scheme|uri"):
            files.write_files(rows, folder)
    with pytest.raises(Exception, match="no place below"):
        files.write_files(spark.createDataFrame([("../out.bin", bytearray(b"x"))], "path string, content binary"), str(tmp_path / "four"))
    assert stores.store("mock:///a/b")[1].strip("/") == "a/b"


def test_json_is_replaced_in_one_step(spark, tmp_path):
    path, seen, stop = str(tmp_path / "x.json"), [], threading.Event()
    files.write_json(spark, path, 0)

    def look():
        while not stop.is_set():
            try:
                with open(path) as f:
                    seen.append(f.read().isdigit())
            except FileNotFoundError:
                seen.append(False)

    watcher = threading.Thread(target=look)
    watcher.start()
    for k in range(1, 40):
        files.write_json(spark, path, k)
    stop.set()
    watcher.join()
    assert all(seen) and open(path).read() == "39"
    assert spark.range(1).select(F.lit(1)).count() == 1
