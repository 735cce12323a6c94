"""Pictures with every filter and kind of colour, lines drawn into them, exported arrays."""

import struct
import zlib

import numpy as np
import pytest

from kinetable.sources import pictures, tracks


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(p, kinds, colour, palette=None, woven=0, bits=8):
    """A file whose rows have the given filters, made value by value."""
    h, w, n = p.shape
    raw = bytearray()
    get = lambda y, x, c: int(p[y, x, c]) if y >= 0 and x >= 0 else 0
    for y in range(h):
        k = kinds[y % len(kinds)]
        raw.append(k)
        for x in range(w):
            for c in range(n):
                a, b, d = get(y, x - 1, c), get(y - 1, x, c), get(y - 1, x - 1, c)
                guess = min((abs(a + b - d - v), i, v) for i, v in enumerate((a, b, d)))[2]
                raw.append((int(p[y, x, c]) - (0, a, b, (a + b) // 2, guess)[k]) % 256)
    z = zlib.compress(bytes(raw))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, woven)) + chunk(b"tEXt", b"a\0b") + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_filter(colour, n):
    rng = np.random.default_rng(colour)
    for h, w in ((1, 1), (5, 7), (11, 3)):
        p = rng.integers(0, 256, (h, w, n)).astype(np.uint8)
        for kinds in ((0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)):
            assert (pictures.picture(filtered(p, kinds, colour)) == p).all()
        assert (pictures.picture(pictures.png(p)) == p).all()


def test_palettes_and_what_isnt_read():
    palette = np.arange(30, dtype=np.uint8).reshape(10, 3)
    p = np.random.default_rng(1).integers(0, 10, (4, 5, 1)).astype(np.uint8)
    assert (pictures.picture(filtered(p, (4,), 3, palette)) == palette[p[..., 0]]).all()
    for bad in (b"GIF89a", filtered(p, (0,), 0, woven=1), filtered(p, (0,), 0, bits=16)):
        with pytest.raises(ValueError):
            pictures.picture(bad)
    with pytest.raises(ValueError):
        pictures.grey(pictures.png(np.zeros((2, 2, 3))))


def test_strokes():
    assert pictures.stroke(np.array([[0, 0], [3, 1]])).tolist() == [[0, 0], [1, 0], [2, 1], [3, 1]]
    assert pictures.stroke(np.array([[2.0, 2.0]])).tolist() == [[2, 2]] and not len(pictures.stroke(np.zeros((0, 2))))
    assert pictures.stroke(np.array([[0, 0], [np.nan, 1], [5, 5], [5, 6]])).tolist() == [[5, 5], [5, 6]]


def test_overlay(spark):
    rows = [(1, [0] * 75, [[0.0, 0.0, 4.0, 0.0], [2.0, 4.0, 2.0, 9.0]]), (2, None, [[0.0, 0.0]]), (3, [7] * 75, None), (4, [0] * 75, [[None, 1.0, 3.0, 3.0]])]
    df = spark.createDataFrame(rows, "k long, p array<int>, l array<array<double>>")
    got = {r["k"]: r["pixels"] for r in pictures.overlay(df, "k", "p", 5, "l", thick=1, dot=1, palette=((1, 2, 3), (9, 9, 9))).collect()}
    p = np.array(got[1]).reshape(5, 5, 3)
    assert (p[0] == [1, 2, 3]).all() and (p[1, 4] == [1, 2, 3]).all() and (p[4, 2] == 9).all() and p.any(-1).sum() == 5 + 1 + 1
    assert got[2] is None and got[3] == [7] * 75
    assert {tuple(x) for x in np.argwhere(np.array(got[4]).reshape(5, 5, 3)[..., 0])} == {(3, 3), (2, 3), (4, 3), (3, 2), (3, 4)}


def test_arrays_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([("a.npy", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("b/c.npy", [0.5, 1.5, 2.5]), ("empty.npy", [])], "name string, v array<double>")
    tracks.write_arrays(df, str(tmp_path), "name", "v", 3)
    assert np.load(tmp_path / "a.npy").tolist() == [[1, 2, 3], [4, 5, 6]] and np.load(tmp_path / "empty.npy").shape == (0, 3)
    np.save(tmp_path / "d.npy", np.arange(4, dtype=">i2").reshape(2, 2, order="F"))
    got = {r["file"]: (r["shape"], r["values"]) for r in tracks.read_arrays(spark, str(tmp_path)).collect()}
    assert got == {"a.npy": ([2, 3], [1, 2, 3, 4, 5, 6]), "c.npy": ([1, 3], [0.5, 1.5, 2.5]), "empty.npy": ([0, 3], []), "d.npy": ([2, 2], [0, 2, 1, 3])}
