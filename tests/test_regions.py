"""Masks against every pixel and every edge, compressed run lengths, patches between tokens by hand."""

import numpy as np
import pytest

from kinetable.functions import masks
from kinetable.operators import interleave


def inside(parts, h, w):
    out = np.zeros((h, w), bool)
    for p in parts:
        q = list(zip(p[::2], p[1::2], strict=True))
        for i in range(h):
            for j in range(w):
                n, y, x = 0, i + 0.5, j + 0.5
                for (x1, y1), (x2, y2) in zip(q, q[1:] + q[:1], strict=True):
                    n += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
                out[i, j] |= n % 2 == 1
    return out


def test_polygons_pixel_by_pixel():
    rng = np.random.default_rng(0)
    for _ in range(120):
        h, w = (int(v) for v in rng.integers(1, 24, 2))
        parts = [(rng.random(2 * int(rng.integers(1, 8))) * 40 - 8).round(1).tolist() for _ in range(int(rng.integers(0, 4)))]
        m = masks.fill(parts, h, w)
        assert (m == inside(parts, h, w)).all()
        runs = masks.runs_of(m)
        assert (masks.decode_rle(runs.tolist(), h, w) == m).all() and runs.sum() == h * w
        assert masks.expand(masks.compress(runs)).tolist() == runs.tolist()


def test_known_codes():
    # by hand: 40 is 'X1' (8 and more, 1), and 9 - 40 = -31 is 'QO' (1 and more, all ones)
    assert masks.compress([6, 1, 40]) == "61X1" and masks.expand("61X1").tolist() == [6, 1, 40]
    assert masks.compress([0, 5, 4, 9]) == "0544" and masks.compress([0, 40, 4, 9]) == "0X14QO"
    rng = np.random.default_rng(1)
    for _ in range(300):
        c = rng.integers(0, 10 ** int(rng.integers(1, 8)), int(rng.integers(1, 30)))
        assert masks.expand(masks.compress(c)).tolist() == c.tolist()
    for bad in ("X", "\x00", "zz"):
        with pytest.raises(ValueError):
            masks.expand(bad)
    assert not len(masks.expand(""))


def test_rows(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0]], 5, 6), (2, None, 2, 2), (3, [], 1, 3), (4, [[0.0, 0.0, 900.0, 0.0, 900.0, 700.0, 0.0, 700.0], [899.0, 0.0, 1000.0, 0.0, 1000.0, 10.0, 899.0, 10.0]], 700, 1000)], "k long, p array<array<double>>, h int, w int")
    got = {r["k"]: r for r in masks.polygon_runs(df, "k", "p", "h", "w").collect()}
    assert [got[k]["area"] for k in (1, 2, 3, 4)] == [12, 0, 0, 900 * 700 + 100 * 10] and got[2]["counts"] == [4]
    again = masks.expanded(spark.createDataFrame([(k, r["code"]) for k, r in got.items()] + [(9, None)], "k long, c string"), "k", "c").collect()
    assert {r["k"]: r["area"] for r in again} == {1: 12, 2: 0, 3: 0, 4: 631_000, 9: None}


def test_pooled_patches():
    assert interleave.pooled(2, 3, (2, 2)).tolist() == [[0, 1, 3, 4], [2, -1, 5, -1]]
    assert interleave.pooled(3, 3, (2, 2)).tolist() == [[0, 1, 3, 4], [2, -1, 5, -1], [6, 7, -1, -1], [8, -1, -1, -1]]
    assert interleave.pooled(1, 2, (3, 2)).tolist() == [[-1, -1, 0, 1, -1, -1]]


def test_pictures_take_their_places(spark):
    rows = [(1, [7, -1, 8, -1, 9], [1, 0, 1, 0, 1], [(2, 2), (1, 3)]), (2, [7, 8], [0, 1], [(1, 1), (2, 1)]), (3, [5, 6, 4], [0, 1, 1], None), (4, None, None, []), (5, [3], [1], [(1, 1)])]
    df = spark.createDataFrame(rows, "k long, i array<long>, l array<long>, g array<struct<h: int, w: int>>")
    got = {r["k"]: r for r in interleave.interleaved(df, "k", "i", "l", "g").collect()}
    assert got[1]["input_tokens"] == [7, -2, -3, -4, -5, 8, -2, -3, -3, -4, -5] and got[1]["target_tokens"] == [-2, -3, -4, -5, 8, -2, -3, -3, -4, -5, 9]
    assert got[1]["loss_masks"] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1] and got[1]["position_ids"] == list(range(11))
    assert got[1]["pooled"] == [[0, 1, 2, 3], [4, 5, -1, -1], [6, -1, -1, -1]]
    assert got[2]["input_tokens"] == [7, -2, -3, -4, -5, -2, -3, -4, -5] and got[2]["target_tokens"][-1] == 8
    assert got[3]["input_tokens"] == [5, 6] and got[3]["pooled"] == [] and got[4]["input_tokens"] == [] and got[5]["input_tokens"] == [3, -2, -3, -4]
    with pytest.raises(Exception, match="marks of"):
        interleave.interleaved(spark.createDataFrame([(1, [-1], [0], [])], df.schema), "k", "i", "l", "g").collect()
