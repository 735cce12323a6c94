"""EXR and HDF5 files made byte by byte, and what the writers here make."""

import struct
import zlib

import numpy as np
import pytest

from kinetable.sources import exr, hdf5

NONE = b"\xff" * 8


def attribute(name, kind, value):
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value


def exr_file(way, lines, window, channels):
    """``lines``: blocks (y, bytes)."""
    listed = b"".join(n + b"\0" + struct.pack("<iB3xii", k, 0, 1, 1) for n, k in channels) + b"\0"
    top = b"\x76\x2f\x31\x01" + struct.pack("<i", 2) + attribute("owner", "string", b"me") + attribute("channels", "chlist", listed) + attribute("compression", "compression", bytes([way])) + attribute("dataWindow", "box2i", struct.pack("<4i", *window)) + b"\0"
    places, body, at = b"", b"", len(top) + 8 * len(lines)
    for y, data in lines:
        places += struct.pack("<Q", at + len(body))
        body += struct.pack("<ii", y, len(data)) + data
    return top + places + body


def packed(raw):
    """Bytes parted in even and odd, then differences, by plain loops."""
    b = [raw[i] for i in range(0, len(raw), 2)] + [raw[i] for i in range(1, len(raw), 2)]
    return bytes([b[0]] + [(b[i] - b[i - 1] + 128) % 256 for i in range(1, len(b))])


def test_exr_by_hand():
    a, z = np.array([[1, 2, 3], [4, 5, 6]], "<f2"), np.array([[0.5, -1, 2], [3, 4, 1e9]], "<f4")
    rows = [a[i].tobytes() + z[i].tobytes() for i in range(2)]
    own = [(b"A", 1), (b"Z", 2)]
    plain = exr_file(0, [(7, rows[0]), (8, rows[1])], (5, 7, 7, 8), own)
    assert (exr.decode(plain) == z).all() and (exr.decode(plain, "A") == a).all() and (exr.decode(plain, "none") == a).all()
    one = exr_file(2, [(8, zlib.compress(packed(rows[1]))), (7, rows[0])], (5, 7, 7, 8), own)  # in another order; one that isn't shorter
    assert (exr.decode(one) == z).all()
    sixteen = exr_file(3, [(7, zlib.compress(packed(rows[0] + rows[1])))], (5, 7, 7, 8), own)
    assert (exr.decode(sixteen) == z).all()
    even = packed(bytes(36))
    runs = exr_file(1, [(0, bytes([256 - 1, even[0]]) + bytes([16, even[1]])), (1, bytes(18))], (0, 0, 2, 1), own)
    assert not exr.decode(runs).any()
    for bad in (b"no", plain[:4] + b"\x02\x02\0\0" + plain[8:], exr_file(4, [], (0, 0, 2, 1), own)):
        with pytest.raises((ValueError, IndexError)):
            exr.decode(bad)


def test_exr_round_trips():
    rng = np.random.default_rng(0)
    for way in (0, 2, 3):
        for h, w in ((1, 1), (16, 5), (33, 7), (48, 2)):
            layers = {"Z": rng.normal(size=(h, w)).astype(np.float32), "B": rng.normal(size=(h, w)).astype(np.float16), "n": rng.integers(0, 1 << 20, (h, w)).astype(np.uint32)}
            data = exr.encode(layers, way)
            for n, v in layers.items():
                assert (exr.decode(data, n) == v.astype(np.float32)).all()


def message(kind, body):
    body += bytes(-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 1) + body


def hdf5_file():
    """Another layout of the same format: superblock 1, a header that goes on elsewhere, big-endian numbers in one
    piece, values in the header, fixed text, chunks in a tree of two levels with a checksum and an unpacked chunk."""
    data = bytearray(200)

    def put(content):
        data.extend(bytes(-len(data) % 8))
        data.extend(content)
        return len(data) - len(content)

    def header(*messages, more=()):
        if more:
            rest = b"".join(more)
            messages = (*messages, message(0x10, struct.pack("<QQ", put(rest), len(rest))))
        return put(struct.pack("<BxHII4x", 1, len(messages) + len(more), 1, sum(map(len, messages))) + b"".join(messages))

    numbers = (np.arange(12).reshape(4, 3) - 5).astype(">i2")
    piece = header(message(0x01, struct.pack("<BBBBQQ", 2, 2, 0, 1, 4, 3)), more=(message(0x03, struct.pack("<BBBBIHH", 0x10, 9, 0, 0, 2, 0, 16)), message(0x08, struct.pack("<BBQQ", 3, 1, put(numbers.tobytes()), 24))))
    here = header(message(0x01, struct.pack("<BBB5xQ", 1, 1, 0, 2)), message(0x03, struct.pack("<BBBBI12x", 0x11, 0x20, 63, 0, 8)), message(0x08, struct.pack("<BBH", 3, 0, 16) + struct.pack("<dd", 1.5, -2.0)))
    text = header(message(0x01, struct.pack("<BBB5x", 1, 0, 0)), message(0x03, struct.pack("<BBBBI", 0x13, 1, 0, 0, 6)), message(0x08, struct.pack("<BBQQ", 3, 1, put(b"abc\0\0\0"), 6)))
    values, leaves = np.arange(35, dtype="<u4").reshape(7, 5), []
    for r in (0, 4):
        keys = []
        for c in (0, 3):
            part = np.zeros((4, 3), "<u4")
            own = values[r : r + 4, c : c + 3]
            part[: own.shape[0], : own.shape[1]] = own
            raw = part.tobytes()
            unpacked = r == 4 and c == 3
            stored = (raw if unpacked else zlib.compress(raw)) + b"sum!"
            keys.append((struct.pack("<IIQQQ", len(stored), 1 if unpacked else 0, r, c, 0), put(stored)))
        leaves.append((keys[0][0], put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 2, 0, 0) + keys[0][0] + struct.pack("<Q", keys[0][1]) + keys[1][0] + struct.pack("<Q", keys[1][1]) + struct.pack("<IIQQQ", 0, 0, 8, 6, 0))))
    root = put(b"TREE" + struct.pack("<BBHQQ", 1, 1, 2, 0, 0) + b"".join(k + struct.pack("<Q", at) for k, at in leaves) + struct.pack("<IIQQQ", 0, 0, 8, 6, 0))
    filters = struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 1, 0, 1, 6) + struct.pack("<HHH", 3, 0, 0)
    chunks = header(message(0x01, struct.pack("<BBB5xQQ", 1, 2, 0, 7, 5)), message(0x03, struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 4, 0, 32)), message(0x08, struct.pack("<BBBQIII", 3, 2, 3, root, 4, 3, 4)), message(0x0B, filters))
    empty = header(message(0x01, struct.pack("<BBB5xQ", 1, 1, 0, 3)), message(0x03, struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 1, 0, 8)), message(0x08, struct.pack("<BBQQ", 3, 1, (1 << 64) - 1, 3)))
    names, rows = b"\0" * 8, b""
    for n, at in sorted({b"chunks": chunks, b"empty": empty, b"here": here, b"piece": piece, b"text": text}.items()):
        rows += struct.pack("<QQI4x16x", len(names), at, 0)
        names += n + b"\0" * (8 - len(n) % 8)
    heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, put(names)))
    node = put(b"SNOD" + struct.pack("<BxH", 1, 5) + rows)
    tree = put(b"TREE" + struct.pack("<BBH", 0, 0, 1) + NONE * 2 + struct.pack("<QQQ", 0, node, 8))
    group = header(message(0x11, struct.pack("<QQ", tree, heap)))
    data[:100] = b"\x89HDF\r\n\x1a\n" + bytes([1, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHIHH", 4, 16, 0, 32, 0) + struct.pack("<Q", 0) + NONE + struct.pack("<Q", len(data)) + NONE + struct.pack("<QQI4x16x", 0, group, 0)
    return bytes(data), numbers, values


def test_hdf5_by_hand():
    data, numbers, values = hdf5_file()
    asked = []

    def read(begin, n):
        asked.append((begin, n))
        return data[begin : begin + n]

    f = hdf5.File(read)
    assert sorted(f.members(f.root)) == ["chunks", "empty", "here", "piece", "text"]
    assert (f.rows("piece", 1, 3) == numbers[1:3]).all() and f.rows("here", 0, 2).tolist() == [1.5, -2.0] and f.text("/text") == "abc" and f.rows("empty", 0, 3).tolist() == [0, 0, 0]
    for a in range(8):
        for b in range(a, 8):
            assert (f.rows("chunks", a, b) == values[a:b]).all()
    for path in ("nothing", "piece/x", "/"):
        with pytest.raises((KeyError, IndexError)):
            f.rows(path, 0, 1)
    with pytest.raises(IndexError):
        f.rows("chunks", 0, 8)
    for bad in (b"", data[:40], b"\x89HDF\r\n\x1a\n\x02" + data[9:]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            hdf5.File(lambda a, n, d=bad: d[a : a + n]).rows("chunks", 0, 1)


def test_hdf5_round_trips():
    rng = np.random.default_rng(1)
    for kind in ("<f4", "<f8", "<f2", "<u2", "<i8"):
        x = (rng.normal(size=(17, 6, 5)) * 100).astype(kind) if kind[1] != "u" else rng.integers(0, 60000, (17, 6, 5)).astype(kind)
        w = hdf5.Writer()
        many = {f"g{i}": w.group({"t": w.text(f"é{i}" * i)}) for i in range(700)}  # trees of names of more than one level
        data = w.finish(w.group({**many, "d": w.group({"x": w.array(x, (4, 4, 2)), "y": w.array(x[:0], (1, 6, 5), False)})}))
        f = hdf5.File(lambda a, n, d=data: d[a : a + n])
        assert (f.rows("d/x", 0, 17) == x).all() and (f.rows("/d/x", 5, 6) == x[5:6]).all() and f.rows("d/y", 0, 0).shape == (0, 6, 5)
        assert len(f.members(f.root)) == 701 and f.text("g699/t") == "é699" * 699 and f.text("g0/t") == ""


def test_only_chunks_that_are_wanted_are_read():
    w = hdf5.Writer()
    data = w.finish(w.group({"x": w.array(np.random.default_rng(2).integers(0, 65536, (400, 16, 16)).astype(np.uint16), (1, 16, 16))}))
    asked = []

    def read(begin, n):
        asked.append(n)
        return data[begin : begin + n]

    hdf5.File(read).rows("x", 250, 251)
    assert sum(asked) < len(data) / 10
