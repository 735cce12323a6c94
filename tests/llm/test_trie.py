"""The trie of prefixes against a brute-force one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from kinetable.llm import queries, trie

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows (conv_id, turn, role, text) with distinct turns, to a set of node rows."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members, ends, children, below = defaultdict(list), defaultdict(list), defaultdict(set), defaultdict(set)
    for c, seq in sorted(full.items()):
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
            below[seq[:d]] |= {seq[:k] for k in range(d, len(seq) + 1)}
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = set()
    for n, m in members.items():
        sub = below[n]
        out.add((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), sum(not children[x] for x in sub), sum((len(members[x]) - 1) * words(x) for x in sub), hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()))
    return out


def run(spark, rows):
    return set(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, KIND).repartition(3)).collect()))


def mixed(n, seed, deep=6, kinds=3):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(n * 2), n):
        turns = r.sample(range(50), r.randint(1, deep))
        if r.random() < 0.2:
            turns[0] = None
        out += [(c, t, r.choice(["user", None, "ab"]), r.choice(["", "a b", "b  a\tc", None, "bc"][:kinds])) for t in turns]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = mixed(150, seed, kinds=2 + seed)
    assert run(spark, rows) == brute(rows)


def test_deep_paths_in_several_arrays_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "ARRAY", 3)
    monkeypatch.setattr(trie, "PIECE", 2)
    monkeypatch.setattr(trie, "WINDOW_ROWS", 5)
    rows = [(c, t, "u", f"w{t} x") for c in range(40, 52) for t in range(25)] + [(c, t, "u", "w0") for c in range(80, 95) for t in range(2)] + [(200 + k, 0, "u", "own " * k) for k in range(4)]
    assert run(spark, rows) == brute(rows)


def test_rows(spark):
    none = hashlib.sha256(b"").hexdigest()
    assert run(spark, []) == set()
    assert run(spark, [(None, 0, "u", "x")]) == set()
    turnless = next(c for c in range(100) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1)
    assert run(spark, [(turnless, 0, "u", "x")]) == {(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}
    long = [(20, 0, None, "word " * 50_000), (20, 1, "a", None)]
    assert run(spark, long) == brute(long)
    # equal turns, repeated rows: turns of their own in a fixed order
    keep = next(c for c in range(0, 2000, 20) if zlib.crc32(str(c).encode()) % 4 == 0)
    same = [(keep, 0, "u", "x"), (keep, 0, "u", "x"), (keep, 0, "a", "y z")]
    got = run(spark, same)
    assert got == run(spark, same[::-1]) and sorted(r[1] for r in got) == [0, 1, 2, 3] and {r[-1] for r in got if r[1] < 3} == {none}
    extra = spark.createDataFrame([(20, 0, "u", "x", 7, "q")], KIND + ", conv long, p1 string")
    assert trie.prefix_trie(extra).count() == 2


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    t = pq.read_table(f"{folder}/conversations.parquet").to_pylist()
    assert set(map(tuple, queries.op13_heavy_paths(spark, folder).collect())) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in t])
