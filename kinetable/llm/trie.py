"""The trie of conversations' prefixes, with sums over its subtrees by heavy-path decomposition.

A prefix is known by two 64-bit sums (exclusive or) of hashes of its turns and their places, so a
running sum names all prefixes of a conversation, and a node's parent is the name without the last
turn. Conversations meet in their nodes by aggregation. Of a node's children the one with most
conversations (of equals that with the smallest conversation) goes on with its path; the others
begin paths of their own ("light"), and have at most half of the parent's conversations, so that
no node has more light ones above it than the logarithm of the number of conversations. Each path ends in a leaf, and what
lies on it is read off the leaf's smallest conversation: its nodes from the last light one on.

Sums are made from the paths with most light nodes above them to that of the root, a round for
each number: nodes of a path are laid in arrays by depth, arrays are summed from their ends, and
what the first node of a path has is added to its parent before the next round. Paths are cut into
arrays of ARRAY nodes, whose sums are carried over, so that no array grows with a conversation.

Rows: null role or text counts as empty; turns are ordered with nulls first, equal turns of a
conversation by a hash of role and text, so repeated rows are turns of their own. Rows without a conversation's
id belong to none. A conversation without any turn left counts at the root. No rows give no nodes.
The order of ids modulo 20 is that of floor division for negative ids. Further columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, with_groups

#: Nodes of one array; ids in one piece of a list of ids; rows of a group that one task may sort for a window.
ARRAY, PIECE, WINDOW_ROWS = 4096, 50_000, 1_000_000
#: Conversations that share the first of them, and how many turns at most (fixed by the rule of rebuilding).
FAMILY, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["p1", "p2"]


def _along(df: DataFrame, by: str, order: list[str], sums: dict[str, tuple[Column, str]]) -> DataFrame:
    """``df`` with running sums, the row itself included, in each group's order: by name a column
    and how it is summed, "sum" or "bit_xor". Groups too large for one task are dealt in ranges,
    and what a group has in the ranges before is added."""
    how = {"sum": (F.sum, lambda a, b: a + b), "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}
    largest = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: how[kind][0](c).over(w) for n, (c, kind) in sums.items()})
    rows = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "ranges")  # its upper bits are the range
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    w = Window.partitionBy("_range", by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: how[kind][0](c).over(w) for n, (c, kind) in sums.items()})
    parts = rows.groupBy("_range", by).agg(F.max_by(F.struct(*sums), "_at").alias("_all"))
    w = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_range", by, *[F.coalesce(how[kind][0](F.col("_all")[n]).over(w), F.lit(0)).alias(f"before_{n}") for n, (_, kind) in sums.items()])
    out = rows.join(before, ["_range", by])
    return out.withColumns({n: how[kind][1](F.col(n), F.col(f"before_{n}")) for n, (_, kind) in sums.items()}).select(*df.columns, *sums)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, depth, p1, p2, q1, q2, words, last): for each rebuilt conversation its prefixes, the
    empty one included, with their parents' names and the words of the last turn."""
    raw = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = raw.select("conv", "turn", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit("turn"), "role").alias("t2"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    turns = materialize(_along(turns, "conv", ["turn", "t1", "t2"], {"at": (F.lit(1), "sum")}).drop("turn"), "turns")

    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED, "base": F.col("conv") - F.pmod("conv", F.lit(FAMILY))})
    has = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(has, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base")
    convs = materialize(convs.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations", few=True)

    total = turns.count()
    own = with_groups(turns, convs, ["conv"], "n", total).where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("shared")).alias("depth"), "t1", "t2", "words", "length")
    first = turns.where(F.col("at") < SHARED).withColumnRenamed("conv", "base")  # at most three rows for each of a family
    lent = convs.join(first, "base").where("at <= h").select("conv", F.col("at").alias("depth"), "t1", "t2", "words", "length")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).alias("words"), "length")
    rows = own.unionByName(lent).unionByName(root)
    inside = lambda c: F.when(F.col("depth") > 0, c).otherwise(F.lit(0))
    rows = rows.select("conv", "depth", inside(F.xxhash64("depth", "t1", "t2")).alias("s1"), inside(F.xxhash64("t2", "depth", "t1")).alias("s2"), "words", (F.col("depth") == F.col("length")).alias("last"))
    rows = _along(rows, "conv", ["depth"], {"p1": (F.col("s1"), "bit_xor"), "p2": (F.col("s2"), "bit_xor")})
    out = materialize(rows.select("conv", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("s1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("s2")).alias("q2"), "words", "last"), "walks")
    discard(turns, convs)
    return out


def _nodes(walks: DataFrame) -> DataFrame:
    """One row a node: its parent, how many conversations and children it has, whether it is light."""
    nodes = walks.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", "q1", "q2", "words")]
    )
    nodes = materialize(nodes, "nodes")
    below = nodes.where("depth > 0").groupBy("q1", "q2").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), *NODE)).alias("heavy"))
    below = below.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children", F.col("heavy.p1").alias("h1"), F.col("heavy.p2").alias("h2"))
    nodes = materialize(nodes.join(below, NODE, "left").na.fill(0, ["n_children"]), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of"), F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    parents = materialize(parents, "parents")
    inner = with_groups(nodes.where("depth > 0"), parents, ["q1", "q2"], "of", nodes.count())
    inner = inner.withColumn("light", (F.col("p1") != F.col("o1")) | (F.col("p2") != F.col("o2")))
    top = nodes.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "light": F.lit(True)})
    kept = [*NODE, "q1", "q2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "words", "light"]
    return materialize(inner.select(*kept).unionByName(top.select(*kept)), "trie")


def _paths(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a node: its path (the conversation of the leaf where it ends), the depth where the
    path begins, and its level, the light nodes above that depth."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("conv"))  # all of a leaf's conversations end there
    rows = materialize(walks.join(leaves, "conv", "left_semi").select(F.col("conv").alias("path"), *NODE), "leaf_walks")
    facts = nodes.select(*NODE, "q1", "q2", "depth", "light", "n_convs", "n_children", "words")
    rows = materialize(with_groups(rows, facts, NODE, "n_convs", rows.count()), "leaf_walks")
    heads = rows.groupBy("path").agg(F.max(F.when(F.col("light"), F.col("depth"))).alias("head"), (F.count_if("light") - 1).alias("level"), F.count("*").alias("n"))
    heads = materialize(heads, "heads")
    own = with_groups(rows, heads, ["path"], "n", rows.count()).where("depth >= head")
    values = {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    return materialize(own.withColumns(values).select("path", "head", "depth", *NODE, "q1", "q2", "leaves", "saved", "level"), "paths", by=["level"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of a path's nodes in order, and what is carried to them, as one row a node with the
    sums from there to the path's end."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(0)
        ends = np.asarray(lists.offsets)
        flat = lists.values.slice(ends[0], ends[-1] - ends[0])
        length = np.diff(ends)
        of = np.repeat(np.arange(len(length)), length)
        cols = {n: flat.field(n) for n in ("p1", "p2", "q1", "q2", "first")}
        for k, n in ((1, "leaves"), (2, "saved")):
            v = flat.field(n).to_numpy()
            upto = np.cumsum(v)
            end = upto[np.cumsum(length) - 1]  # arrays have a node at least
            cols[n] = pa.array((end + b.column(k).to_numpy())[of] - upto + v, pa.int64())
        yield pa.RecordBatch.from_pydict(cols)


def _subtrees(paths: DataFrame) -> list[DataFrame]:
    """(p1, p2, leaves, saved) summed over the subtree of each node, a table a level."""
    out, added = [], None
    for level in range(paths.agg(F.max("level")).first()[0], -1, -1):
        rows = paths.where(F.col("level") == level)
        if added is not None:
            rows = rows.join(added, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
        item = F.struct("depth", *NODE, "q1", "q2", (F.col("depth") == F.col("head")).alias("first"), "leaves", "saved")
        arrays = rows.groupBy("path", F.floor(F.col("depth") / ARRAY).alias("nth")).agg(F.sort_array(F.collect_list(item)).alias("nodes"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        arrays = materialize(arrays, "arrays")
        w = Window.partitionBy("path").orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, -1)
        carried = arrays.select("path", "nth", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"after_{c}") for c in ("leaves", "saved")])
        rows = arrays.select("path", "nth", "nodes").join(carried, ["path", "nth"]).select("nodes", "after_leaves", "after_saved")
        done = materialize(rows.mapInArrow(_summed, "p1 long, p2 long, q1 long, q2 long, first boolean, leaves long, saved long"), "sums")
        discard(arrays)
        if level:  # light children may be many: they are added up before they go to their parent
            up = done.where("first").groupBy("q1", "q2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            added = materialize(up.withColumnsRenamed({"q1": "p1", "q2": "p2"}), "added")
        out.append(done)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p1, p2, conv) in order as (p1, p2, first conv, ids joined by commas)."""
    node, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"p1": pa.array([node[0]], pa.int64()), "p2": pa.array([node[1]], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

    for b in batches:
        p1, p2, conv = (b.column(i).to_numpy() for i in range(3))
        new = np.flatnonzero(np.r_[True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]) if len(conv) else np.zeros(0, np.int64)
        for a, e in zip(new.tolist(), [*new[1:].tolist(), len(conv)], strict=len(new) > 0):
            key = int(p1[a]), int(p2[a])
            if ids and (key != node or len(ids) + e - a > PIECE):
                yield out()
                ids = []
            node = key
            ids += conv[a:e].tolist()
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as (p1, p2, SHA-256 of all of a node's, joined); one piece is held at a time."""
    node, sha = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"p1": pa.array([k[0] for k, _ in rows], pa.int64()), "p2": pa.array([k[1] for k, _ in rows], pa.int64()), "ends_sha256": pa.array([d for _, d in rows], pa.string())})

    for b in batches:
        rows = []
        for x, y, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if (x, y) == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                rows.append((node, sha.hexdigest()))
            node, sha = (x, y), hashlib.sha256(ids.encode())
        yield out(rows)
    if node is not None:
        yield out([(node, sha.hexdigest())])


def _ends(walks: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of the nodes where conversations end. Ids are dealt in ranges and
    joined there, so a node with very many of them sends a few pieces to the task that hashes it."""
    order = [*NODE, "conv"]
    rows = walks.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = rows.mapInArrow(_pieces, "p1 long, p2 long, first long, ids string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return pieces.mapInArrow(_digests, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    prepare(conversations.sparkSession)
    walks = rebuilt(conversations)
    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if walks.isEmpty():
        return conversations.sparkSession.createDataFrame([], kinds)
    nodes = _nodes(walks)
    paths = _paths(walks, nodes)
    sums = None
    for level in _subtrees(paths):
        part = level.select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        sums = part if sums is None else sums.unionByName(part)
    out = nodes.join(sums, NODE).join(_ends(walks), NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
