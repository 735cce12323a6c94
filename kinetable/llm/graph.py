"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors equal up to a factor (bit for bit, after the scaling) are one node; copies share its
links. Nodes are dealt to the shards of their OVERLAP nearest centres, centres being nodes
drawn by hash. In each shard the candidates of a node, its nearest in the shard, are pruned
robustly: a candidate stays unless a kept one is closer to it, by a factor, than the node is.
The adjacency lists of all shards are united for each node. Then each node searches the
shards it is in: greedily from the shard's medoid and its own neighbours, always expanding
the most similar node met; the range of what is expanded widens from the best few to all
nodes within the link range, so a search ends only when the whole cluster is expanded. What
is found is verified, where it is found, by the cosine in double precision.

A hash draws nodes whose links are also found by comparing them with all nodes in blocks;
if too few were found by the graph (``audit``), the overlap is doubled and all is done again,
until each node is in every shard. The share that was found is kept in ``AUDITED`` for each
application; a last one below the recall asked for is an error.

Centres grow with the nodes, up to CENTRE_BYTES of them (131,072 of 64 numbers: shards stay at
about SHARD nodes up to 200 million); the number of nodes drawn for the audit is at most
AUDIT. A shard that holds more is searched in several tasks, each with a share of the queries.

Rows: a vector that is null, empty, zero or holds a null or non-finite component, or has a
null id, has no links; rows with the same id are one vector's (its links are those of any of
its rows); vectors of different lengths don't link; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, prepare, with_groups
from .components import components

SHARD, CENTRE_BYTES, AUDIT, OVERLAP = 1500, 64 << 20, 200, 3
DEGREE, NEAR, SLACK, QUERIES = 24, 96, 1.2, 4000
#: Links of drawn nodes that there are and that were found, by application.
AUDITED: dict[str, tuple[int, int]] = {}


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n most similar centres of each row, best first."""
    s = x @ centres.T
    n = min(n, s.shape[1])
    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)


def prune(x: np.ndarray, node: int, order: np.ndarray, sims: np.ndarray) -> list[int]:
    """Robust pruning of candidates, most similar first: one is dropped if a kept one is
    closer to it, by the factor SLACK, than the node is."""
    alive, kept = np.ones(len(order), bool), []
    far = np.sqrt(np.clip(2 - 2 * sims, 0, None))
    for i in range(len(order)):
        if not alive[i] or order[i] == node:
            continue
        kept.append(int(order[i]))
        if len(kept) == DEGREE:
            break
        between = np.sqrt(np.clip(2 - 2 * (x[order] @ x[order[i]]), 0, None))
        alive &= SLACK * between > far
    return kept


def build(x: np.ndarray) -> list[list[int]]:
    """Adjacency lists of one shard, links in both directions."""
    n, out = len(x), [[] for _ in range(len(x))]
    for begin in range(0, n, 512):
        s = x[begin : begin + 512] @ x.T
        near = min(NEAR + 1, n)
        top = np.argpartition(-s, near - 1, axis=1)[:, :near]
        for i in range(len(s)):
            o = top[i][np.lexsort((top[i], -s[i, top[i]]))]
            out[begin + i] = prune(x, begin + i, o, s[i, o])
    for i, links in enumerate([list(x) for x in out]):
        for j in links:
            out[j].append(i)
    return [sorted(set(a)) for a in out]


def search(x: np.ndarray, links: list[np.ndarray], q: int, start: int, least: float, beam: int = 12) -> list[int]:
    """All nodes met with a cosine to node q of at least ``least``."""
    seen = {q, start, *links[q].tolist()}
    met = np.fromiter(seen, np.int64)
    sims = x[met] @ x[q]
    queue = [(-s, n) for s, n in zip(sims.tolist(), met.tolist(), strict=True)]
    heapq.heapify(queue)
    best, found, expanded = sorted(sims.tolist())[-beam:], [], 0
    while queue:
        s, node = heapq.heappop(queue)
        if -s < least and expanded >= beam and -s < best[0]:
            break  # neither within the range nor among the best met
        expanded += 1
        if -s >= least and node != q:
            found.append(node)
        new = [n for n in links[node].tolist() if n not in seen]
        if not new:
            continue
        seen.update(new)
        for s, n in zip((x[new] @ x[q]).tolist(), new, strict=True):
            if len(best) < beam or s > best[0]:
                best = sorted([*best, s])[-beam:]
            heapq.heappush(queue, (-s, n))
    return found


def _search_shard(least: float):
    """Links of the nodes of one shard whose queries fall to this task."""

    def run(key, group):
        node = group["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        node, x = node[order], _matrix(group["v"].combine_chunks())[order]
        mine = group["mine"].to_numpy(zero_copy_only=False)[order]
        place = {n: i for i, n in enumerate(node.tolist())}
        links = [np.array([place[a] for a in (near or ()) if a in place and place[a] != i], np.int64) for i, near in enumerate(group["links"].take(pa.array(order)).to_pylist())]
        medoid = int(np.argmax(x @ x.mean(0)))
        copies, a, b, wa, wb, joins = group["copies"].to_numpy()[order], [], [], [], [], []
        parent = list(range(len(node)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for q in np.flatnonzero(mine).tolist():
            f = np.array(search(x, links, q, medoid, least - 1e-9), np.int64)
            f = f[(x[f] * x[q]).sum(1) >= least]
            tree = np.zeros(len(f), bool)  # links that join two parts of what this task has found
            top = root(q)
            for k, i in enumerate(f.tolist()):
                if (other := root(i)) != top:
                    parent[other], tree[k] = top, True
            joins.append(tree)
            a.append(np.minimum(node[q], node[f]))
            b.append(np.maximum(node[q], node[f]))
            wa.append(np.where(node[f] > node[q], copies[q], copies[f]))
            wb.append(np.where(node[f] > node[q], copies[f], copies[q]))
        cols = {n: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for n, x in (("a", a), ("b", b), ("wa", wa), ("wb", wb))}
        return pa.table(cols | {"tree": pa.array(np.concatenate([np.zeros(0, bool), *joins]))})

    return run


def _build_shard(key, group):
    node = group["node"].to_numpy()
    order = np.argsort(node, kind="stable")
    node = node[order]
    near = build(_matrix(group["v"].combine_chunks())[order].astype(np.float32))
    return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array([node[a].tolist() for a in near], pa.list_(pa.int64()))})


def shards(nodes: DataFrame, n: int) -> int:
    """How many centres there are."""
    longest = nodes.agg(F.max("d")).first()[0] or 1
    return max(1, min(math.ceil(n / SHARD), CENTRE_BYTES // (8 * longest)))


def links(nodes: DataFrame, n: int, least: float, overlap: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, d, v, copies) found by the graph and verified, with the
    copies of both; those with ``tree`` connect what all connect."""
    spark = nodes.sparkSession
    k = shards(nodes, n)
    drawn = nodes.orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(k).collect()
    centres = spark.sparkContext.broadcast({d: np.array([np.frombuffer(r["v"], "<f8") for r in drawn if r["d"] == d]) for d in {r["d"] for r in drawn}})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, d, v, copies = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3).to_numpy()
            for size in np.unique(d).tolist():
                own = np.flatnonzero(d == size)
                c = centres.value.get(size)
                vs = v.take(pa.array(own))
                near = nearest(_matrix(vs), c, overlap) if c is not None else np.zeros((len(own), 1), np.int64)
                times = near.shape[1]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([f"{size}-{x}" for x in near.ravel()]), "node": pa.array(np.repeat(node[own], times), pa.int64()), "copies": pa.array(np.repeat(copies[own], times), pa.int64()), "v": vs.take(pa.array(np.repeat(np.arange(len(own)), times)))})

    dealt = materialize(nodes.select("node", "d", "v", "copies").mapInArrow(frugal(deal), "shard string, node long, copies long, v binary"), "dealt")
    lists = dealt.drop("copies").groupBy("shard").applyInArrow(_build_shard, "node long, links array<long>")
    lists = materialize(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "lists")
    # a large shard goes to several tasks, each with a share of its queries
    shares = dealt.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    spread = dealt.join(lists, "node").join(shares, "shard").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("shares")) == F.col("share"))
    found = spread.select("shard", "share", "node", "copies", "v", "links", "mine").groupBy("shard", "share").applyInArrow(_search_shard(least), "a long, b long, wa long, wb long, tree boolean")
    return materialize(found.groupBy("a", "b").agg(F.first("wa").alias("wa"), F.first("wb").alias("wb"), F.max("tree").alias("tree")), "links")


def audit(nodes: DataFrame, found: DataFrame, n: int, least: float) -> tuple[int, int]:
    """Links of drawn nodes: how many there are, and how many were found."""
    share = min(1.0, AUDIT / max(n, 1))
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit(17), "node"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * AUDIT).collect()
    if not drawn:
        return 0, 0
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["d"], np.frombuffer(r["v"], "<f8")) for r in drawn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for size in np.unique(d).tolist():
                own, q = np.flatnonzero(d == size), [x for x in shared.value if x[1] == size]
                if q:
                    x, y = np.stack([x[2] for x in q]), _matrix(b.column(2).take(pa.array(own)))
                    i, j = np.nonzero(x @ y.T >= least - 1e-9)
                    ok = (x[i] * y[j]).sum(1) >= least
                    i, j = i[ok], j[ok]
                    one, two = np.array([x[0] for x in q], np.int64)[i], node[own][j]
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})

    true = nodes.select("node", "d", "v").mapInArrow(run, "a long, b long").where("a < b").distinct()
    true = materialize(true, "audit", few=True)
    return true.count(), true.join(found, ["a", "b"], "left_semi").count()


def near_vectors(vectors: DataFrame, least: float = 0.95, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size, out = [], [], []
            for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not e or any(c is None for c in e):
                    continue
                v = np.array(e, np.float64)
                top = np.abs(v).max()
                if not np.isfinite(v).all() or top == 0:
                    continue
                v = v / top
                v = v / np.sqrt(v @ v)
                ids.append(i)
                size.append(len(v))
                out.append((v + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "d": pa.array(size, pa.int32()), "v": pa.array(out, pa.binary())})

    unit = materialize(rows.mapInArrow(scale, "id long, d int, v binary").distinct().withColumn("key", F.sha2("v", 256)), "unit")
    groups = materialize(unit.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "groups", few=True)
    members = materialize(with_groups(unit.select("id", "key"), groups, ["key"], "copies", unit.count()).select("id", "key", "node", "copies"), "members")
    nodes = materialize(unit.join(members.where("id = node").select("id", "copies", "key"), ["id", "key"]).select(F.col("id").alias("node"), "d", "v", "copies").dropDuplicates(["node"]), "nodes")
    n = nodes.count()

    overlap = OVERLAP
    while True:
        found = links(nodes, n, least, overlap)
        there, met = audit(nodes, found, n, least)
        if met >= recall * there or overlap >= shards(nodes, n):
            break
        overlap *= 2
    AUDITED[vectors.sparkSession.sparkContext.applicationId] = there, met
    if met < recall * there:
        raise RuntimeError(f"only {met} of {there} links of drawn nodes were found")

    both = found.select("a", "wb").union(found.select("b", "wa")).toDF("node", "n")
    reached = both.groupBy("node").agg(F.sum("n").alias("others"))
    classes = components(found.where("tree").select("a", "b"))
    counted = members.join(reached, "node", "left").select("id", "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    counted = counted.join(classes.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("id", "n_links", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("id").join(counted.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
