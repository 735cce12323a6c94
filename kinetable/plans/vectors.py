"""Queries on embeddings as points, rotations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import metrics, neighbours
from .registry import Tables, query, rounded


def _point(i: int = 0):
    return [F.get("embedding", F.lit(i + k)).cast("double") for k in range(3)]


_XYZ = "x as (select vec_id, " + ", ".join(f"cast(embedding[{i + 1}] as double) as e{i}" for i in range(16)) + " from embeddings)"


@query("""select a.vec_id, round(list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as l2 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_l2_pairs(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", rounded(g.l2(F.col("embedding"), F.col("other")), 6).alias("l2"))


@query("""with d as (select a.label, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as e from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select label, round(avg((cast(e <= 0.5 as int) + cast(e <= 1 as int) + cast(e <= 1.2 as int) + cast(e <= 1.4 as int) + cast(e <= 2 as int)) / cast(5 as double)), 6) as pwt from d group by label""")
def pwt_by_label(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    e = t.embeddings.join(b, "vec_id").withColumn("e", g.l2(F.col("embedding"), F.col("other")))
    return e.groupBy("label").agg(rounded(F.avg(metrics.threshold_rate(F.col("e"), [0.5, 1, 1.2, 1.4, 2])), 6).alias("pwt"))


@query(f"with {_XYZ} select vec_id, round(500 * e0 / greatest(e2, 1e-6) + 320, 4) as u, round(500 * e1 / greatest(e2, 1e-6) + 240, 4) as v from x where e2 > 0.01")
def pinhole(t: Tables):
    u, v = g.pinhole(_point(), 500.0, 500.0, 320.0, 240.0)
    return t.embeddings.where(_point()[2] > 0.01).select("vec_id", rounded(u, 4).alias("u"), rounded(v, 4).alias("v"))


_Q = """q as (select *, e3*e3 + e4*e4 + e5*e5 + e6*e6 as n from x),
    r as (select *, 1-2*(e5*e5+e6*e6)/n as r0, 2*(e4*e5-e6*e3)/n as r1, 2*(e4*e6+e5*e3)/n as r2, 2*(e4*e5+e6*e3)/n as r3, 1-2*(e4*e4+e6*e6)/n as r4,
      2*(e5*e6-e4*e3)/n as r5, 2*(e4*e6-e5*e3)/n as r6, 2*(e5*e6+e4*e3)/n as r7, 1-2*(e4*e4+e5*e5)/n as r8 from q)"""


def _rotation():
    return g.quaternion_rotation(*[F.get("embedding", F.lit(3 + k)).cast("double") for k in range(4)])


@query(f"""with {_XYZ}, {_Q} select vec_id, round(r0*e0+r1*e1+r2*e2+e7, 6) as x, round(r3*e0+r4*e1+r5*e2+e8, 6) as y, round(r6*e0+r7*e1+r8*e2+e9, 6) as z,
    round(-(r0*e7+r3*e8+r6*e9), 6) as tx, round(-(r1*e7+r4*e8+r7*e9), 6) as ty, round(-(r2*e7+r5*e8+r8*e9), 6) as tz from r""")
def rigid_transform(t: Tables):
    r, shift = _rotation(), _point(7)
    x, y, z = g.transform_point(r, shift, _point())
    _, (tx, ty, tz) = g.rigid_inverse(r, shift)
    return t.embeddings.select("vec_id", *[rounded(c, 6).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"), (tx, "tx"), (ty, "ty"), (tz, "tz"))])


@query(f"with {_XYZ} select vec_id, round(e0, 5) as x, round(e1, 5) as y, round(e2, 5) as z from x")
def rigid_round_trip(t: Tables):
    r, shift = _rotation(), _point(7)
    back, undo = g.rigid_inverse(r, shift)
    p = g.transform_point(back, undo, g.transform_point(r, shift, _point()))
    return t.embeddings.select("vec_id", *[rounded(c, 5).alias(n) for c, n in zip(p, "xyz", strict=True)])


@query(f"""with {_XYZ}, a as (select *, sqrt(e0*e0+e1*e1) as r, atan2(sqrt(e0*e0+e1*e1), e2) as th from x),
      s as (select *, case when r > 1e-12 then th * (1 + (0.1 + (-0.02 + 0.003*th*th)*th*th)*th*th) / r else 1.0 end as s from a)
    select vec_id, round(400*s*e0+320, 4) as u, round(400*s*e1+240, 4) as v from s""")
def fisheye(t: Tables):
    u, v = g.fisheye(_point(), 400.0, 320.0, 240.0, [0.1, -0.02, 0.003])
    return t.embeddings.select("vec_id", rounded(u, 4).alias("u"), rounded(v, 4).alias("v"))


@query("""with p as (select vec_id, i % 64 as x, i // 64 % 48 as y, (i % 64 - 32.0::double) / 40 as e0, (i // 64 % 48 - 24.0::double) / 40 as e1 from (select vec_id, vec_id * 37 as i from embeddings)), a as (select *, sqrt(e0*e0+e1*e1) as r, atan2(sqrt(e0*e0+e1*e1), 1) as th from p),
      s as (select *, case when r > 1e-12 then th * (1 + (0.1 + (-0.02 + 0.003*th*th)*th*th)*th*th) / r else 1.0 end as s from a)
    select vec_id, x, y, round(40*s*e0+32, 4) as map_x, round(40*s*e1+24, 4) as map_y from s""")
def fisheye_warp(t: Tables):
    """Where a pixel of a plain picture, for each vector one, lies in the fisheye one."""
    p = t.embeddings.select("vec_id", (F.col("vec_id") * 37 % 64).alias("x"), (F.floor(F.col("vec_id") * 37 / 64) % 48).cast("long").alias("y"))
    u, v = g.warped(F.col("x"), F.col("y"), 40.0, 32.0, 24.0, [0.1, -0.02, 0.003])
    return p.select("vec_id", "x", "y", rounded(u, 4).alias("map_x"), rounded(v, 4).alias("map_y"))


@query("select vec_id, cast(vec_id % 4 * 160 as bigint) as x, cast(vec_id // 4 * 120 as bigint) as y from embeddings")
def collage(t: Tables):
    x, y = g.collage_cell(F.col("vec_id"), 4, F.lit(160), F.lit(120))
    return t.embeddings.select("vec_id", x.cast("long").alias("x"), y.alias("y"))


@query(f"with {_XYZ} select vec_id, cast(round_even(e0 * 1000, 0) as bigint) as q, cast(ceil(cast(vec_id as double) / 48) * 48 as bigint) as padded from x")
def quantize(t: Tables):
    return t.embeddings.select("vec_id", g.quantize(_point()[0]).alias("q"), g.ceil_to(F.col("vec_id"), 48).alias("padded"))


@query(f"""with {_XYZ}, f as (select vec_id, sqrt(e0*e0+e1*e1+e2*e2) as n, e0, e1, e2 from x), s as (select *, sqrt(e2/n*(e2/n) + e0/n*(e0/n)) as m from f where n >= 1e-6)
    select vec_id, round(case when m >= 1e-6 then -e2/n/m end, 6) as sx, round(case when m >= 1e-6 then e0/n/m end, 6) as sz from s""")
def look_at(t: Tables):
    axes = g.look_at(_point())
    return t.embeddings.where(g.norm(_point()) >= 1e-6).select("vec_id", rounded(axes[0], 6).alias("sx"), rounded(axes[2], 6).alias("sz"))


@query("""with q as (select vec_id as q, embedding as v from embeddings where vec_id % 100 = 0),
      p as (select q, vec_id, row_number() over (partition by q order by list_distance(cast(v as double[]), cast(embedding as double[])), vec_id) as n from q join embeddings on vec_id <> q)
    select q, vec_id, n from p where n <= 5""")
def nearest_vectors(t: Tables):
    return neighbours.nearest_rows(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", 5).select("q", "vec_id", "n")
