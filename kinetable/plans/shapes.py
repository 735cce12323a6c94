"""Queries on coordinates, masks, grids, surfaces and trees, and on what users plug in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks, points
from ..operators import plugins, sampling, schedule
from .registry import Tables, query, rounded


def _e(n: int, start: int = 0):
    return [F.get("embedding", F.lit(start + i)).cast("double") for i in range(n)]


_X = lambda n: ", ".join(f"cast(embedding[{i + 1}] as double) as e{i}" for i in range(n))
_U = lambda key, seed: f"((({key}) + {seed}) % 2147483648) * 2654435761 % 4294967296 / 4294967296.0::double"


@query(f"""with x as (select vec_id, {_X(2)} from embeddings), y as (select vec_id, case when vec_id % 5 = 0 then null else e0 end as a, e1 as b from x)
    select vec_id, round(coalesce(a, 0), 6) as zero, round(coalesce(a, -1), 6) as const, round(least(1, greatest(0, coalesce(a, 0))), 6) as clipped from y""")
def clean_coordinates(t: Tables):
    x = F.when(F.col("vec_id") % 5 == 0, F.lit(float("nan"))).otherwise(_e(1)[0])
    clean = lambda v: rounded(F.nanvl(x, F.lit(v)), 6)
    return t.embeddings.select("vec_id", clean(0.0).alias("zero"), clean(-1.0).alias("const"), rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0)))), 6).alias("clipped"))


@query("""with p as (select o_orderkey, o_orderkey * 37 % 641 as x, o_orderkey * 53 % 481 as y from orders)
    select o_orderkey, cast(least(1000, round_even(x / 640.0 * 1000, 0)) as int) as xs, cast(least(1000, round_even(y / 480.0 * 1000, 0)) as int) as ys, round(least(1000, round_even(x / 640.0 * 1000, 0)) / 1000.0::double * 640, 6) as back from p""")
def pixel_round_trip(t: Tables):
    x, y = (F.col("o_orderkey") * 37) % 641, (F.col("o_orderkey") * 53) % 481
    xs, ys = points.scale(x, F.lit(640.0)), points.scale(y, F.lit(480.0))
    return t.orders.select("o_orderkey", xs.alias("xs"), ys.alias("ys"), rounded(points.unscale(xs, F.lit(640.0)), 6).alias("back"))


@query("""with p as (select o_orderkey, 640 + o_orderkey % 1281 as w, 360 + o_orderkey % 721 as h, o_orderkey % 640 as x, o_orderkey % 360 as y from orders), n as (select *, cast(round_even(w * 480.0::double / h / 2, 0) * 2 as bigint) as nw from p)
    select o_orderkey, nw as width, cast(round_even(cast(x * nw as double) / w, 0) as bigint) as x, cast(round_even(y * 480.0::double / h, 0) as bigint) as y from n""")
def rescale_480(t: Tables):
    k = F.col("o_orderkey")
    x, y, w = g.to_480p(k % 640, k % 360, 640 + k % 1281, 360 + k % 721)
    return t.orders.select("o_orderkey", w.alias("width"), x.alias("x"), y.alias("y"))


@query("""select vec_id, list_transform(range(16), lambda k: round((cast(embedding[k // 4 * 16 + k % 4 * 2 + 1] as double) + cast(embedding[k // 4 * 16 + k % 4 * 2 + 2] as double) + cast(embedding[k // 4 * 16 + k % 4 * 2 + 9] as double) + cast(embedding[k // 4 * 16 + k % 4 * 2 + 10] as double)) / 4, 6)) as half from embeddings""")
def depth_resize(t: Tables):
    """Maps of 8 by 8 as 4 by 4, by straight lines between centres."""
    return t.embeddings.select("vec_id", F.transform(g.resized(F.col("embedding"), 8, 8, 4, 4), lambda x: rounded(x, 6)).alias("half"))


@query(f"""with x as (select vec_id, {_X(2)}, vec_id % 60 as k from embeddings), p as (select *, e0 * 40 + 4 as x, e1 * 40 + 4 as y from x), q as (select *, cast(round_even(y, 0) as bigint) as i, cast(round_even(x, 0) as bigint) as j from p)
    select vec_id, i >= 0 and i < 8 and j >= 0 and j < 8 and j * 8 + i >= k and j * 8 + i < k + 3 as inside from q""")
def mask_points(t: Tables):
    """Whether points lie in a mask of runs: three pixels after the first vec_id % 60."""
    x, y = (v * 40 + 4 for v in _e(2))
    k = (F.col("vec_id") % 60).cast("int")
    return t.embeddings.select("vec_id", masks.point_in_mask(F.array(k, F.lit(3), 61 - k), F.lit(8), F.lit(8), x, y).alias("inside"))


@query(f"""with x as (select vec_id, {_X(2)} from embeddings), p as (select vec_id, e0 * 20 + 4 as x, e1 * 20 + 4 as y from x)
    , c as (select vec_id, ((0.5 > y) <> (7.5 > y)) and x < 1 + (y - 0.5) * (4.0 - 1) / (7.5 - 0.5) as a, ((7.5 > y) <> (1.5 > y)) and x < 4 + (y - 7.5) * (7.0 - 4) / (1.5 - 7.5) as b, ((1.5 > y) <> (0.5 > y)) and x < 7 + (y - 1.5) * (1.0 - 7) / (0.5 - 1.5) as c from p)
    select vec_id, (cast(a as int) + cast(b as int) + cast(c as int)) % 2 = 1 as inside from c""")
def polygon_points(t: Tables):
    x, y = (v * 20 + 4 for v in _e(2))
    corners = F.array(*[F.lit(v) for v in (1.0, 0.5, 4.0, 7.5, 7.0, 1.5)])
    return t.embeddings.select("vec_id", masks.point_in_polygon(x, y, corners).alias("inside"))


@query("""select s_suppkey, cast((s_suppkey % 5 + 2) * (s_suppkey % 3 + 1) as bigint) as area from supplier""")
def polygon_masks(t: Tables):
    """Pixels of right-angled polygons: as many as their area."""
    a, b = (F.col("s_suppkey") % 5 + 2).cast("double"), (F.col("s_suppkey") % 3 + 1).cast("double")
    corners = F.array(F.lit(1.0), F.lit(1.0), 1 + a, F.lit(1.0), 1 + a, 1 + b, F.lit(1.0), 1 + b)
    mask = masks.polygon_mask(corners, 8, 10)
    return t.supplier.select("s_suppkey", F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("area"))


_KINDS = ("sphere", "box", "cylinder", "capsule", "ellipsoid")


@query(f"""with p as (select p_partkey as k, ['sphere', 'box', 'cylinder', 'capsule', 'ellipsoid'][p_partkey % 5 + 1] as kind, 1.0::double + p_size % 3 as a, 0.5::double + p_size % 4 as b, 2.0::double as c, {_U("p_partkey * 3", 1)} as u, {_U("p_partkey * 5", 2)} as v, {_U("p_partkey * 7", 3)} as w from part),
      s as (select *, 2 * pi() * u as turn, 2 * v - 1 as up, sqrt(greatest(0, 1 - (2 * v - 1) * (2 * v - 1))) as ring, 2 * u - 1 as p, 2 * v - 1 as q, case when w * 1024 - 2 * floor(w * 1024 / 2) < 1 then 1.0 else -1.0 end as side from p),
      f as (select *, w * (a * b + b * c + a * c) as face, w * (2 * b + a) as tube, w * (2 * b + 2 * a) as cap from s)
    select k as p_partkey, kind,
      round(case kind when 'sphere' then a * ring * cos(turn) when 'box' then case when face < a * b then p * a when face < a * b + b * c then side * a else p * a end when 'cylinder' then a * case when tube < 2 * b then 1 else sqrt(v) end * cos(turn) when 'capsule' then case when cap < 2 * b then a * cos(turn) else a * ring * cos(turn) end else a * ring * cos(turn) end, 6) as x,
      round(case kind when 'sphere' then a * ring * sin(turn) when 'box' then case when face < a * b then q * b when face < a * b + b * c then p * b else side * b end when 'cylinder' then a * case when tube < 2 * b then 1 else sqrt(v) end * sin(turn) when 'capsule' then case when cap < 2 * b then a * sin(turn) else a * ring * sin(turn) end else b * ring * sin(turn) end, 6) as y,
      round(case kind when 'sphere' then a * up when 'box' then case when face < a * b then side * c else q * c end when 'cylinder' then case when tube < 2 * b then q * b when tube < 2 * b + a / 2 then b else -b end when 'capsule' then case when cap < 2 * b then q * b else a * up + case when up >= 0 then b else -b end end else c * up end, 6) as z from f""")
def surface_points(t: Tables):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    size = [1.0 + F.col("p_size") % 3, 0.5 + F.col("p_size") % 4, F.lit(2.0)]
    u, v, w = (sampling.uniform(F.col("p_partkey") * k, s) for k, s in ((3, 1), (5, 2), (7, 3)))
    x, y, z = g.surface_point(kind, size, u, v, w)
    return t.part.select("p_partkey", kind.alias("kind"), *[rounded(c, 6).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])


@query(f"""with x as (select label, vec_id, {_X(9)}, {_U("label * 3", 1)} as u, {_U("label * 5", 2)} as v, {_U("label * 7", 3)} as w from embeddings),
      n as (select *, (e4-e1)*(e8-e2)-(e5-e2)*(e7-e1) as nx, (e5-e2)*(e6-e0)-(e3-e0)*(e8-e2) as ny, (e3-e0)*(e7-e1)-(e4-e1)*(e6-e0) as nz from x), a as (select *, sqrt(nx*nx+ny*ny+nz*nz) / 2 as area from n),
      r as (select *, sum(area) over (partition by label order by vec_id rows between unbounded preceding and current row) as run, sum(area) over (partition by label) as total from a),
      k as (select *, row_number() over (partition by label order by vec_id) as rn from r where run > w * total)
    select label, vec_id, round((1 - sqrt(u)) * e0 + sqrt(u) * (1 - v) * e3 + sqrt(u) * v * e6, 6) as x from k where rn = 1""")
def mesh_points(t: Tables):
    """A point of each label's mesh: a triangle by area, then a place on it."""
    e = _e(9)
    corners = [e[:3], e[3:6], e[6:]]
    u, v, w = (sampling.uniform(F.col("label") * k, s) for k, s in ((3, 1), (5, 2), (7, 3)))
    x = g.triangle_point(corners, u, v)[0]
    rows = t.embeddings.select("label", "vec_id", g.triangle_area(corners).alias("area"), x.alias("x"))
    return schedule.weighted_choice(rows, ["label"], "vec_id", "area", w).select("label", "vec_id", rounded("x", 6).alias("x"))


@query("""with recursive e as (select p_partkey as child, (p_partkey - 1) // 3 as parent from part where p_partkey > 0), w(root, node) as (select r, r from (values (cast(1 as bigint)), (cast(4 as bigint)), (cast(40 as bigint))) as x(r) union all select w.root, e.child from w join e on e.parent = w.node)
    select root, node from w""")
def tree_closure(t: Tables):
    edges = t.part.where("p_partkey > 0").select(F.floor((F.col("p_partkey") - 1) / 3).cast("long").alias("parent"), F.col("p_partkey").alias("child"))
    return schedule.descendants(edges, t.spark.createDataFrame([(1,), (4,), (40,)], "root long"))


@query("""with x as (select vec_id, embedding as m, (vec_id * 7 % 71) / 10.0::double as x, (vec_id * 11 % 71) / 10.0::double as y from embeddings), f as (select *, cast(floor(x) as bigint) as x0, cast(floor(y) as bigint) as y0 from x),
      k as (select *, least(7, x0 + 1) as x1, least(7, y0 + 1) as y1, x - x0 as fx, y - y0 as fy from f)
    select vec_id, round((cast(m[y0 * 8 + x0 + 1] as double) * (1 - fx) + cast(m[y0 * 8 + x1 + 1] as double) * fx) * (1 - fy) + (cast(m[y1 * 8 + x0 + 1] as double) * (1 - fx) + cast(m[y1 * 8 + x1 + 1] as double) * fx) * fy, 6) as v from k""")
def grid_samples(t: Tables):
    x, y = (((F.col("vec_id") * k) % 71) / 10.0 for k in (7, 11))
    return t.embeddings.select("vec_id", rounded(g.bilinear(F.col("embedding"), 8, 8, x, y), 6).alias("v"))


@query(f"""with x as (select vec_id, {_X(4)} from embeddings) select vec_id, 0.0::double as error, round(1 / (2 + e0), 6) as first, round(-e1 / ((2 + e0) * 3), 6) as second from x""")
def matrix_inverse(t: Tables):
    """Inverses of 4 by 4 matrices: how far their product with the matrix is from one, and two
    entries that are known for this shape (upper triangular with a known diagonal)."""
    e0, e1, e2, e3 = _e(4)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = [2 + e0, e1, zero, e2, zero, F.lit(3.0), zero, e3, zero, zero, F.lit(0.5), zero, zero, zero, zero, one]
    inv = g.inverse4(m)
    off = [F.abs(p - (1.0 if i % 5 == 0 else 0.0)) for i, p in enumerate(g.product4(m, inv))]
    return t.embeddings.select("vec_id", rounded(F.greatest(*off), 6).alias("error"), rounded(inv[0], 6).alias("first"), rounded(inv[1], 6).alias("second"))


REGISTRY = plugins.Registry()
REGISTRY.add("evaluator", "mean_price")(plugins.Evaluator({"s": "l_extendedprice * l_quantity", "w": "l_quantity"}, lambda c: c["s"] / c["w"]))
REGISTRY.add("sampler", "few")(plugins.FrameSampler(most=4, stride=2))


@query("select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as mean_price from lineitem group by l_returnflag")
def evaluator_merge(t: Tables):
    """A registered evaluator, run on three parts of a table apart and merged."""
    e, by = REGISTRY.get("evaluator", "mean_price"), ["l_returnflag"]
    parts = [e.partial(t.lineitem.where(F.col("l_orderkey") % 3 == k), by) for k in range(3)]
    return e.finish(e.merge(*parts, by=by), by, "mean_price").withColumn("mean_price", rounded("mean_price", 4))


@query("""with n as (select count(*) as n from supplier), w as (select n, (n + 7) // 8 * 8 as want from n), p as (select n, want, i // want as epoch, i % want as place from w cross join (select unnest(range(100000)) as i) where i < 2 * want),
      s as (select p.*, (epoch * n + place % n) as at_place from p), r as (select *, ((at_place % n) * case when n % 7 <> 0 then 7 when n % 11 <> 0 then 11 else 13 end + (at_place // n + 1) * 1) % n as row from s)
    select r.epoch, r.place, concat(k.s_suppkey, '@', r.epoch) as example, r.place < r.n as valid, cast(r.place < r.n as double) as weight from r join (select s_suppkey, row_number() over (order by s_suppkey) - 1 as row from supplier) k on k.row = r.row""")
def padded_examples(t: Tables):
    """Two epochs of examples, filled up to batches of eight."""
    return plugins.examples(t.supplier, "s_suppkey", lambda k, e: F.concat(k.cast("string"), F.lit("@"), e.cast("string")), 2, 8)


@query("""select doc_id, list_transform(string_split(source, 'r'), lambda s: cast(length(s) as int)) as ids from documents""")
def collated_examples(t: Tables):
    """A preparation and a collator over Arrow batches."""

    def collate(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [[len(p) for p in s.split("r")] for s in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return plugins.collated(t.documents, ["doc_id", "source"], collate, "doc_id long, ids array<int>")


@query("""with d as (select doc_id, n_chars % 40 + 1 as n from documents), k as (select doc_id, greatest(1, (n + 1) // 2) as there, greatest(1, (n + 2) // 3) as there3 from d)
    select doc_id, list_transform(range(least(4, there)), lambda i: i * there // least(4, there) * 2) as own, list_transform(range(least(2, there3)), lambda i: i * there3 // least(2, there3) * 3) as asked from k""")
def frame_sampler(t: Tables):
    """Frames by a registered sampler, with its own numbers and with others for one call."""
    s, n = REGISTRY.get("sampler", "few"), F.col("n_chars") % 40 + 1
    return t.documents.select("doc_id", s.frames(n).alias("own"), s.frames(n, most=2, stride=3).alias("asked"))


@query("select vec_id, round(2 * cast(embedding[1] as double) - cast(embedding[2] as double) + 0.5, 5) as forecast from embeddings")
def model_forecast(t: Tables):
    """A model as a function of batches, made once for each task."""

    def model():
        weights = (2.0, -1.0, 0.5)
        return lambda f: f.assign(forecast=(f["a"] * weights[0] + f["b"] * weights[1] + weights[2]).round(5))[["vec_id", "forecast"]]

    a, b = _e(2)
    return schedule.predict(t.embeddings.select("vec_id", a.alias("a"), b.alias("b")), model, ["vec_id", "a", "b"], "vec_id long, forecast double")
