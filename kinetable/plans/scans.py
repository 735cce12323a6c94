"""Queries that write tables in the formats of the sources and read them back: what comes out
must be what SQL says of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import joins, sequences
from ..sources import archives, files, manifests, pictured, pictures, tracks
from ..sources.catalogue import Catalogue, Source
from ..storage import new_folder
from .registry import Tables, query, rounded

ORDER = ["ts", "event_id"]
_K = """k as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as frame from events)"""


def track_rows(t: Tables, key: list[str] = ("user_id", "event_type")):
    """Events as tracks: a user's are a file, an event type an object with one point."""
    k = sequences.frame_index(t.events, list(key), ORDER)
    return k.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".npz")).alias("file"), F.col("event_type").alias("obj"), F.lit(0).alias("point_id"), F.col("frame").cast("int").alias("frame"),
        F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.lit(1.0).alias("z"), (F.col("value") <= 60).alias("visible"),
    )


def _x():
    return rounded(F.col("x").cast("double"), 2).alias("x")


@query(f"with {_K} select concat('user_', user_id, '.npz') as file, event_type as obj, cast(frame as int) as frame, round(value, 2) as x, value <= 60 as visible from k")
def npz_objects(t: Tables):
    """Archives with arrays by object and stored visibility."""
    folder = tracks.write_tracks(track_rows(t), new_folder(t.spark, "npz"))
    return tracks.read_tracks(t.spark, folder).select("file", "obj", "frame", _x(), "visible")


_FLAT = """e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)"""


def flat_rows(t: Tables):
    """A user's events as one object: the point is the event type's number, the frame the event's."""
    point = F.array_position(F.array(*[F.lit(c) for c in ("click", "error", "login", "purchase", "view")]), F.col("event_type"))
    k = sequences.frame_index(t.events, ["user_id"], ORDER)
    return k.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".npz")).alias("file"), F.lit(tracks.FLAT).alias("obj"), point.cast("int").alias("point_id"), F.col("frame").cast("int").alias("frame"),
        F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.lit(1.0).alias("z"), (F.col("value") <= 60).alias("visible"),
    )


_POINT = "coalesce(list_position(['click', 'error', 'login', 'purchase', 'view'], event_type), 0)"


@query(f"with {_FLAT} select concat('user_', user_id, '.npz') as file, cast({_POINT} as int) as point_id, cast(frame as int) as frame, round(value, 2) as x, value <= 60 as visible from e")
def npz_frames_first(t: Tables):
    """Flat archives with frames first and the validity of each point."""
    folder = tracks.write_tracks(flat_rows(t), new_folder(t.spark, "npz"), visible="valid_3d", layout="tnc")
    rows = tracks.read_tracks(t.spark, folder, visible="valid_3d", layout="tnc")
    return rows.where("x is not null").select("file", "point_id", "frame", _x(), "visible")


@query(f"with {_FLAT} select concat('user_', user_id, '.npz') as file, cast(frame // 3 as int) as frame, round(value, 2) as x from e where frame % 3 = 0")
def npz_strided(t: Tables):
    folder = tracks.write_tracks(flat_rows(t), new_folder(t.spark, "npz"))
    return tracks.read_tracks(t.spark, folder, stride=3).where("x is not null").select("file", "frame", _x())


@query(f"with {_FLAT} select concat('user_', user_id, '.npz') as file, cast(frame as int) as frame, case when value <= 60 then round(value, 2) end as x, value <= 60 as visible from e")
def npz_missing_numbers(t: Tables):
    """Visibility from what isn't a number."""
    rows = flat_rows(t).withColumn("point_id", F.lit(0)).withColumn("x", F.when(F.col("x") <= 60, F.col("x")))
    folder = tracks.write_tracks(rows, new_folder(t.spark, "npz"), visible=None)
    return tracks.read_tracks(t.spark, folder).select("file", "frame", _x(), "visible")


@query(f"with {_K} select concat('clip_', user_id) as clip, case when event_type = 'view' then 'object' else event_type end as obj, count(*) as n_frames from k group by 1, 2")
def npz_named_objects(t: Tables):
    """One archive an object, whose name is in the file's; without a name it is ``object``."""
    rows = track_rows(t)
    name = F.concat(F.lit("clip_"), F.regexp_extract("file", "(\\d+)", 1), F.when(F.col("obj") == "view", "").otherwise(F.concat(F.lit("__"), "obj")), F.lit(".npz"))
    folder = tracks.write_tracks(rows.withColumn("file", name).withColumn("obj", F.lit(tracks.FLAT)), new_folder(t.spark, "npz"))
    back = tracks.read_tracks(t.spark, folder)
    obj = F.regexp_extract("file", "__(\\w+)\\.npz$", 1)
    return back.groupBy(F.regexp_extract("file", "^(clip_\\d+)", 1).alias("clip"), F.when(obj == "", "object").otherwise(obj).alias("obj")).agg(F.count("*").alias("n_frames"))


_BLOCKS = """b as (select *, row_number() over (order by vec_id) - 1 as place from embeddings)"""


@query("""select label as object_id, count(*) as n_points, round(sum(round(cast(embedding[1] as double), 4)), 3) as total from embeddings group by label""")
def npz_object_ids(t: Tables):
    """One archive of all points with an id of the object for each: a mask by id."""
    return _vectors(t).where("x is not null").groupBy("object_id").agg(F.count("*").alias("n_points"), rounded(F.sum(rounded(F.col("x").cast("double"), 4)), 3).alias("total"))


def _vectors(t: Tables):
    p = t.embeddings.select(F.concat(F.lit("part_"), F.floor(F.col("vec_id") / 1000).cast("string"), F.lit(".npz")).alias("file"), F.lit(tracks.FLAT).alias("obj"), (F.col("vec_id") % 1000).cast("int").alias("point_id"), F.lit(0).alias("frame"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")], F.lit(True).alias("visible"), F.col("label").alias("object_id"))
    return tracks.read_tracks(t.spark, tracks.write_tracks(p, new_folder(t.spark, "npz")))


@query("""select cast(vec_id % 1000 // 100 as bigint) as block, count(*) as n_points, round(min(round(cast(embedding[2] as double), 4)), 4) as least from embeddings group by 1""")
def npz_blocks(t: Tables):
    """Points in blocks of a hundred, one for each object."""
    return _vectors(t).where("x is not null").groupBy(F.floor(F.col("point_id") / 100).cast("long").alias("block")).agg(F.count("*").alias("n_points"), rounded(F.min(rounded(F.col("y").cast("double"), 4)), 4).alias("least"))


@query(f"""with {_FLAT}, u as (select user_id, max(frame) as last from e group by user_id)
    select u.user_id, case when u.user_id % 4 <> 0 and value <= 80 then round(value / 100, 4) when u.user_id % 4 <> 0 then 0.5 end as x, case when u.user_id % 4 <> 0 and value <= 80 then round(event_id % 100 / 100.0::double, 4) when u.user_id % 4 <> 0 then 0.5 end as y
    from u left join e on e.user_id = u.user_id and e.frame = least(u.last, 5)""")
def npz_pictures(t: Tables):
    """Two-dimensional points at one frame (clamped to the last), in shares of the picture: what
    isn't a number is the middle, and an archive that isn't there gives none."""
    rows = flat_rows(t).withColumn("point_id", F.lit(0)).withColumn("x", F.when(F.col("x") <= 80, F.col("x"))).drop("z")
    users = t.events.groupBy("user_id").agg((F.count("*") - 1).cast("int").alias("last")).withColumn("file", F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".npz")))
    folder = tracks.write_tracks(rows.where("cast(regexp_extract(file, '([0-9]+)', 1) as int) % 4 <> 0"), new_folder(t.spark, "npz"), points="points_2d", dims=2)
    p = tracks.read_tracks(t.spark, folder, points="points_2d").select("file", "frame", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.lit(True).alias("there"))
    j = users.withColumn("frame", F.least("last", F.lit(5))).join(p, ["file", "frame"], "left")
    share = lambda c, size: F.when(F.col("there"), g.picture_share(F.when(F.col("px").isNotNull(), F.col(c)), F.lit(size)))
    return j.select("user_id", rounded(share("px", 100.0), 4).alias("x"), rounded(share("py", 100.0), 4).alias("y"))


@query(f"""with {_FLAT}, n as (select user_id, count(*) as t from e group by 1), r as (select user_id, t, user_id % 7 as kind, p from n cross join (select unnest(range(2)) as p)),
      a as (select *, case kind when 2 then 4 when 6 then p else 2 end as f, case kind when 6 then 2 else p end as q, case when kind in (1, 3, 6) then 0 else 50 end as moved, case kind when 3 then 512 when 5 then 854 else 640 end as w, case kind when 3 then 512 else 480 end as h,
        t > case kind when 2 then 4 when 6 then 1 else 2 end as there from r),
      v as (select a.*, case when e.value <= 80 then cast(cast(e.value * 3 + 100 * q + moved as float) as double) end as x, e.event_id % 100 + 7 * q as y from a left join e on e.user_id = a.user_id and e.frame = a.f)
    select user_id, kind, cast(p as bigint) as point_id, case when there then round(least(1, greatest(0, coalesce(x, w / 2.0::double) / w)), 4) end as x, case when there then round(least(1, greatest(0, y / h::double)), 4) end as y from v""")
def picture_forms(t: Tables):
    """Points of pictures from archives of seven forms, one for each user: objects or one array,
    frames or points first, strided, sizes named or fixed, blocks, and axes read in the wrong order."""
    base = sequences.frame_index(t.events, ["user_id"], ORDER).select("user_id", F.col("frame").cast("int").alias("frame"), "value", "event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("stem"))
    point = lambda obj, k, moved: F.struct(F.lit(obj).alias("obj"), F.lit(k).alias("point_id"), F.lit(k % 10).alias("q"), F.lit(moved).alias("moved"))
    named = F.array(*[point("a", k, 0) for k in range(3)], *[point("b", k, 50) for k in range(2)])
    flat = F.array(*[point(tracks.FLAT, k, 0) for k in range(3)])
    block = F.array(*[point(tracks.FLAT, k, 0) for k in range(3)], *[F.struct(F.lit(tracks.FLAT).alias("obj"), F.lit(3 + k).alias("point_id"), F.lit(k).alias("q"), F.lit(50).alias("moved")) for k in range(2)])

    def rows(kind: int, points, suffix: str):
        x = base.where(F.col("user_id") % 7 == kind).select("stem", "frame", "value", "event_id", F.explode(points).alias("c"))
        x = x.select(F.concat("stem", F.lit(suffix)).alias("file"), F.col("c.obj").alias("obj"), F.col("c.point_id").alias("point_id"), "frame", F.when(F.col("value") <= 80, F.col("value") * 3 + 100 * F.col("c.q") + F.col("c.moved")).alias("x"), (F.col("event_id") % 100 + 7 * F.col("c.q")).cast("double").alias("y"), F.lit(True).alias("visible"))
        return x.withColumn("z", F.lit(0.0)) if suffix == "_3d.npz" else x

    out, dim = None, {"dim": [480, 640]}
    for kind, (name, points, array, layout, extra) in enumerate([("frames", named, "tracks", "tnc", dim), ("named_size", flat, "tracks_2d", "tnc", {"ds_dim": [480, 640]}), ("strided", named, "tracks", "tnc", dim), ("inside", flat, "pixel_coords", "ntc", None), ("blocks", block, "tracks", "tnc", dim), ("fixed", named, "tracks", "tnc", None), ("swapped", named, "tracks", "tnc", dim)]):
        form, folder = pictured.FORMS[name], new_folder(t.spark, f"form_{name}")
        tracks.write_tracks(rows(kind, points, form.suffix), folder, points=array, visible=None, layout=layout, dims=2, extra=extra)
        if form.blocks:
            tracks.write_tracks(rows(kind, named, form.blocks), folder)
        asked = base.where(F.col("user_id") % 7 == kind).select("stem", "user_id").distinct().select("stem", F.lit("a" if name == "swapped" else "b").alias("obj"), F.explode(F.array(F.lit(0), F.lit(1))).alias("point_id"), F.lit(2).alias("frame"))
        got = pictured.picture_points(t.spark, folder, form, asked).withColumn("kind", F.lit(kind).cast("long"))
        out = got if out is None else out.unionByName(got)
    return out.select(F.regexp_extract("stem", "[0-9]+", 0).cast("long").alias("user_id"), "kind", "point_id", rounded("x", 4).alias("x"), rounded("y", 4).alias("y"))


@query("""select vec_id, round(least(1, greatest(0, (500 * e0 / greatest(e2, 1e-6) + 320) / 640)), 6) as u, round(least(1, greatest(0, (500 * e1 / greatest(e2, 1e-6) + 240) / 480)), 6) as v
    from (select vec_id, cast(embedding[1] as double) as e0, cast(embedding[2] as double) as e1, cast(embedding[3] as double) as e2 from embeddings)""")
def bench_projection(t: Tables):
    """Points of a picture from points of the space, clipped to the picture."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    u, v = g.pinhole(e, 500.0, 500.0, 320.0, 240.0)
    return t.embeddings.select("vec_id", rounded(g.picture_share(u, F.lit(640.0)), 6).alias("u"), rounded(g.picture_share(v, F.lit(480.0)), 6).alias("v"))


@query("""with x as (select vec_id, label % 3 as kind, """ + ", ".join(f"cast(embedding[{i + 1}] as double) as e{i}" for i in range(10)) + """ from embeddings), q as (select *, e3*e3 + e4*e4 + e5*e5 + e6*e6 as n from x),
    r as (select *, 1-2*(e5*e5+e6*e6)/n as r0, 2*(e4*e5-e6*e3)/n as r1, 2*(e4*e6+e5*e3)/n as r2, 2*(e4*e5+e6*e3)/n as r3, 1-2*(e4*e4+e6*e6)/n as r4, 2*(e5*e6-e4*e3)/n as r5, 2*(e4*e6-e5*e3)/n as r6, 2*(e5*e6+e4*e3)/n as r7, 1-2*(e4*e4+e5*e5)/n as r8 from q)
    select vec_id, case kind when 0 then 'inverse' when 1 then 'identity' else 'given' end as kind,
      round(case kind when 0 then r0*(e0-e7)+r3*(e1-e8)+r6*(e2-e9) when 1 then e0 else r0*e0+r1*e1+r2*e2+e7 end, 5) as x, round(case kind when 0 then r1*(e0-e7)+r4*(e1-e8)+r7*(e2-e9) when 1 then e1 else r3*e0+r4*e1+r5*e2+e8 end, 5) as y from r""")
def camera_by_source(t: Tables):
    """Points in camera space: some sources give the camera's place in the world (inverted here),
    some none, some the transform itself."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(10)]
    rot, shift, p = g.quaternion_rotation(*e[3:7]), e[7:10], e[:3]
    back, undo = g.rigid_inverse(rot, shift)
    kinds = {0: ("inverse", g.transform_point(back, undo, p)), 1: ("identity", p), 2: ("given", g.transform_point(rot, shift, p))}
    by = lambda f: F.when(F.col("label") % 3 == 0, f(kinds[0])).when(F.col("label") % 3 == 1, f(kinds[1])).otherwise(f(kinds[2]))
    return t.embeddings.select("vec_id", by(lambda k: F.lit(k[0])).alias("kind"), rounded(by(lambda k: k[1][0]), 5).alias("x"), rounded(by(lambda k: k[1][1]), 5).alias("y"))


@query("""with d as (select vec_id, label, list_transform(embedding, lambda v: cast(round_even(abs(cast(v as double)) * 1000, 0) as bigint)) as mm, row_number() over (partition by label order by vec_id) - 1 as k from embeddings)
    select label, k as frame, round(list_sum(mm) / 64000.0, 6) as mean_depth from d where k % 2 = 0""")
def depth_scan(t: Tables):
    """Depth in whole millimetres from archives, through the frames' index, in metres."""
    w = Window.partitionBy("label").orderBy("vec_id")
    d = t.embeddings.withColumn("frame", (F.row_number().over(w) - 1).cast("long"))
    rows = d.where("frame % 2 = 0").withColumn("place", (F.col("frame") / 2).cast("int"))
    mm = F.transform("embedding", lambda v: F.rint(F.abs(v.cast("double")) * 1000).cast("int"))
    from ..sources import depth

    folder = depth.write_depth(rows.select(F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit(".npz")).alias("file"), "place", "frame", mm.alias("mm")), new_folder(t.spark, "depth"), 8)
    back = depth.read_depth(t.spark, folder)
    metres = F.aggregate("mm", F.lit(0).cast("long"), lambda a, x: a + x) / 64000.0
    return back.select(F.regexp_extract("file", "_(\\d+)", 1).cast("int").alias("label"), "frame", rounded(metres, 6).alias("mean_depth"))


@query(f"""with {_FLAT} select concat('user_', user_id, '.npz') as file, cast(max({_POINT}) + 1 as bigint) as n_points, max(frame) + 1 as n_frames, case when user_id % 2 = 0 then concat('caption of ', user_id) else '' end as caption from e group by user_id""")
def directory_listing(t: Tables):
    """Archives of a folder, their shapes from the headers alone, and captions where there are any."""
    folder = tracks.write_tracks(flat_rows(t), new_folder(t.spark, "npz"))
    captions = t.events.where("user_id % 2 = 0").select(F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".npz")).alias("file"), F.concat(F.lit("caption of "), F.col("user_id").cast("string")).alias("caption")).distinct()
    shapes = tracks.archive_shapes(t.spark, folder)
    return shapes.join(captions, "file", "left").select("file", "n_points", "n_frames", F.coalesce("caption", F.lit("")).alias("caption"))


@query("select concat('house_', s_suppkey) as house from supplier where s_suppkey % 3 = 0")
def house_discovery(t: Tables):
    """Folders with the right beginning that hold the file looked for."""
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 5 == 4, "old_house_").otherwise("house_"), k.cast("string"), F.when(k % 3 == 0, "/tracks.npz").otherwise("/notes.txt"))
    path = F.when(k % 3 == 0, F.concat(F.lit("house_"), k.cast("string"), F.lit("/tracks.npz"))).otherwise(path)
    folder = files.write_files(t.supplier.select(path.alias("path"), F.lit("x").cast("binary").alias("content")), new_folder(t.spark, "houses"))
    there = files.directory(t.spark, folder)
    return there.where(F.col("path").rlike("^house_\\d+/tracks\\.npz$")).select(F.regexp_extract("path", "^([^/]+)/", 1).alias("house"))


ENTRY = "file:string,num_frames:int,clips_by_object:map<string,array<array<int>>>"


def entries(t: Tables):
    """Documents as entries of manifests: frames by length, clips for two objects."""
    n = (F.col("n_chars") % 500).cast("int")
    clip = lambda a, b: F.array(a, b)
    clips = F.create_map(F.lit("hand"), F.array(clip(F.lit(0), F.floor(n / 2).cast("int")), clip(F.floor(n / 2).cast("int") + 1, n)), F.col("lang"), F.array(clip(F.lit(3), F.lit(9))))
    return t.documents.select(F.col("source").alias("dataset"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("file"), n.alias("num_frames"), clips.alias("clips_by_object"))


@query("select source as dataset, 'test' as split, concat('v', doc_id) as file, cast(n_chars % 500 as int) as num_frames, true as evaluating from documents where doc_id % 5 = 0 union all select source, case when doc_id % 5 = 0 then 'test' else 'train' end, concat('v', doc_id), cast(n_chars % 500 as int), false from documents")
def manifest_scan(t: Tables):
    folder = manifests.write_manifest(entries(t), new_folder(t.spark, "manifests"))
    part = lambda train: manifests.read_manifests(t.spark, folder, train, ENTRY).select("dataset", "split", "file", "num_frames", F.lit(not train).alias("evaluating"))
    return part(False).unionByName(part(True))


@query("""with c as (select concat('v', doc_id) as file, 'hand' as obj, 0 as k, 0 as a, cast(n_chars % 500 // 2 as int) as b from documents union all select concat('v', doc_id), 'hand', 1, cast(n_chars % 500 // 2 as int) + 1, cast(n_chars % 500 as int) from documents
      union all select concat('v', doc_id), lang, 0, 3, 9 from documents) select file, obj, cast(k as int) as clip_idx, cast(a as int) as "begin", cast(b as int) as "end" from c""")
def clip_rows(t: Tables):
    return manifests.clips(entries(t)).select("file", "obj", "clip_idx", "begin", "end")


@query("""with c as (select doc_id, n_chars % 500 as n, n_chars % 500 // 2 as h from documents) select concat('v', doc_id) as file, cast(ceil(n / 4.0) as int) as num_frames,
      cast(1 + cast(n // 4 >= (h + 1) // 4 as int) as int) as n_hand, cast(case when n // 4 >= (h + 1) // 4 then n // 4 else h // 4 end as int) as last from c""")
def stride_rescale(t: Tables):
    e = manifests.rescale_frames(entries(t), 4)
    hand = F.element_at("clips_by_object", "hand")
    return e.select("file", "num_frames", F.size(hand).alias("n_hand"), F.element_at(F.element_at(hand, -1), 2).alias("last"))


@query("""select concat('v', doc_id) as file, cast(case when doc_id % 3 = 1 then 2 else 3 end as int) as n from documents where doc_id % 3 in (0, 1)""")
def listed_objects(t: Tables):
    """Entries with the objects that the archives have: all, one, or the file isn't listed."""
    k = t.documents.where("doc_id % 3 < 2").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("file"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(tracks.FLAT))).otherwise(F.array(F.lit("hand"))).alias("keys"))
    return manifests.keep_listed_objects(entries(t), k).select("file", F.col("num_clips_total").cast("int").alias("n"))


@query(f"""with {_K} select 'by_object' as dataset, count(*) as n_rows, count(*) filter (value <= 60) as n_visible from k union all select 'flat', count(*), count(*) filter (value <= 60) from events""")
def source_catalogue(t: Tables):
    """Sources by name, each with its layout, scanned in one call."""
    a = tracks.write_tracks(track_rows(t), new_folder(t.spark, "npz"))
    b = tracks.write_tracks(flat_rows(t), new_folder(t.spark, "npz"), visible="valid_3d", layout="tnc")
    c = Catalogue(Source("by_object", "KINETABLE_BY_OBJECT", a), Source("flat", "KINETABLE_FLAT", b, options={"visible": "valid_3d", "layout": "tnc"}))
    return c.scan(t.spark).where("x is not null").groupBy("dataset").agg(F.count("*").alias("n_rows"), F.count_if("visible").alias("n_visible"))


@query("select p_brand, count(*) as n from part group by p_brand")
def hub_scan(t: Tables):
    return manifests.hub_scan(t.spark, f"{t.folder}/part.parquet", in_memory=False).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("select conv_id, turn, role, conv_id % 7 as style, 'talk' as kind from conversations")
def flat_messages(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.array(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("messages"), (F.col("conv_id") % 7).alias("metadata/style"), F.lit("talk").alias("metadata/kind"))
    return manifests.flat_messages(c, "messages").select("conv_id", "turn", "role", "metadata.style", "metadata.kind")


@query("select doc_id as task, lang as action from documents")
def task_list(t: Tables):
    folder, even = new_folder(t.spark, "tasks"), F.col("doc_id") % 2 == 0
    t.documents.select(F.col("doc_id").alias("task"), F.when(even, F.col("lang")).alias("action"), F.when(~even, F.col("lang")).alias("language_instruction")).write.json(folder)
    return manifests.task_list(t.spark, folder)


def _tars(t: Tables) -> str:
    name = F.concat(F.lit("frame_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))
    return archives.write_tars(t.documents.select(F.concat("source", F.lit(".tar")).alias("archive"), name.alias("member"), F.col("lang").cast("binary").alias("data")), new_folder(t.spark, "tars"))


@query("select concat(source, '.tar') as archive, cast(max(doc_id) + 1 as int) as n_frames from documents group by source")
def tar_frames(t: Tables):
    return archives.number_of_frames(archives.tar_members(t.spark, _tars(t)))


@query("select concat(source, '.tar') as archive, concat('frame_', lpad(cast(doc_id as varchar), 9, '0'), '.txt') as member, cast(length(lang) as bigint) as size from documents")
def tar_members(t: Tables):
    return archives.tar_members(t.spark, _tars(t))


@query("""select 'ran' as first, 'skipped' as second, count(*) as n_files from documents where source = (select min(source) from documents)""")
def unpack_once(t: Tables):
    tars = _tars(t)
    first = files.listed(t.spark, f"{tars}/*.tar")[0]
    target = new_folder(t.spark, "unpacked")
    ran = ["ran" if files.fetched_once(t.spark, first, target, archives.unpacked) else "skipped" for _ in range(2)]
    there = files.directory(t.spark, target, "frame_*")
    return there.agg(F.count("*").alias("n_files")).select(F.lit(ran[0]).alias("first"), F.lit(ran[1]).alias("second"), "n_files")


@query("select o_orderkey from orders where o_orderkey % 3 <> 0")
def resume_results(t: Tables):
    """Work that isn't in the results yet; a line cut short by a crash doesn't count as done."""
    folder = new_folder(t.spark, "results")
    out = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("example_id"), F.lit(0.5).alias("l2"))
    manifests.append_results(out.where("example_id % 2 = 0"), folder)
    manifests.append_results(out.where("example_id % 2 = 1"), folder)
    t.spark.createDataFrame([('{"example_id": "1", "l2"',)], "value string").write.mode("append").text(folder)
    done = manifests.read_results(t.spark, folder).select(F.col("example_id").try_cast("long").alias("o_orderkey")).where("o_orderkey is not null")
    return joins.without_done(t.orders.select("o_orderkey"), done, ["o_orderkey"])


@query("""select * from (values ('PAR1', true, false, true)) as x(magic, there, missing, longer)""")
def file_facts(t: Tables):
    """Facts of a file in any store: its first bytes, whether it is there, its size."""
    found = files.listed(t.spark, f"{t.folder}/part.parquet*")[0]
    one = found if found.endswith(".parquet") and not files.listed(t.spark, f"{found}/part-*") else files.listed(t.spark, f"{found}/part-*")[0]
    row = (files.byte_range(t.spark, one, 0, 4).decode(), files.exists(t.spark, one), files.exists(t.spark, one + ".none"), files.size_of(t.spark, one) > 100)
    return t.spark.createDataFrame([row], "magic string, there boolean, missing boolean, longer boolean")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def scalar_results(t: Tables):
    """Results of all tasks gathered as JSON, without their arrays."""
    folder = new_folder(t.spark, "scalars")
    archives.write_scalars(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.array("o_custkey").alias("more")), folder)
    back = t.spark.read.json(folder)
    assert "more" not in back.columns
    return back.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select count(*) as n, round(avg(o_totalprice), 4) as mean_price, true as done, false as early from orders")
def summary_mark(t: Tables):
    """A summary file, and a mark only once all is there."""
    import json

    folder = new_folder(t.spark, "summary")
    r = t.orders.agg(F.count("*").alias("n"), rounded(F.avg("o_totalprice"), 4).alias("m")).first()
    files.write_summary(t.spark, folder, {"n": r["n"]}, complete=False)
    early = files.exists(t.spark, f"{folder}/DONE")
    files.write_summary(t.spark, folder, {"n": r["n"], "mean_price": r["m"]}, complete=True)
    path = f"{folder}/summary.json"
    s = json.loads(files.byte_range(t.spark, path, 0, files.size_of(t.spark, path)))
    return t.spark.createDataFrame([(s["n"], s["mean_price"], files.exists(t.spark, f"{folder}/DONE"), early)], "n long, mean_price double, done boolean, early boolean")


@query("""with f as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events), a as (select user_id, frame, frame - row_number() over (partition by user_id order by frame) as g from f where value >= 10)
    select user_id, min(frame) as "begin", max(frame) as "end" from a group by user_id, g having count(*) >= 3""")
def clip_manifest(t: Tables):
    f = sequences.frame_index(t.events, ["user_id"], ORDER)
    clips, folder = sequences.islands(f, ["user_id"], "frame", F.col("value") >= 10, min_gap=1, min_length=3), new_folder(t.spark, "clips")
    clips.write.json(folder)
    return t.spark.read.schema("user_id long, begin long, end long").json(folder)


@query("""with l as (select l_suppkey % 5 as house, l_orderkey % 7 as file, l_linenumber as traj, count(*) as n from lineitem group by 1, 2, 3),
      f as (select house, file, concat('{', string_agg(concat('"', traj, '":', n), ',' order by cast(traj as varchar)), '}') as m from l group by 1, 2)
    select house, concat('{"', house, '":{', string_agg(concat('"', file, '":', m), ',' order by cast(file as varchar)), '}}') as "index" from f group by house""")
def length_index(t: Tables):
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("house"), (F.col("l_orderkey") % 7).alias("file"), F.col("l_linenumber").alias("traj")).agg(F.count("*").alias("length"))
    return manifests.valid_length_index(rows)


@query("""select vec_id, list_transform([1, 3, 5], lambda i: round(cast(embedding[i] as double), 4)) as track from embeddings where vec_id % 4 = 0
    union all select vec_id, list_transform([1, 3, 5], lambda i: round(cast(embedding[i + 1] as double), 4)) from embeddings where vec_id % 4 <> 0""")
def exported_tracks(t: Tables):
    """Forecasts of chosen points as JSON, some with the start before them."""
    start, folder = F.col("vec_id") % 4 == 0, new_folder(t.spark, "export")
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = t.embeddings.select("vec_id", sequences.exported(F.slice(v, 2, 63), F.get(v, F.lit(0)), start).alias("track"))
    out.write.json(folder)
    back = t.spark.read.schema("vec_id long, track array<double>").json(folder)
    return back.select("vec_id", F.transform(F.array(*[F.get("track", F.lit(i)) for i in (0, 2, 4)]), lambda x: rounded(x, 4)).alias("track"))


@query("""select 'p' || cast(vec_id as varchar) || '.npy' as file, [case when vec_id % 4 = 0 then 16 else 15 end, 4] as shape, round(list_sum([x::double for x in embedding]) - case when vec_id % 4 = 0 then 0 else list_sum([x::double for x in embedding[:4]]) end, 4) as total from embeddings""")
def exported_arrays(t: Tables):
    """Forecasts as arrays of four numbers a step, some with the start before them, and back."""
    v, start = F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id") % 4 == 0
    out = t.embeddings.select(F.format_string("p%d.npy", "vec_id").alias("name"), F.when(start, v).otherwise(F.slice(v, 5, 60)).alias("v"))
    back = tracks.read_arrays(t.spark, tracks.write_arrays(out, new_folder(t.spark, "npy"), "name", "v", 4))
    return back.select("file", F.transform("shape", lambda n: n.cast("int")).alias("shape"), rounded(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""with n as (select n_name, n_regionkey, n_nationkey / 3.0::double as share from nation), w as (select max(length(n_name)) as a, greatest(max(length(cast(n_regionkey as varchar))), length('n_regionkey')) as b from n)
    select rtrim(concat(rpad(n_name, cast(greatest(a, 6) as int), ' '), '  ', rpad(cast(n_regionkey as varchar), cast(b as int), ' '))) as line, concat(n_name, ' & ', n_regionkey, ' \\\\') as latex, concat('<tr><td>', n_name, '</td><td>', n_regionkey, '</td></tr>') as html from n cross join w""")
def report_rows(t: Tables):
    """The nations as lines of fixed width, rows for LaTeX and for HTML."""
    n = t.nation.select("n_name", "n_regionkey")
    one, two, three = archives.fixed_width(n), archives.latex_rows(n), archives.html_rows(n)
    name = lambda df, c, pattern: df.withColumn("k", F.regexp_extract(c, pattern, 1))
    a = name(one, "line", "^(.*?)\\s{2,}\\d+$")
    b, c = name(two, "row", "^(.*) & \\d+"), name(three, "html", "<td>([^<]*)</td>")
    return a.join(b, "k").join(c, "k").select("line", F.col("row").alias("latex"), "html")


@query("select doc_id, case when (doc_id + 21) % 2147483648 * 2654435761 % 4294967296 < 429496729 then 'val' else 'train' end as part from documents")
def saved_split(t: Tables):
    from ..operators import sampling

    folder = new_folder(t.spark, "split")
    t.documents.select("doc_id", "source", sampling.split(F.col("doc_id"), 0.1, seed=21).alias("part")).write.partitionBy("part").parquet(folder)
    return t.spark.read.parquet(folder).select("doc_id", F.col("part").cast("string").alias("part"))


@query("""select concat('v', vec_id, '.png') as file, cast(8 as int) as height, cast(8 as int) as width, cast(list_sum(list_transform(embedding, lambda v: least(255, cast(floor(abs(cast(v as double)) * 255) as int)))) as bigint) as total from embeddings""")
def picture_files(t: Tables):
    grey = F.transform("embedding", lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 255).cast("int")))
    folder = pictures.write_pictures(t.embeddings.select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), grey.alias("pixels")), new_folder(t.spark, "png"), "path", "pixels", 8)
    return pictures.read_pictures(t.spark, folder).select("file", "height", "width", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""with {_FLAT}, a as (select user_id, frame, case when event_id % 7 <> 3 then event_id end as picture from e)
    select user_id, frame, coalesce(last_value(picture ignore nulls) over (partition by user_id order by frame rows between unbounded preceding and current row), -1) as picture from a where frame % 2 = 0 or frame % 5 = 0""")
def frames_with_fallback(t: Tables):
    """Pictures of wanted frames: one that can't be read is the last that could, or black (-1)."""
    f = sequences.frame_index(t.events, ["user_id"], ORDER)
    wanted = f.where("frame % 2 = 0 or frame % 5 = 0").select("user_id", "frame")
    readable = f.where("event_id % 7 <> 3").select("user_id", "frame", F.col("event_id").alias("picture"))
    got = sequences.forward_fill(wanted.join(readable, ["user_id", "frame"], "left"), ["user_id"], "frame", "picture")
    return got.select("user_id", "frame", F.coalesce("picture", F.lit(-1).cast("long")).alias("picture"))


@query(f"""with {_FLAT}, q as (select user_id, event_id, ts + interval 90 minute as at_ts from events where event_type = 'click'), m as (select user_id, max(frame) as last from e group by user_id)
    select q.event_id, cast(least((select count(*) from e where e.user_id = q.user_id and e.ts <= q.at_ts), m.last) as bigint) as frame from q join m on m.user_id = q.user_id""")
def frames_at_times(t: Tables):
    """The frame that is shown at a time: the first that ends after it, at most the last one."""
    f = sequences.frame_index(t.events, ["user_id"], ORDER)
    q = t.events.where("event_type = 'click'").select("user_id", "event_id", (F.col("ts") + F.expr("interval 90 minutes")).alias("ts"))
    last = f.groupBy("user_id").agg(F.max("frame").alias("last"))
    at = joins.asof_join(q, f.select("user_id", "ts", (F.col("frame") + 1).alias("next")), ["user_id"], "ts", "next", "next")
    return at.join(last, "user_id").select("event_id", F.least(F.coalesce("next", F.lit(0)), F.col("last")).alias("frame"))
