"""Queries on video files (tables of frames, plans of seeks, cuts without encoding) and on depth and
texts in EXR and HDF5 files. Files are made from the tables, a task a file, and read again."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins
from ..sources import exr, hdf5, pictures, video
from ..sources.files import write_files
from ..storage import new_folder
from .registry import Tables, query, rounded

#: A file for each user, a sample for each event: every second and third sample of three are shown in
#: the other order, every fifth can be decoded alone, and sizes follow from the event's id.
_SAMPLES = """e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as p from events),
    s as (select user_id, p, 100 + 40 * (user_id % 3) as lasts, 10 + event_id % 50 as size, case p % 3 when 1 then 1 when 2 then -1 else 0 end as later from e),
    t as (select *, (p + later) * lasts as tm, 32 + coalesce(sum(size) over (partition by user_id order by p rows between unbounded preceding and 1 preceding), 0) as pos from s),
    f as (select 'u' || cast(user_id as varchar) || '.mp4' as file, row_number() over (partition by user_id order by tm) - 1 as frame, p as sample, p - p % 5 as key_sample, tm / 1000.0::double as begin,
      coalesce(lead(tm) over (partition by user_id order by tm), tm + lasts) / 1000.0::double as end_, cast(pos as bigint) as pos, size from t)"""


def _written(t: Tables) -> str:
    p = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    lasts = 100 + 40 * (F.col("user_id") % 3)
    rows = t.events.select(
        F.format_string("u%d.mp4", "user_id").alias("file"), p.alias("place"), lasts.alias("lasts"), (F.element_at(F.array(*[F.lit(v) for v in (0, 1, -1)]), (p % 3 + 1).cast("int")) * lasts).alias("later"),
        (p % 5 == 0).alias("key"), F.repeat(F.lit("x"), (10 + F.col("event_id") % 50).cast("int")).cast("binary").alias("data"),
    )
    return video.write_videos(rows, new_folder(t.spark, "videos"))


@query(f"""with {_SAMPLES} select file, frame, sample, key_sample, begin, end_ as "end", pos as "offset", size, 64 as width, 48 as height from f""")
def video_frames(t: Tables):
    """When the frames of video files are shown, where their bytes are, and where decoding begins."""
    return video.read_videos(t.spark, _written(t))


@query(f"""with {_SAMPLES}, w as (select distinct user_id, 'u' || cast(user_id as varchar) || '.mp4' as file from events), q as (select user_id, file, k as place, case when user_id % 2 = 0 then 3 + k else [4, 0, 2, 100000, 3][k + 1] end as frame from w cross join (select unnest(range(5)) as k)),
      j as (select q.*, f.sample, f.key_sample, row_number() over (partition by q.file order by q.frame, place) as nth from q left join f using (file, frame))
    select file, place, frame, coalesce(last_value(case when sample is not null then frame end ignore nulls) over (partition by file order by place rows between unbounded preceding and current row), -1) as shown,
      sample is not null and (user_id % 2 = 1 or nth = 1) as seek, case when sample is not null then case when user_id % 2 = 0 and nth > 1 then sample else key_sample end end as from_sample, sample as to_sample from j""")
def video_seeks(t: Tables):
    """How wanted frames are reached: five in a row with one seek, others with a seek each; one
    that isn't there shows the last that was."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    files = t.events.select("user_id").distinct().select("user_id", F.format_string("u%d.mp4", "user_id").alias("file"), k.alias("place"))
    far = F.element_at(F.array(*[F.lit(v).cast("long") for v in (4, 0, 2, 100000, 3)]), (F.col("place") + 1).cast("int"))
    wanted = files.withColumn("frame", F.when(F.col("user_id") % 2 == 0, 3 + F.col("place")).otherwise(far))
    return video.seek_plan(video.read_videos(t.spark, _written(t)), wanted)


@query(f"""with {_SAMPLES}, q as (select event_id, 'u' || cast(user_id as varchar) || '.mp4' as file, (event_id * 37 % 20000) / 1000.0::double as tm from events where event_type = 'click'), m as (select file, max(frame) as last from f group by 1)
    select event_id, least(count(f.frame), any_value(last)) as frame from q join m using (file) left join f on f.file = q.file and f.end_ <= q.tm group by 1""")
def video_frames_at(t: Tables):
    """The frame that is shown at a time: as many as have ended by then, at most the last."""
    frames = video.read_videos(t.spark, _written(t))
    q = t.events.where("event_type = 'click'").select("event_id", F.format_string("u%d.mp4", "user_id").alias("file"), (F.col("event_id") * 37 % 20000 / 1000.0).alias("at"))
    at = joins.asof_join(q, frames.select("file", F.col("end").alias("at"), (F.col("frame") + 1).alias("next")), ["file"], "at", "next", "next")
    last = frames.groupBy("file").agg(F.max("frame").alias("last"))
    return at.join(last, "file").select("event_id", F.least(F.coalesce("next", F.lit(0)), F.col("last")).alias("frame"))


@query(f"""with {_SAMPLES}, n as (select file, count(*) as n from f group by 1 having n >= 6), c as (select f.*, n from f join n using (file) where frame between 2 and n - 3)
    select file, frame - 2 as frame, round(begin - min(begin) over (partition by file), 6) as begin, round(end_ - min(begin) over (partition by file), 6) as "end", size from c""")
def video_trims(t: Tables):
    """Files without their first two and last two frames, cut without encoding and read again."""
    folder = _written(t)
    n = t.events.groupBy("user_id").count().where("count >= 6")
    name = F.format_string("u%d.mp4", "user_id")
    cut = video.trim_videos(t.spark, folder, n.select(name.alias("file"), F.lit(2).alias("first"), (F.col("count") - 3).alias("last"), name.alias("path")), new_folder(t.spark, "trims"))
    return video.read_videos(t.spark, cut).select("file", "frame", rounded("begin", 6).alias("begin"), rounded("end", 6).alias("end"), "size")


@query("""select 'label' || cast(label as varchar) || '.zip' as file, vec_id as frame, 8 as height, 8 as width, round(list_sum([x::double for x in embedding]), 4) as total, round(embedding[9]::double, 6) as second_line from embeddings where vec_id % 3 = 0""")
def exr_depth(t: Tables):
    """Depth pictures in archives, one for each label: wanted frames alone, others aren't read."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                d = np.asarray(e, np.float32).reshape(8, 8)
                z.writestr(f"{i:05d}.exr", exr.encode({"Z": d, "A": d.astype(np.float16), "id": np.full((8, 8), i, np.uint32)}, int(i) % 2 + 2))
        return pd.DataFrame({"path": [f"label{key[0]}.zip"], "content": [out.getvalue()]})

    folder = new_folder(t.spark, "exr")
    write_files(t.embeddings.select("label", "vec_id", "embedding").groupBy("label").applyInPandas(build, "path string, content binary"), folder)
    wanted = t.embeddings.where("vec_id % 3 = 0").select(F.format_string("label%d.zip", "label").alias("file"), F.explode(F.array("vec_id", F.col("vec_id") + 40_000_000)).alias("frame"))
    d = exr.read_depth(t.spark, folder, wanted)
    total = F.aggregate("depth", F.lit(0.0), lambda a, x: a + x)
    return d.select("file", "frame", "height", "width", rounded(total, 4).alias("total"), rounded(F.get("depth", F.lit(8)).cast("double"), 6).alias("second_line"))


@query("""with r as (select label, vec_id, embedding, vec_id % 2 as cam, row_number() over (partition by label, vec_id % 2 order by vec_id) - 1 as row from embeddings)
    select 'ep' || cast(label as varchar) || '.h5' as file, 'cam' || cast(cam as varchar) || '+ext/depth' as key, row, 8 as height, 8 as width, cast(list_sum([round(abs(x::double) * 1000)::bigint for x in embedding]) as bigint) as mm from r where row % 4 <> 1""")
def hdf5_depth(t: Tables):
    """Depth in millimetres from chunked arrays of HDF5 files, wanted rows alone, as metres."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, cams = hdf5.Writer(), {}
        for cam, g in pdf.sort_values("vec_id").groupby("cam"):
            mm = np.abs(np.stack(g["embedding"].to_numpy()).astype(float)) * 1000
            mm = (np.floor(mm) + (mm % 1 >= 0.5)).astype(np.uint16).reshape(-1, 8, 8)  # halves up
            cams[f"cam{cam}+ext"] = w.group({"depth": w.array(mm, (3, 5, 8), bool(cam))})
        return pd.DataFrame({"path": [f"ep{key[0]}.h5"], "content": [w.finish(w.group(cams))]})

    folder = new_folder(t.spark, "hdf5")
    e = t.embeddings.select("label", "vec_id", "embedding", (F.col("vec_id") % 2).alias("cam"))
    write_files(e.groupBy("label").applyInPandas(build, "path string, content binary"), folder)
    row = F.row_number().over(Window.partitionBy("label", "cam").orderBy("vec_id")) - 1
    wanted = e.select(F.format_string("ep%d.h5", "label").alias("file"), F.format_string("cam%d+ext/depth", "cam").alias("key"), row.cast("long").alias("row"), F.lit(1000.0).alias("unit")).where("row % 4 <> 1")
    d = hdf5.read_depth(t.spark, folder, wanted.unionByName(wanted.withColumn("key", F.lit("no/depth"))))
    return d.select("file", "key", "row", "height", "width", F.round(F.aggregate("depth", F.lit(0.0), lambda a, x: a + F.round(x.cast("double") * 1000))).cast("long").alias("mm"))


@query("""select 'part' || cast(conv_id % 10 as varchar) || '.h5' as file, 'traj_' || cast(conv_id as varchar) as name, role as object, text as said from conversations where turn = 0 and conv_id % 7 <> 0""")
def hdf5_scenes(t: Tables):
    """JSON texts in groups of HDF5 files; groups without one, or with a broken one, are left out."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, groups = hdf5.Writer(), {}
        for i, role, said in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
            scene = json.dumps({"object": role, "said": said}, ensure_ascii=bool(i % 2))
            other = {"none": w.text("x")} if i % 14 == 0 else {"obs_scene": w.text("{broken")}
            groups[f"traj_{i}"] = w.group({"obs_scene": w.text(scene)} if i % 7 else other)
        groups["other"] = w.group({})
        return pd.DataFrame({"path": [f"part{key[0]}.h5"], "content": [w.finish(w.group(groups))]})

    folder = new_folder(t.spark, "scenes")
    c = t.conversations.where("turn = 0").withColumn("part", F.col("conv_id") % 10)
    write_files(c.groupBy("part").applyInPandas(build, "path string, content binary"), folder)
    x = hdf5.read_texts(t.spark, folder, "traj_", "obs_scene").withColumn("j", F.from_json("text", "object string, said string"))
    return x.where("j.object is not null").select("file", "name", F.col("j.object").alias("object"), F.col("j.said").alias("said"))


@query("""with p as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as f, (event_id * 13) % 50 - 5 as x, (event_id * 29) % 40 - 4 as y from events), q as (select * from p where f < 6),
      l as (select user_id, f, x, y, lead(x) over w as x2, lead(y) over w as y2 from q window w as (partition by user_id order by f)), m as (select *, greatest(abs(x2 - x), abs(y2 - y)) as n from l where x2 is not null),
      s as (select user_id, cast(floor(x + (x2 - x) * k / greatest(n, 1)::double + 0.5) as bigint) as px, cast(floor(y + (y2 - y) * k / greatest(n, 1)::double + 0.5) as bigint) as py from (select *, unnest(range(n + 1)) as k from m)),
      o as (select user_id, x as px, y as py from q where f = 0 and user_id not in (select user_id from m)),
      d as (select user_id, x + i as px, y + j as py from q cross join (select unnest(range(-2, 3)) as i) cross join (select unnest(range(-2, 3)) as j) where f > 0 and i * i + j * j <= 4 and x between 0 and 39 and y between 0 and 29),
      a as (select distinct user_id, px, py from (select * from s union all select * from o union all select * from d) where px between 0 and 39 and py between 0 and 29)
    select u.user_id, count(px) as lit, cast(coalesce(sum(py * 40 + px), 0) as bigint) as places, cast(count(px) * 230 + (1200 - count(px)) * 9 as bigint) as red from (select distinct user_id from events) u left join a using (user_id) group by 1""")
def overlaid_pictures(t: Tables):
    """A line through each user's first six points, with dots, drawn into a dark picture that is
    written as a colour PNG and read again: which pixels are lit, and the sum of their red."""
    f = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = t.events.select("user_id", f.alias("f"), (F.col("event_id") * 13 % 50 - 5).alias("x"), (F.col("event_id") * 29 % 40 - 4).alias("y")).where("f < 6")
    points = F.array_sort(F.collect_list(F.struct("f", "x", "y")))
    rows = e.groupBy("user_id").agg(points.alias("p")).select("user_id", F.array(F.flatten(F.transform("p", lambda v: F.array(v["x"].cast("double"), v["y"].cast("double"))))).alias("lines"), F.array_repeat(F.lit(9), 40 * 30 * 3).alias("dark"))
    drawn = pictures.overlay(rows, "user_id", "dark", 40, "lines", thick=1, dot=2)
    folder = pictures.write_pictures(drawn.withColumn("name", F.format_string("u%d.png", "user_id")), new_folder(t.spark, "drawn"), "name", "pixels", 40, 3)
    back = pictures.read_pictures(t.spark, folder)
    red = F.transform(F.sequence(F.lit(0), F.lit(1199)), lambda k: F.get("pixels", k * 3))
    back = back.select(F.regexp_extract("file", "[0-9]+", 0).cast("long").alias("user_id"), red.alias("red"))
    lit = F.filter(F.transform("red", lambda v, i: F.when(v != 9, i)), lambda i: i.isNotNull())
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select("user_id", F.size(lit).cast("long").alias("lit"), total(lit).alias("places"), total("red").alias("red"))
