"""Queries on texts that hold points and tracks, prompts, chats, times and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec, points, pointtext, text
from ..operators import joins
from .registry import Tables, query, rounded

#: Orders as points of a customer's picture, in tenths of a percent.
_P = """p as (select *, o_orderkey * 37 % 1001 as xi, o_orderkey * 53 % 1001 as yi from orders)"""
_T = lambda c: f"concat({c} // 10, '.', {c} % 10)"


def marked(t: Tables):
    tenth = lambda k: ((F.col("o_orderkey") * k) % 1001) / 10.0
    return t.orders.withColumn("x", tenth(37)).withColumn("y", tenth(53))


def pictures(t: Tables):
    """(o_custkey, pts): each customer's points."""
    return marked(t).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("pts"))


_PICTURES = f"{_P}, c as (select o_custkey, list(struct_pack(xi, yi) order by xi, yi) as pts from p group by o_custkey)"


@query(f"""with {_PICTURES}, a as (select o_custkey, len(pts) as n, pts[1].xi as x1, pts[1].yi as y1, array_to_string(list_transform(pts, lambda v, i: concat('x', i, '="', {_T("v.xi")}, '" y', i, '="', {_T("v.yi")}, '"')), ' ') as s from c)
    select o_custkey, case when n = 1 then concat('<point x="', {_T("x1")}, '" y="', {_T("y1")}, '" alt="a thing">thing</point>') else concat('<points ', s, ' alt="a thing">thing</points>') end as txt from a""")
def legacy_points(t: Tables):
    return pictures(t).select("o_custkey", pointtext.image_points(F.col("pts"), F.lit("thing"), F.lit("a thing")).alias("txt"))


@query(f"""with {_PICTURES} select o_custkey, concat('<points big thing', chr(9), '-', chr(9), array_to_string(list_transform(pts, lambda v, i: concat(i, ' ', {_T("v.xi")}, ' ', {_T("v.yi")})), ' '), '/>') as v1,
      concat('<points big thing', chr(9), 'an alt', chr(9), array_to_string(list_transform(pts, lambda v, i: concat(i, ' ', lpad(v.xi::varchar, 3 + cast(v.xi > 999 as int), '0'), ' ', lpad(v.yi::varchar, 3 + cast(v.yi > 999 as int), '0'))), ' '), '/>') as v2 from c where list_max(list_transform(pts, lambda v: greatest(v.xi, v.yi))) < 1000""")
def legacy_compact_points(t: Tables):
    p = pictures(t).where(F.forall("pts", lambda v: F.greatest(v["x"], v["y"]) < 100.0))
    label = F.lit("big\tthing")
    return p.select("o_custkey", pointtext.image_points(F.col("pts"), label, F.lit("big thing"), "compact_v1").alias("v1"), pointtext.image_points(F.col("pts"), label, F.lit("an\talt"), "compact_v2").alias("v2"))


@query(f"""with {_PICTURES}, a as (select *, concat('<points thing', chr(9), '-', chr(9), array_to_string(list_transform(pts, lambda v, i: concat(i, ' ', {_T("v.xi")}, ' ', {_T("v.yi")})), ' '), '/>') as s from c)
    select customer.c_custkey, case when s is null then 'There are none.' else concat('Counting the ', s, ' shows a total of ', len(pts), '.') end as answer from customer left join a on c_custkey = o_custkey""")
def point_answers(t: Tables):
    p = t.customer.select("c_custkey").join(pictures(t).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    pts = F.coalesce("pts", F.array().cast("array<struct<x:double,y:double>>"))
    return p.select("c_custkey", pointtext.image_answer(pts, F.lit("thing"), F.lit(None).cast("string"), "point_count", "compact_v1").alias("answer"))


_VIDEO = f"""{_P}, f as (select o_custkey, o_orderkey % 3 as f, list(struct_pack(xi, yi) order by xi, yi) as pts from p group by 1, 2),
    b as (select *, coalesce(sum(len(pts)) over (partition by o_custkey order by f rows between unbounded preceding and 1 preceding), 0) as a, row_number() over (partition by o_custkey order by f) as k from f)"""


def videos(t: Tables):
    f = marked(t).groupBy("o_custkey", (F.col("o_orderkey") % 3).alias("f")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    one = F.struct("f", F.concat(F.col("f").cast("string"), F.lit(".5")).alias("time"), "points")
    return f.groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("frames"))


def _video_sql(frame: str, total: str) -> str:
    return f"with {_VIDEO}, s as (select o_custkey, {frame} as s, f, len(pts) as n from b), g as (select o_custkey, array_to_string(list(s order by f), ' ') as body, sum(n) as total from s group by o_custkey) select o_custkey, {total} as answer from g"


@query(_video_sql(f"""concat('<points t', k, '=', f, '.5', array_to_string(list_transform(pts, lambda v, i: concat(' x', cast(a as bigint) + i, '=', {_T("v.xi")}, ' y', cast(a as bigint) + i, '=', {_T("v.yi")})), ''), '/>')""", """concat('The "cat" are located at: ', body, '.', chr(10), 'Counting shows the total number is: ', cast(total as bigint), '.')"""))
def video_answers(t: Tables):
    return videos(t).select("o_custkey", pointtext.video_answer(F.col("frames"), F.lit("cat"), "point_count").alias("answer"))


@query(_video_sql(f"""concat('<points ', f, '.5', chr(9), array_to_string(list_transform(pts, lambda v, i: concat(cast(a as bigint) + i, ' ', {_T("v.xi")}, ' ', {_T("v.yi")})), ' '), '/>')""", """concat('The total number of "cat" is: ', cast(total as bigint), '.', chr(10), 'They are located at: ', body, '.')"""))
def video_answers_compact(t: Tables):
    return videos(t).select("o_custkey", pointtext.video_answer(F.col("frames"), F.lit("cat"), "count_point", "compact_v1").alias("answer"))


@query(_video_sql(f"""concat(f, '.5', chr(10), array_to_string(list_transform(pts, lambda v, i: concat(cast(a as bigint) + i, ' ', {_T("v.xi")}, ' ', {_T("v.yi")}, chr(10))), ''))""", "rtrim(body, chr(10))"))
def video_paragraphs(t: Tables):
    return videos(t).select("o_custkey", pointtext.video_answer(F.col("frames"), F.lit("cat"), "point", "paragraph").alias("answer"))


def _frames_sql(where: str, mark: str) -> str:
    return f"""with {_P}, s as (select o_custkey, o_orderkey % 3 as f, concat(o_orderkey, ': [', {_T("xi")}, ', ', {_T("yi")}, {mark}) as s, o_orderkey from p where {where}),
      l as (select o_custkey, f, concat('time ', f, '.5', chr(10), '{{', string_agg(s, ', ' order by o_orderkey), '}}') as s from s group by 1, 2)
      select o_custkey, string_agg(s, chr(10) order by f) as tracks from l group by o_custkey"""


def tracked(t: Tables):
    """(o_custkey, frames): points of id, x, y, occluded by frame."""
    point = F.struct(F.col("o_orderkey").alias("id"), "x", "y", (F.col("o_orderstatus") == "F").alias("occluded"))
    f = marked(t).groupBy("o_custkey", (F.col("o_orderkey") % 3).alias("f")).agg(F.collect_list(point).alias("points"))
    one = F.struct("f", F.concat(F.col("f").cast("string"), F.lit(".5")).alias("time"), "points")
    return f.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", one.alias("v"))), lambda a, b: F.when(a["f"] < b["f"], -1).otherwise(1)), lambda x: x["v"]).alias("frames"))


@query(_frames_sql("o_orderstatus <> 'F'", "']'"))
def legacy_frame_tracks(t: Tables):
    return tracked(t).select("o_custkey", pointtext.frame_tracks(F.col("frames")).alias("tracks")).where("tracks <> ''")


@query(_frames_sql("true", "case when o_orderstatus = 'F' then ', yes]' else ']' end"))
def legacy_occluded_tracks(t: Tables):
    return tracked(t).select("o_custkey", pointtext.frame_tracks(F.col("frames"), occlusion=True).alias("tracks"))


@query(f"with {_P} select o_custkey, cast(o_orderkey % 3 as double) + 0.5 as time, cast(o_orderkey as int) as id, xi / 10.0::double as x, yi / 10.0::double as y, o_orderstatus <> 'F' as visible from p")
def frame_point_rows(t: Tables):
    texts = tracked(t).select("o_custkey", pointtext.frame_tracks(F.col("frames"), occlusion=True).alias("tracks"))
    return points.frame_points(texts, ["o_custkey"], "tracks")


@query(f"with {_P} select o_custkey, cast(round_even((o_orderkey % 3 + 0.5) * 5, 0) as bigint) as frame, cast(floor((o_orderkey % 3 + 0.5) * 5) as bigint) as cut, cast(o_orderkey as int) as id from p")
def trajectory_rows(t: Tables):
    texts = tracked(t).select("o_custkey", pointtext.frame_tracks(F.col("frames"), occlusion=True).alias("tracks"))
    rows = points.frame_points(texts, ["o_custkey"], "tracks")
    return rows.select("o_custkey", points.to_frame(F.col("time"), F.lit(5)).alias("frame"), points.to_frame(F.col("time"), F.lit(5), truncate=True).alias("cut"), "id")


_LINES = f"""{_P}, k as (select *, cast(left(o_orderpriority, 1) as int) as id, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) - 1 as t, count(*) over (partition by o_custkey, o_orderpriority) as n from p)"""


def lines(t: Tables):
    """(o_custkey, tracks): tracks of a customer, one for each priority, in order of time."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    k = marked(t).withColumn("n", F.row_number().over(w) - 1).withColumn("t", F.concat(F.col("n").cast("string"), F.lit(".0")))
    point = F.struct("n", "t", "x", "y", (F.col("o_orderstatus") == "F").alias("occluded"))
    k = k.groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    return k.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("id", "points"))).alias("tracks"))


@query(f"""with {_LINES}, e as (select o_custkey, id, concat(id, ': ([', max(case when t = 0 then concat({_T("xi")}, ', ', {_T("yi")}) end), ', 0.0], [', max(case when t = n - 1 then concat({_T("xi")}, ', ', {_T("yi")}, ', ', t, '.0') end), '])') as s from k where n > 1 group by 1, 2)
    select o_custkey, string_agg(s, chr(10) order by id) as tracks from e group by o_custkey""")
def legacy_start_end(t: Tables):
    return lines(t).select("o_custkey", pointtext.start_end_tracks(F.col("tracks")).alias("tracks")).where("tracks <> ''")


@query(f"""with {_LINES} select o_custkey, id, cast(cast(t > 0 as int) as int) as "end", xi / 10.0::double as x, yi / 10.0::double as y, cast(t as double) as t from k where n > 1 and (t = 0 or t = n - 1) and greatest(xi, yi) <= 1000""")
def start_end_rows(t: Tables):
    return points.start_end_points(lines(t).select("o_custkey", pointtext.start_end_tracks(F.col("tracks")).alias("s")), ["o_custkey"], "s")


@query(f"""with {_LINES} select o_custkey, id, coalesce(string_agg(concat('[', {_T("xi")}, ', ', {_T("yi")}, ', ', t, '.0]'), ', ' order by t) filter (t > 0 and o_orderstatus <> 'F'), '') as track from k group by 1, 2""")
def legacy_single_track(t: Tables):
    k = lines(t).select("o_custkey", F.inline("tracks"))
    return k.select("o_custkey", "id", pointtext.single_track(F.col("points")).alias("track"))


_ONE = f"""{_P}, s as (select o_orderkey, xi, yi, {_T("xi")} as x, {_T("yi")} as y from p)"""


def _sample(t: Tables):
    """A text of each older form, by turns."""
    x, y = pointtext.tenths(F.col("x")), pointtext.tenths(F.col("y"))
    three = lambda c: F.lpad(F.rint(F.col(c) * 10).cast("int").cast("string"), 3, "0")
    cat = lambda *v: F.concat(*[F.lit(s) if isinstance(s, str) else s for s in v])
    k = F.col("o_orderkey") % 6
    form = F.when(k == 0, cat("Click(", x, ", ", y, ") or Click(100.5, 1.0)")).when(k == 1, cat("it is 1 ", three("x"), " ", three("y"), ".")).when(k == 2, cat("1 ", x, " ", y))
    form = form.when(k == 3, cat("(", x, ", ", y, ")")).when(k == 4, cat('<point x1="', x, '" y1="', y, '">')).otherwise(cat("p = ", three("x"), ", ", three("y")))
    return marked(t).where("x < 100 and y < 100").select("o_orderkey", form.alias("s"))


@query(f"with {_ONE} select o_orderkey, [cast(round(xi * 0.64, 4) as double)] as xs, [cast(round(yi * 0.48, 4) as double)] as ys from s where xi < 1000 and yi < 1000")
def legacy_readers(t: Tables):
    p = pointtext.read_points(F.col("s"), F.lit(640.0), F.lit(480.0))
    return _sample(t).withColumn("p", p).select("o_orderkey", F.transform("p", lambda v: F.round(v["x"], 4)).alias("xs"), F.transform("p", lambda v: F.round(v["y"], 4)).alias("ys"))


@query(f"""with {_ONE} select o_orderkey, 1.5::double as t, round(xi * 0.64::double, 4) as x, round(yi * 0.48::double, 4) as y from s where o_orderkey % 7 <> 0 and greatest(xi, yi) <= 1000
    union all select o_orderkey, 2.5, 320.0, 24.0 from s where o_orderkey % 7 <> 0""")
def timed_points(t: Tables):
    x, y = pointtext.tenths(F.col("x")), pointtext.tenths(F.col("y"))
    odd = F.when(F.col("o_orderkey") % 7 == 0, " 9").otherwise("")
    s = F.concat(F.lit("<points 1.5 1 "), x, F.lit(" "), y, odd, F.lit(" /> and <points 2.5 2 50.0 5.0 3 101.0 7.0/>"))
    p = marked(t).select("o_orderkey", F.inline(pointtext.read_timed_points(s, F.lit(640.0), F.lit(480.0))))
    return p.select("o_orderkey", "t", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"with {_ONE} select o_orderkey, case when o_orderkey % 2 = 0 then 1 else 2 end as n from s where xi < 1000 and yi < 1000 order by 1")
def decoder_dispatch(t: Tables):
    """The first of several readers that finds something: one knows half of the texts, the
    other finds two points in each."""
    s = _sample(t)
    one = F.when(F.col("o_orderkey") % 2 == 0, pointtext.read_points(F.col("s"), F.lit(1.0), F.lit(1.0)))
    two = pointtext.read_points(F.lit("Click(1.0, 2.0) Click(3.0, 4.0)"), F.lit(1.0), F.lit(1.0))
    return s.select("o_orderkey", F.size(pointtext.first_found(one, two)).alias("n"))


@query("""select doc_id, ['tracks', 'points', 'frames', 'start_end', 'triples', 'none'][doc_id % 6 + 1] as form from documents""")
def format_detect(t: Tables):
    texts = F.array(*[F.lit(s) for s in ('a <tracks coords="1 2 3 4 5">x</tracks>', '<points coords="1 1 2 3">', "time 0.50\n{0: [1.0, 2.0]}", "3: ([1, 2, 0.5], [3, 4, 1.5])", "[1.0, 2.0, 0.5], [3.0, 4.0, 1.0]", "nothing")])
    return t.documents.select("doc_id", codec.detect_format(F.element_at(texts, (F.col("doc_id") % 6 + 1).cast("int"))).alias("form"))


_UNIFIED = f"""{_P}, r as (select o_custkey, o_orderkey, o_orderkey % 3 as f, least(1000, xi) as x, least(1000, yi) as y from p),
    i as (select *, row_number() over (partition by o_custkey order by f, o_orderkey) as id from r)"""


def unified(t: Tables):
    p = marked(t).withColumn("f", F.col("o_orderkey") % 3)
    p = p.withColumn("xs", points.scale(F.col("x"), F.lit(100.0))).withColumn("ys", points.scale(F.col("y"), F.lit(100.0)))
    return points.encode_points(p, ["o_custkey"], "f", "o_orderkey", "xs", "ys", "things")


@query(f"""with {_UNIFIED}, l as (select o_custkey, f, concat(f, ' ', string_agg(concat(id, ' ', lpad(x::varchar, cast(greatest(3, length(x::varchar)) as int), '0'), ' ', lpad(y::varchar, cast(greatest(3, length(y::varchar)) as int), '0')), ' ' order by id)) as s from i group by 1, 2)
    select o_custkey, concat('<points coords="', string_agg(s, ';' order by f), '">things</points>') as points from l group by o_custkey""")
def unified_points(t: Tables):
    return unified(t)


@query(f"with {_UNIFIED} select o_custkey, cast(f as double) as time, cast(id as int) as id, cast(x as int) as x, cast(y as int) as y from i")
def unified_point_rows(t: Tables):
    return points.decode_points(unified(t), ["o_custkey"], "points").select("o_custkey", "time", "id", "x", "y")


@query("""with n as (select o_orderkey, concat('trajectory3d_', o_orderstatus, '_p', o_orderkey % 17, case when o_orderkey % 4 = 0 then '' else concat('_h', o_orderkey % 5) end, '_f', o_orderkey % 31, case when o_orderkey % 3 = 0 then '_v2' else '' end) as name from orders)
    select o_orderkey, case when o_orderkey % 4 <> 0 then cast(o_orderkey % 17 as int) end as points, case when o_orderkey % 4 <> 0 then cast(o_orderkey % 5 as int) end as history, case when o_orderkey % 4 <> 0 then cast(o_orderkey % 31 as int) end as future from n""")
def dataset_names(t: Tables):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("trajectory3d_"), "o_orderstatus", F.lit("_p"), k % 17, F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("_h"), k % 5)), F.lit("_f"), k % 31, F.when(k % 3 == 0, "_v2").otherwise(""))
    return t.orders.select("o_orderkey", points.dataset_parameters(name).alias("d")).select("o_orderkey", "d.*")


@query("""with m as (select conv_id, list(text order by turn) as m from conversations group by conv_id)
    select conv_id, list_transform(m, lambda s, i: case when i % 2 = 1 then concat(case when i > 1 then concat('<|im_end|>', chr(10)) else '' end, '<|im_start|>user', chr(10), s, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) else s end) as qwen3,
      list_transform(m, lambda s, i: concat(case when i > 1 then ' ' else '' end, case when i % 2 = 1 then concat('User: ', s, ' Assistant:') else s end)) as role, list_transform(m, lambda s, i: concat(' ', s)) as plain from m""")
def chat_forms(t: Tables):
    m = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("s")))), lambda v: v["s"]).alias("m"))
    return m.select("conv_id", *[pointtext.chat_messages(F.col("m"), k, k == "none").alias({"none": "plain"}.get(k, k)) for k in ("qwen3", "role", "none")])


@query(f"""with {_PICTURES}, a as (select o_custkey, len(pts) as n, pts, list_transform(pts, lambda v: concat('<point x="', {_T("v.xi")}, '" y="', {_T("v.yi")}, '" alt="a">it</point>')) as s from c)
    select o_custkey, concat('first ', s[1], ' then ', coalesce(s[2], '<|POINT|>'), '.') as answer from a""")
def inline_annotations(t: Tables):
    one = F.transform("pts", lambda v: pointtext.image_points(F.array(v), F.lit("it"), F.lit("a")))
    return pictures(t).select("o_custkey", pointtext.inline_points(F.lit("first <|POINT|> then <|POINT|>."), one).alias("answer"))


@query("""select doc_id, case when n_chars % 5 = 0 then 2 else cast(greatest(1, least(n_chars % 5, 4)) as int) end as fps from documents""")
def fps_from_text(t: Tables):
    n = (F.col("n_chars") % 5).cast("int")
    times = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat((F.floor(i / F.greatest(n, F.lit(1)))).cast("string"), F.lit("."), (i % F.greatest(n, F.lit(1))).cast("string"), F.lit(" <im_start>")))
    return t.documents.select("doc_id", pointtext.fps_of(F.when(n == 0, "no times here").otherwise(F.array_join(times, " "))).cast("int").alias("fps"))


@query("""with w as (select conv_id, turn, role, list_transform(string_split(text, ' '), lambda s: length(s)) as ids from conversations),
      x as (select conv_id, turn, case when role = 'user' then list_concat([-1], ids) else list_append(ids, 0) end as ids, case when role = 'user' then list_transform(list_concat([-1], ids), lambda i: 0) else list_transform(list_append(ids, 0), lambda i: 1) end as mask from w),
      f as (select conv_id, flatten(list(ids order by turn)) as ids, flatten(list(mask order by turn)) as mask from x group by conv_id)
    select conv_id, ids, list_append(ids[2:], 0) as targets, mask from f""")
def interleaved_tokens(t: Tables):
    """Word lengths as tokens: a picture's mark (-1) before each user turn, an end (0) after each
    answer, a loss on answers only, and what each token should predict."""
    ids = F.transform(F.split("text", " "), lambda s: F.length(s).cast("long"))
    user = F.col("role") == "user"
    x = t.conversations.withColumn("ids", F.when(user, F.concat(F.array(F.lit(-1).cast("long")), ids)).otherwise(F.concat(ids, F.array(F.lit(0).cast("long")))))
    x = x.withColumn("mask", F.transform("ids", lambda i: F.when(user, 0).otherwise(1)))
    x = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ids", "mask"))).alias("v"))
    flat = lambda c: F.flatten(F.transform("v", lambda r: r[c]))
    return x.select("conv_id", flat("ids").alias("ids"), text.shift_targets(flat("ids"), 0).alias("targets"), flat("mask").alias("mask"))


@query("""select event_id, concat('frame ', event_id % 9) as number, concat('time ', event_id % 1000 // 100, '.', lpad(cast(event_id % 100 as varchar), 2, '0')) as time2, concat('time ', event_id % 100 // 10, '.', event_id % 10) as time1, '' as none from events""")
def frame_prefixes(t: Tables):
    e = F.col("event_id")
    return t.events.select("event_id", points.frame_prefix("number", e % 9, e).alias("number"), points.frame_prefix("time2", e, (e % 1000) / 100.0).alias("time2"), points.frame_prefix("time1", e, (e % 100) / 10.0).alias("time1"), points.frame_prefix("none", e, e).alias("none"))


@query("""select doc_id, concat('Predict the future 3D trajectories of ', doc_id % 9, ' points over ', doc_id % 31, ' timestamps, given action: ', source, ', and ', doc_id % 4, ' history frames:', chr(10), lang) as v1,
      concat('Predict the future 3D point coordinates of ', doc_id % 9, ' points over ', doc_id % 31, ' timestamps, ', case when doc_id % 2 = 0 then concat('given action: "', source, '", ') else concat('given action: "', source, '", 2d point coordinates: "', doc_id, '", ') end,
        'and history 3d point coordinates: "', lang, '".', case when doc_id % 3 = 0 then ' predict the endpoint 3d coordinate first.' else '' end) as v2 from documents""")
def prompt_forms(t: Tables):
    d = F.col("doc_id")
    v1 = text.plain_question(d % 9, d % 31, d % 4, F.col("source"), F.col("lang"))
    v2 = text.field_question(d % 9, d % 31, F.col("source"), {"2d point coordinates": F.when(d % 2 != 0, d.cast("string")), "history 3d point coordinates": F.col("lang")}, d % 3 == 0)
    return t.documents.select("doc_id", v1.alias("v1"), v2.alias("v2"))


@query("""select doc_id, trim(regexp_replace(trim(concat(left(text, 40), case doc_id % 3 when 0 then '.,;' when 1 then ' ' else '' end), ' '), '[.,;:]+$', ''), ' ') as caption from documents""")
def clean_captions(t: Tables):
    tail = F.when(F.col("doc_id") % 3 == 0, ".,;").when(F.col("doc_id") % 3 == 1, " ").otherwise("")
    return t.documents.select("doc_id", text.clean_caption(F.concat(F.substring("text", 1, 40), tail)).alias("caption"))


@query("""select event_id, round((event_id % 900) / 30.0, 6) as seconds, cast(floor(event_id % 97 / 4.0 * 30) as bigint) as first_frame, cast(ceil((event_id % 97 + 5) / 4.0 * 30) as bigint) as last_frame from events""")
def frame_times(t: Tables):
    e = F.col("event_id")
    first, last = points.clip_frames((e % 97) / 4.0, (e % 97 + 5) / 4.0, F.lit(30))
    return t.events.select("event_id", F.round(points.frame_time(e % 900, F.lit(30)), 6).alias("seconds"), first.alias("first_frame"), last.alias("last_frame"))


@query("""with s as (select event_id, event_id * 977 % 300000 as s from events) select event_id, concat(case when s >= 86400 then concat(s // 86400, case when s >= 172800 then ' days, ' else ' day, ' end) else '' end, s % 86400 // 3600, ':', lpad(cast(s % 3600 // 60 as varchar), 2, '0'), ':', lpad(cast(s % 60 as varchar), 2, '0')) as shown from s""")
def elapsed_text(t: Tables):
    return t.events.select("event_id", text.elapsed(F.col("event_id") * 977 % 300000).alias("shown"))


@query("""select vec_id, list_transform([5, 1, 9], lambda i: round(cast(embedding[i] as double), 6)) as gathered, list_transform(range(0, 64, 16), lambda i: round(cast(embedding[i + 1] as double), 6)) as strided,
    list_transform(range(8), lambda i: round(cast(embedding[i % 2 * 4 + i // 2 + 1] as double), 6)) as transposed, list_transform(range(6), lambda i: round(cast(embedding[i % 3 + 1] as double), 6)) as tiled, list_transform(range(6), lambda i: round(cast(embedding[i // 2 + 1] as double), 6)) as repeated from embeddings""")
def array_shapes(t: Tables):
    """Gather, stride, transpose (2 by 4), tile and repeat as array expressions."""
    at = lambda i: rounded(F.get("embedding", i).cast("double"), 6)
    seq = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return t.embeddings.select(
        "vec_id", F.array(*[at(F.lit(i)) for i in (4, 0, 8)]).alias("gathered"), F.transform(F.sequence(F.lit(0), F.lit(63), F.lit(16)), at).alias("strided"),
        F.transform(seq(8), lambda i: at((i % 2 * 4 + F.floor(i / 2)).cast("int"))).alias("transposed"), F.transform(seq(6), lambda i: at(i % 3)).alias("tiled"), F.transform(seq(6), lambda i: at(F.floor(i / 2).cast("int"))).alias("repeated"),
    )


@query("""select n_nationkey as "nation.key", n_name as "nation.name", r_name as "nation.region.name", concat(n_name, '@', r_name) as again from nation join region on n_regionkey = r_regionkey""")
def flat_names(t: Tables):
    """Nested columns as dotted names and back."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    nested = n.select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"))
    flat = text.flattened(nested)
    back = text.nested(flat)
    return text.flattened(back.withColumn("again", F.concat("nation.name", F.lit("@"), "nation.region.name")))


@query("""select s_suppkey, concat('house_', s_suppkey % 40) as house, cast(s_suppkey % 7 as int) as batch, 'h5' as kind from supplier where s_suppkey % 40 in (select distinct p_size from part) and s_suppkey % 3 <> 2""")
def release_layout(t: Tables):
    """Flat names of a release to a nested layout, for houses that are there."""
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 2, F.concat(F.lit("readme_"), k.cast("string"))).otherwise(F.concat(F.lit("house_"), (k % 40).cast("string"), F.lit("__trajectories_batch_"), (k % 7).cast("string"), F.lit(".h5")))
    rows = t.supplier.select("s_suppkey", text.release_name(name).alias("p")).where("p is not null").select("s_suppkey", "p.*")
    houses = t.part.select(F.concat(F.lit("house_"), F.col("p_size").cast("string")).alias("house")).distinct()
    return rows.join(houses, "house", "left_semi").select("s_suppkey", "house", "batch", "kind")


@query("""with l as (select user_id, event_id, epoch(ts) as a, epoch(ts) + 1800 as b, concat('line ', event_id, ' ', props) as line from events where event_type = 'click'),
      v as (select user_id, epoch(ts) as t from events where event_type = 'view'), k as (select * from l where exists (select 1 from v where v.user_id = l.user_id and v.t between l.a - 600 and l.b + 600)),
      c as (select *, sum(length(line) + 1) over (partition by user_id order by a, event_id rows between unbounded preceding and current row) as total from k)
    select user_id, concat('Subtitles:', chr(10), string_agg(line, chr(10) order by a, event_id)) as block from c where total <= 200 group by user_id""")
def subtitles(t: Tables):
    """Lines that are on screen at a frame's time, in order of their start, as a block of bounded length."""
    s = t.events.withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    lines = s.where("event_type = 'click'").select("user_id", "event_id", "a", (F.col("a") + 1800).alias("b"), F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit(" "), "props").alias("line"))
    seen = joins.lines_in_view(lines, s.where("event_type = 'view'").select("user_id", F.col("a").alias("t")), ["user_id"], "a", "b", "t", 600.0)
    block = seen.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("a", "event_id", "line"))).alias("x"))
    return block.select("user_id", text.subtitle_block(F.col("x"), 200).alias("block")).where("block <> ''")
