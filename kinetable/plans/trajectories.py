"""Queries on tracks: a user's events are a track, their order the frame, ``value`` a coordinate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import joins, metrics, sequences
from .registry import Tables, query, rounded

ORDER = ["ts", "event_id"]
_E = """e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
    abs(value - lag(value) over (partition by user_id order by ts, event_id)) as err from events)"""


def errors(t: Tables):
    """Errors of the forecast that a track stays where it is."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = sequences.frame_index(t.events, ["user_id"], ORDER)
    return e.withColumn("err", F.abs(F.col("value") - F.lag("value").over(w)))


@query(f"""with {_E}, v as (select * from e where err is not null),
    l as (select *, row_number() over (partition by user_id order by frame desc) as rn from v)
    select round(coalesce(avg(err), 0), 6) as ade, round(coalesce(avg(case when rn = 1 then err end), 0), 6) as fde,
      round(coalesce(avg((cast(err <= 1 as int) + cast(err <= 2 as int) + cast(err <= 5 as int) + cast(err <= 10 as int) + cast(err <= 20 as int)) / cast(5 as double)), 0), 6) as pwt,
      count(distinct user_id) as n_clips from l""")
def traj_score(t: Tables):
    s = metrics.trajectory_scores(errors(t), ["user_id"], "frame", "err", ["user_id"], [1, 2, 5, 10, 20])
    return s.select(*[rounded(c, 6).alias(c) for c in ("ade", "fde", "pwt")], "n_clips")


@query(f"""with {_E}, i as (select user_id, event_type, sum(err * (value + 1)) / sum(value + 1) as m from e
      where err is not null group by user_id, event_type)
    select event_type, round(avg(m), 6) as mean_value, count(*) as n_items from i group by grouping sets ((event_type), ())""")
def traj_score_by_type(t: Tables):
    e = errors(t).where("err is not null").withColumn("w", F.col("value") + 1)
    return metrics.rollup_weighted(e, ["user_id"], "event_type", "err", "w").withColumn("mean_value", rounded("mean_value", 6))


@query(f"""with {_E}, r as (select user_id, avg(err) as l2, sum(err * err) / count(*) as mse, count(*) as n from e where err is not null group by user_id)
    select user_id, round(l2, 6) as l2, round(mse, 6) as mse, n as n_visible from r""")
def record_errors(t: Tables):
    e = errors(t).where("err is not null")
    return e.groupBy("user_id").agg(rounded(F.avg("err"), 6).alias("l2"), rounded(F.sum(F.col("err") * F.col("err")) / F.count("*"), 6).alias("mse"), F.count("*").alias("n_visible"))


@query("""with d as (select *, date_trunc('hour', ts) as h from events),
      p as (select h, quantile_cont(value, 0.8) as p, count(value) as n from d group by h)
    select d.h as hour, round(coalesce(avg(case when n < 5 or value <= p then value end), 0), 6) as trimmed from d join p using (h) group by d.h""")
def trimmed_motion(t: Tables):
    e = t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return metrics.trimmed_mean(e, ["hour"], "value").withColumn("trimmed", rounded("trimmed", 6))


@query(f"""with {_E}, a as (select user_id, frame, frame - row_number() over (partition by user_id order by frame) as g from e where value >= 10),
      r as (select user_id, min(frame) as s, max(frame) as e from a group by user_id, g),
      k as (select *, case when s - lag(e) over (partition by user_id order by s) - 1 < 2 then 0 else 1 end as brk from r),
      m as (select *, sum(brk) over (partition by user_id order by s rows between unbounded preceding and current row) as grp from k)
    select user_id, min(s) as "begin", max(e) as "end" from m group by user_id, grp having max(e) - min(s) + 1 >= 3""")
def motion_segments(t: Tables):
    e = sequences.frame_index(t.events, ["user_id"], ORDER)
    return sequences.islands(e, ["user_id"], "frame", F.col("value") >= 10, min_gap=2, min_length=3)


@query(f"""with {_E} select event_id,
      round(coalesce(lag(value, 2) over w, first_value(value) over w), 6) as h2, round(coalesce(lag(value, 1) over w, first_value(value) over w), 6) as h1,
      round(coalesce(lead(value, 1) over w, value), 6) as f1 from e window w as (partition by user_id order by frame)""")
def frame_window(t: Tables):
    e = sequences.frame_index(t.events, ["user_id"], ORDER)
    e = sequences.history_and_future(e, ["user_id"], "frame", "value", history=3, future=1)
    return e.select("event_id", rounded(F.col("history")[0], 6).alias("h2"), rounded(F.col("history")[1], 6).alias("h1"), rounded(F.col("future")[0], 6).alias("f1"))


@query("""with c as (select o_custkey, count(*) as n from orders group by o_custkey),
      r as (select o_custkey, 2 as a, greatest(n - 4, 2) as b from c),
      x as (select o_custkey, a as t from r union select o_custkey, (a + b) // 2 from r union select o_custkey, b from r)
    select o_custkey, cast(t as bigint) as t from x""")
def eval_times(t: Tables):
    c = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    times = sequences.evaluation_times(F.lit(0).cast("long"), F.col("n") - 1, history=3, future=3)
    return c.select("o_custkey", F.explode(times).alias("t"))


@query("""select o_custkey, cast(n0 + s as bigint) as t from (select o_custkey, min(o_orderkey) as n0, count(*) as n from orders group by o_custkey)
    cross join (values (0), (3), (6)) as x(s) where s + 2 < n""")
def start_times(t: Tables):
    c = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("n0"), F.count("*").alias("n"))
    return c.select("o_custkey", "n0", "n", F.explode(sequences.start_times(F.col("n0"))).alias("t")).where("t - n0 + 2 < n").select("o_custkey", "t")


@query("""select c.event_id, (select max(struct_pack(t := v.ts, e := v.event_id)).e from events v where v.event_type = 'view' and v.user_id = c.user_id and v.ts <= c.ts) as view_id
    from events c where c.event_type = 'click'""")
def asof_price(t: Tables):
    click, view = t.events.where("event_type = 'click'"), t.events.where("event_type = 'view'")
    return joins.asof_join(click.select("event_id", "user_id", "ts"), view, ["user_id"], "ts", "event_id", "view_id").select("event_id", "view_id")


@query("""with a as (select event_id, user_id, epoch(ts) as s from events where event_type = 'purchase'), b as (select event_id as o, user_id, epoch(ts) as s from events where event_type = 'view'),
      j as (select a.event_id, o, abs(a.s - b.s) as gap, row_number() over (partition by a.event_id order by abs(a.s - b.s), o) as rn from a join b using (user_id) where abs(a.s - b.s) <= 7200)
    select a.event_id, j.o as near_o, round(j.gap, 3) as gap from a left join j on a.event_id = j.event_id and rn = 1""")
def nearest_event(t: Tables):
    s = t.events.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a, b = s.where("event_type = 'purchase'").select("event_id", "user_id", "s"), s.where("event_type = 'view'").select("user_id", "s", F.col("event_id").alias("o"))
    return joins.nearest_join(a, b, ["user_id"], "s", "event_id", "o", 7200.0).select("event_id", "near_o", rounded("gap", 3).alias("gap"))


@query("""with s as (select user_id, min(ts) as a, max(ts) as b from events where event_type = 'view' group by user_id)
    select s.user_id from s where exists (select 1 from events e where e.user_id = s.user_id and e.event_type = 'purchase' and e.ts between a and b)""")
def interval_overlap(t: Tables):
    spans = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return joins.overlapping(spans, t.events.where("event_type = 'purchase'"), ["user_id"], "a", "b", "ts").select("user_id")


@query("""select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) as mean5,
    round(sum(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) /
      greatest(1e-3, epoch(ts) - epoch(first_value(ts) over (partition by user_id order by ts, event_id rows between 4 preceding and current row))), 6) as rate5 from events""")
def trailing_mean(t: Tables):
    e = sequences.trailing_mean(t.events, ["user_id"], ORDER, "value", 5, "mean5")
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(-4, 0)
    s = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rate = F.sum("value").over(w) / F.greatest(F.lit(1e-3), s(F.col("ts")) - s(F.first("ts").over(w)))
    return e.select("event_id", rounded("mean5", 6).alias("mean5"), rounded(rate, 6).alias("rate5"))


@query("""with f as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as a,
      row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as b from events)
    select event_id from f where a = 1 or b = 1""")
def first_last(t: Tables):
    w = Window.partitionBy("user_id", "event_type")
    f = t.events.withColumn("a", F.row_number().over(w.orderBy(*ORDER))).withColumn("b", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))))
    return f.where("a = 1 or b = 1").select("event_id")


@query("""with f as (select event_id, user_id, ts, min(ts) over (partition by user_id, event_type) as t0 from events)
    select event_id from f where ts > t0""")
def after_initial(t: Tables):
    return t.events.withColumn("t0", F.min("ts").over(Window.partitionBy("user_id", "event_type"))).where("ts > t0").select("event_id")


@query("""with f as (select user_id, event_type, min(ts) as t0 from events group by user_id, event_type)
    select user_id, event_type, row_number() over (partition by user_id order by t0, event_type) - 1 as object_index from f""")
def reindex_first_seen(t: Tables):
    f = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("t0"))
    return f.select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("t0", "event_type")) - 1).cast("long").alias("object_index"))


@query("""select event_id, round(value - first_value(value) over (partition by user_id order by ts, event_id), 6) as delta from events""")
def anchor_delta(t: Tables):
    return sequences.from_anchor(t.events, ["user_id"], ORDER, "value", "delta").select("event_id", rounded("delta", 6).alias("delta"))


@query("""select event_id, round(last_value(case when value >= 20 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 6) as filled from events""")
def forward_fill(t: Tables):
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", rounded(F.last(F.when(F.col("value") >= 20, F.col("value")), ignorenulls=True).over(w), 6).alias("filled"))


_TRACKS = """q as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as f, cast(round_even(value * 10, 0) as bigint) as x from events),
      s as (select user_id, f, concat(f, '.0 1 ', x, ' 0 0') as s from q),
      k as (select user_id, concat('<tracks coords="', string_agg(s, ';' order by f), '">object points</tracks>') as tracks from s group by user_id)"""


def encoded(t: Tables):
    """Tracks as text."""
    q = sequences.frame_index(t.events, ["user_id"], ORDER, "f")
    zero = F.lit(0).cast("long")
    q = q.select("user_id", "f", F.lit(1).alias("p"), F.rint(F.col("value") * 10).cast("long").alias("x"), zero.alias("y"), zero.alias("z"))
    return codec.encode_tracks(q, ["user_id"], "f", "p", ["x", "y", "z"], "object points")


def filled_grid(t: Tables):
    """Every track on one grid, to one frame after the end of the longest."""
    parsed = codec.decode_tracks(encoded(t), ["user_id"], "tracks").select("user_id", F.col("time").cast("long").alias("f"), "x")
    longest = t.events.groupBy("user_id").count().agg(F.max("count").alias("n"))
    grid = t.events.select("user_id").distinct().crossJoin(F.broadcast(longest)).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("f"))
    return grid.join(parsed, ["user_id", "f"], "left").select("user_id", "f", F.coalesce(F.col("x") / 10.0, F.lit(0.0)).alias("x"))


@query(f"with {_TRACKS} select * from k")
def encode_tracks(t: Tables):
    return encoded(t)


@query(f"with {_TRACKS} select user_id, cast(f as double) as time, cast(1 as bigint) as point, x, cast(0 as bigint) as y, cast(0 as bigint) as z from q")
def decode_tracks(t: Tables):
    return codec.decode_tracks(encoded(t), ["user_id"], "tracks")


@query(f"""with {_TRACKS}, g as (select user_id, f from (select distinct user_id from events) cross join (select unnest(range((select max(f) + 2 from q))) as f))
    select g.user_id, cast(g.f as bigint) as f, coalesce(q.x / cast(10 as double), 0) as x from g left join q on g.user_id = q.user_id and g.f = q.f""")
def grid_fill(t: Tables):
    return filled_grid(t)



def _tap(t: Tables):
    e = errors(t).withColumn("said", F.col("value") > 60).withColumn("true", F.col("event_type") == "purchase")
    return metrics.tapvid(e.where("err is not null"), "err", "true", "said", F.col("frame") > 1, ["user_id"])


_RAW = ", ".join(f"""count(*) filter (not tr and err < {k}) / nullif(cast(count(*) filter (not tr) as double), 0) as w{k},
      count(*) filter (not tr and not sd and err < {k}) / nullif(cast(count(*) filter (not tr) + count(*) filter (not sd and (tr or err >= {k})) as double), 0) as j{k}""" for k in (1, 2, 4, 8, 16))
_ROUNDED = ", ".join(f"round(w{k}, 6) as within_{k}, round(j{k}, 6) as jaccard_{k}" for k in (1, 2, 4, 8, 16))


@query(f"""with {_E}, x as (select user_id, err, value > 60 as sd, event_type = 'purchase' as tr from e where err is not null and frame > 1)
    , k as (select user_id, avg(cast(tr = sd as double)) as oa, {_RAW} from x group by user_id)
    select user_id, round(oa, 6) as occlusion_accuracy, {_ROUNDED}, round((w1 + w2 + w4 + w8 + w16) / 5, 6) as within_average, round((j1 + j2 + j4 + j8 + j16) / 5, 6) as jaccard_average from k""")
def tapvid(t: Tables):
    r = _tap(t)
    return r.select("user_id", *[rounded(c, 6).alias(c) for c in r.columns if c != "user_id"])


@query("""with r as (select user_id, cast(ts as date) as d, count(*) as a from events where event_type = 'view' group by 1, 2),
      s as (select user_id, cast(ts as date) as d, count(*) as b from events where event_type = 'click' group by 1, 2)
    select coalesce(r.user_id, s.user_id) as user_id, coalesce(r.d, s.d) as d, coalesce(a, 0) as n_true, coalesce(b, 0) as n_said from r full join s on r.user_id = s.user_id and r.d = s.d""")
def frame_full_outer(t: Tables):
    day = t.events.withColumn("d", F.to_date("ts"))
    n = lambda k, c: day.where(F.col("event_type") == k).groupBy("user_id", "d").agg(F.count("*").alias(c))
    return n("view", "n_true").join(n("click", "n_said"), ["user_id", "d"], "full").na.fill(0, ["n_true", "n_said"])


@query("""select time_bucket(interval '1 hour', ts) as "start", event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2""")
def tumbling(t: Tables):
    w = t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 6).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""with x as (select time_bucket(interval '1 hour', ts) - to_hours(cast(k as bigint)) as s from events cross join (values (0), (1)) as v(k))
    select s as "start", count(*) as n from x group by s""")
def sliding(t: Tables):
    return t.events.groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@query("""with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '6 hours' then 0 else 1 end as brk from events),
      s as (select *, sum(brk) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
    select user_id, min(ts) as "start", max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, k""")
def session_gap(t: Tables):
    s = t.events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
