"""Queries on visibility, look-ups that must hit, rolling forecasts and scores of videos."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import joins, metrics, sampling, schedule, sequences
from .registry import Tables, query, rounded

ORDER = ["ts", "event_id"]
_F = """f as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
    count(*) over (partition by user_id) as n from events)"""


def frames(t: Tables):
    return sequences.frame_index(t.events, ["user_id"], ORDER).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))


@query(f"with {_F} select user_id, event_id from f where frame = least(20, n - 1) and value <= 60")
def visible_at_frame(t: Tables):
    return frames(t).where((F.col("frame") == F.least(F.lit(20), F.col("n") - 1)) & (F.col("value") <= 60)).select("user_id", "event_id")


@query("""with f as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as frame from events),
      h as (select user_id, event_type, bool_and(value <= 60) as a, bool_or(frame = 2 and value <= 60) as b from f where frame <= 2 group by 1, 2),
      g as (select *, bool_or(a) over (partition by user_id) as fits from h)
    select user_id, event_type, fits from g where case when fits then a else b end""")
def visible_history(t: Tables):
    f = sequences.frame_index(t.events, ["user_id", "event_type"], ORDER)
    return sequences.visible_throughout(f, ["user_id"], "event_type", "frame", F.col("value") <= 60, 0, 2).select("user_id", "event_type", "fits")


@query("select event_id from events where event_id % 10 in (5, 6, 7, 8)")
def phase_filter(t: Tables):
    return t.events.where((F.col("event_id") % 10).isin(5, 6, 7, 8)).select("event_id")


@query("""select o_orderkey, o_custkey from orders where o_custkey in
    (select o_custkey from orders group by o_custkey having count(distinct o_orderpriority) <= 3)""")
def group_cap(t: Tables):
    return sampling.entities_with_few_groups(t.orders, "o_custkey", "o_orderpriority", 3).select("o_orderkey", "o_custkey")


@query("""select event_id from events where coalesce(case when event_id % 5 <> 0 then cast(json_extract(props, '$.k') as bigint) < 50 end, true)""")
def valid_examples(t: Tables):
    valid = F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k").cast("long") < 50)
    return t.events.where(F.coalesce(valid, F.lit(True))).select("event_id")


@query("""select doc_id, case lang when 'en' then concat('videos/', source, '/', doc_id, '.mp4') when 'de' then concat('clips/', doc_id, '/rgb.mp4')
      else concat(lang, '/', source, '_', doc_id, '.mp4') end as path, cast(n_chars // 4 as bigint) as video_frame from documents""")
def video_paths(t: Tables):
    own = F.col("doc_id").cast("string")
    path = F.when(F.col("lang") == "en", F.concat(F.lit("videos/"), "source", F.lit("/"), own, F.lit(".mp4"))).when(F.col("lang") == "de", F.concat(F.lit("clips/"), own, F.lit("/rgb.mp4")))
    path = path.otherwise(F.concat("lang", F.lit("/"), "source", F.lit("_"), own, F.lit(".mp4")))
    return t.documents.select("doc_id", path.alias("path"), F.floor(F.col("n_chars") / 4).cast("long").alias("video_frame"))


@query("""select l_suppkey, count(p_partkey) as n_found, count(*) - count(p_partkey) as n_missed from lineitem
    left join (select p_partkey from part where p_size <= 25) on l_partkey = p_partkey group by l_suppkey""")
def lookup_with_misses(t: Tables):
    parts = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    hit = joins.member_flag(t.lineitem.select("l_suppkey", "l_partkey"), parts, ["l_partkey"], "hit")
    return hit.groupBy("l_suppkey").agg(F.count_if("hit").alias("n_found"), F.count_if(~F.col("hit")).alias("n_missed"))


@query("""select a.label, a.vec_id // 120 as frame, a.vec_id as true_id, b.vec_id as said_id,
      round(greatest(0, 1 - list_distance(cast(a.embedding[1:3] as double[]), cast(b.embedding[1:3] as double[]))), 6) as similarity
    from embeddings a join embeddings b on a.label = b.label and a.vec_id // 120 = b.vec_id // 120 where a.vec_id % 2 = 0 and b.vec_id % 2 = 1""")
def similarity_matrix(t: Tables):
    p = t.embeddings.select("label", F.floor(F.col("vec_id") / 120).cast("long").alias("frame"), "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("p"))
    a = p.where("vec_id % 2 = 0").withColumnsRenamed({"vec_id": "true_id", "p": "q"})
    j = a.join(p.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "said_id"), ["label", "frame"])
    return j.select("label", "frame", "true_id", "said_id", rounded(F.greatest(F.lit(0.0), 1 - g.l2(F.col("p"), F.col("q"))), 6).alias("similarity"))


@query("select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey")
def strict_lookup(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return joins.strict_join(t.lineitem.select("l_orderkey", "l_linenumber"), o, ["l_orderkey"], "o_custkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("""with m as (select user_id, event_id, cast(ts as date) as d, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'click'),
      f as (select user_id, event_id, cast(ts as date) as d, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'view'),
      x as (select user_id, d, min(event_id) as e from m group by 1, 2)
    select f.event_id, coalesce(x.e, m.event_id) as mask_id, x.e is not null as exact from f left join x on f.user_id = x.user_id and f.d = x.d left join m on f.user_id = m.user_id and f.k = m.k""")
def mask_alignment(t: Tables):
    e = t.events.withColumn("d", F.to_date("ts"))
    part = lambda kind: sequences.frame_index(e.where(F.col("event_type") == kind), ["user_id"], ORDER, "k").select("user_id", "event_id", "d", "k")
    return joins.exact_or_positional(part("view"), part("click"), ["user_id"], "d", "k", "event_id").select("event_id", "mask_id", "exact")


@query("""with i as (select user_id, list(event_id order by ts, event_id) as ids from events group by user_id), q as (select user_id, ids, unnest([0, 3, 7]) as t from i)
    select q.user_id, cast(q.t as bigint) as t, e.event_id, e.value from q join events e on e.event_id = q.ids[q.t + 1] where q.t < len(q.ids)""")
def frame_indirection(t: Tables):
    i = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("at"))
    q = i.select("user_id", "at", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 3, 7)])).alias("t")).where(F.col("t") < F.size("at"))
    return q.select("user_id", "t", F.get("at", F.col("t").cast("int")).alias("event_id")).join(t.events.select("event_id", "value"), "event_id").select("user_id", "t", "event_id", "value")


@query("""select conv_id, list_position(list(role order by turn), 'assistant') - 1 as entry from conversations group by conv_id having list_position(list(role order by turn), 'assistant') > 0""")
def first_entry(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return c.select("conv_id", (F.array_position("roles", "assistant") - 1).cast("int").alias("entry")).where("entry >= 0")


@query("""with d as (select a.label, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as l2,
        list_avg(list_transform(range(1, 65), lambda i: abs(cast(a.embedding[i] as double) - cast(b.embedding[i] as double)))) as mae from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
      r as (select label, avg(l2) as l2, avg(mae) as mae, count(*) as n from d group by label)
    select label, round(l2, 6) as l2, round(mae, 6) as mae, n from r union all select null, round(avg(l2), 6), round(avg(mae), 6), count(*) from r""")
def rollout_macro(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    e = t.embeddings.join(b, "vec_id")
    diff = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    mae = F.aggregate(diff, F.lit(0.0), lambda a, x: a + x) / F.size("embedding")
    e = e.select("label", g.l2(F.col("embedding"), F.col("other")).alias("l2"), mae.alias("mae"))
    r = metrics.record_then_macro(e, "label", ["l2", "mae"])
    return r.select("label", rounded("l2", 6).alias("l2"), rounded("mae", 6).alias("mae"), "n")


@query("""with r as (select user_id, cast(ts as date) as d, count(*) as a from events where event_type = 'view' group by 1, 2),
      s as (select user_id, cast(ts as date) as d, count(*) as b from events where event_type = 'click' group by 1, 2),
      j as (select coalesce(r.user_id, s.user_id) as user_id, coalesce(a, 0) as a, coalesce(b, 0) as b from r full join s on r.user_id = s.user_id and r.d = s.d),
      p as (select *, case when b > 0 then least(a, b) / cast(b as double) else cast(a = 0 as double) end as p, case when a > 0 then least(a, b) / cast(a as double) else cast(b = 0 as double) end as r from j)
    select user_id, round(avg(p), 6) as "precision", round(avg(r), 6) as recall, round(avg(2 * p * r / (p + r + 1e-10)), 6) as f1, count(*) as num_frames, count(*) filter (b > 0) as frames_with_pred,
      count(*) filter (a > 0) as frames_with_gt, count(*) filter (a > 0 and b > 0) as frames_with_both, count(*) filter (a = 0 and b > 0) as frames_pred_only, count(*) filter (a > 0 and b = 0) as frames_gt_only from p group by user_id""")
def video_score(t: Tables):
    day = t.events.withColumn("d", F.to_date("ts"))
    n = lambda k, c: day.where(F.col("event_type") == k).groupBy("user_id", "d").agg(F.count("*").alias(c))
    f = n("view", "n_true").join(n("click", "n_said"), ["user_id", "d"], "full").na.fill(0, ["n_true", "n_said"])
    s = metrics.video_score(f.withColumn("hit", F.least("n_true", "n_said")), ["user_id"], "hit", "n_said", "n_true")
    return s.select("user_id", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")], *[c for c in s.columns if "frames" in c])


@query("""with c as (select source, count(*) as n_rows from documents group by source)
    select source, round(n_rows / cast(sum(n_rows) over () as double), 9) as naive, round(1.0 / count(*) over (), 9) as uniform,
      round(case when source = 'src0' then 3.0 when source = 'src1' then 0.0 else 1.0 end / sum(case when source = 'src0' then 3.0 when source = 'src1' then 0.0 else 1.0 end) over (), 9) as manual from c""")
def mixture_kinds(t: Tables):
    out = None
    for kind in ("naive", "uniform", "manual"):
        m = sampling.mixture(t.documents, "source", kind, {"src0": 3.0, "src1": 0.0}, default=1.0).select("source", rounded("weight", 9).alias(kind))
        out = m if out is None else out.join(m, "source")
    return out


@query("select p_brand, round(avg(p_retailprice), 6) as mean_price, round(sum(p_retailprice), 4) as sum_price from part group by p_brand")
def checked_metrics(t: Tables):
    return t.part.groupBy("p_brand").agg(rounded(metrics.checked(F.avg("p_retailprice"), "mean_price"), 6).alias("mean_price"), rounded(metrics.checked(F.sum("p_retailprice"), "sum_price"), 4).alias("sum_price"))


@query("""select lang, [max(n_chars), max(doc_id % 13), max(length(source))] as shape from documents group by lang""")
def spec_max(t: Tables):
    spec = F.array(F.col("n_chars"), F.col("doc_id") % 13, F.length("source").cast("long"))
    return metrics.largest_shapes(t.documents.withColumn("shape", spec), "lang", "shape", 3)


@query("""with x as (select p_brand, p_size, case when p_size % 7 = 0 then -1 else p_size % 5 end as seg, cast(p_size > 10 as double) as m from part)
    select p_brand, round(sum(p_size * m) / (sum(m) + 1e-6), 6) as masked_size, round(avg(cast(p_size >= 40 as double)), 6) as share_truncated, count(distinct seg) filter (seg > 0) as n_segments from x group by p_brand""")
def batch_report(t: Tables):
    seg = F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size") % 5)
    m = (F.col("p_size") > 10).cast("double")
    return t.part.groupBy("p_brand").agg(
        rounded(F.sum(F.col("p_size") * m) / (F.sum(m) + 1e-6), 6).alias("masked_size"), rounded(F.avg((F.col("p_size") >= 40).cast("double")), 6).alias("share_truncated"), F.count_distinct(F.when(seg > 0, seg)).alias("n_segments")
    )


@query("""with l as (select event_id, value, lag(value) over (partition by user_id order by ts, event_id) as before from events)
    select event_id, round(value - before, 6) as step from l where value <= 60 and before <= 60""")
def visible_steps(t: Tables):
    return sequences.visible_difference(t.events, ["user_id"], ORDER, "value", F.col("value") <= 60, "step").select("event_id", rounded("step", 6).alias("step"))


@query(f"""with {_F} select event_id, round(coalesce(lag(value, 4) over w, first_value(value) over w), 6) as h3, round(coalesce(lag(value, 2) over w, first_value(value) over w), 6) as h2, round(value, 6) as h1,
      round(coalesce(lead(value, 2) over w, last_value(value) over (partition by user_id order by frame rows between unbounded preceding and unbounded following)), 6) as f1 from f window w as (partition by user_id order by frame)""")
def strided_window(t: Tables):
    e = sequences.history_and_future(frames(t), ["user_id"], "frame", "value", history=3, future=1, stride=2)
    return e.select("event_id", *[rounded(F.col("history")[k], 6).alias(f"h{3 - k}") for k in range(3)], rounded(F.col("future")[0], 6).alias("f1"))


@query("select o_custkey, min(o_orderkey) + 2 as t from orders group by o_custkey having count(*) >= 5")
def first_history(t: Tables):
    c = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("begin"), F.count("*").alias("n"))
    return c.where(F.col("n") >= 3 + 2).select("o_custkey", (F.col("begin") + 3 - 1).alias("t"))


_RUNS = f"""{_F}, a as (select user_id, frame, n, frame - row_number() over (partition by user_id order by frame) as g from f where value >= 10),
    r as (select user_id, n, min(frame) as s, max(frame) as e from a group by user_id, n, g)"""


@query(f"""with {_RUNS}, o as (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events group by 1, 2),
      b as (select *, row_number() over (partition by user_id order by least(e + 2, n - 1) - greatest(s - 1, 0) desc, s) as k from r)
    select b.user_id, event_type as best, greatest(s - 1, 0) as "begin", least(e + 2, n - 1) as "end" from b join o on o.user_id = b.user_id and o.k = 1 where b.k = 1""")
def best_object_clip(t: Tables):
    runs = sequences.islands(frames(t), ["user_id", "n"], "frame", F.col("value") >= 10, min_gap=1, min_length=1)
    runs = runs.select("user_id", F.greatest(F.col("begin") - 1, F.lit(0)).alias("begin"), F.least(F.col("end") + 2, F.col("n") - 1).alias("end"), F.col("begin").alias("s"))
    clip = runs.groupBy("user_id").agg(F.max_by(F.struct("begin", "end"), F.struct(F.col("end") - F.col("begin"), -F.col("s"))).alias("c"))
    kinds = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("k")).groupBy("user_id").agg(F.min(F.struct(-F.col("k"), "event_type"))["event_type"].alias("best"))
    return clip.join(kinds, "user_id").select("user_id", "best", "c.begin", "c.end")


@query(f"""with {_F}, v as (select user_id, event_type, frame, cast(floor(value) as bigint) as x, event_id % 100 as y, row_number() over (partition by user_id, event_type order by frame) as k from f where value <= 60)
    select user_id, event_type, frame, row_number() over (partition by user_id order by frame * 10000 + x * 100 + y, event_type) - 1 as nth from v where k = 1""")
def initial_points(t: Tables):
    v = frames(t).where("value <= 60").withColumn("key", F.col("frame") * 10000 + F.floor("value") * 100 + F.col("event_id") % 100)
    first = v.groupBy("user_id", "event_type").agg(F.min_by(F.struct("frame", "key"), "frame").alias("p")).select("user_id", "event_type", "p.*")
    return first.select("user_id", "event_type", "frame", (F.row_number().over(Window.partitionBy("user_id").orderBy("key", "event_type")) - 1).cast("long").alias("nth"))


@query(f"""with {_F}, q as (select user_id, min(frame) as q0 from f where value <= 60 group by user_id), s as (select user_id, count(*) as qs from f where frame % 5 = 0 and value <= 60 group by user_id),
      m as (select user_id, max(n) as n from f group by user_id)
    select m.user_id, coalesce(n - 1 - q0, 0) as n_first, coalesce(qs, 0) * (n - 1) as n_strided from m left join q using (user_id) left join s using (user_id)""")
def evaluation_masks(t: Tables):
    f = frames(t)
    first = metrics.evaluated_frames(f, ["user_id"], "frame", F.col("value") <= 60, "first").groupBy("user_id").agg(F.count("*").alias("n_first"))
    strided = metrics.evaluated_frames(f, ["user_id"], "frame", F.col("value") <= 60, "strided", 5).groupBy("user_id").agg(F.count("*").alias("n_strided"))
    out = t.events.select("user_id").distinct().join(first, "user_id", "left").join(strided, "user_id", "left")
    return out.na.fill(0, ["n_first", "n_strided"])


@query(f"""with {_RUNS}, o as (select *, e - s + 1 as len, coalesce(sum(e - s + 1) over (partition by user_id order by s rows between unbounded preceding and 1 preceding), 0) as a, sum(e - s + 1) over (partition by user_id) as total from r),
      u as (select *, cast(floor(((user_id + 3) % 2147483648) * 2654435761 % 4294967296 / 4294967296.0 * total) as bigint) as k from o)
    select user_id, cast(s + k - a as bigint) as t from u where k >= a and k < a + len""")
def range_union_pick(t: Tables):
    runs = sequences.islands(frames(t), ["user_id"], "frame", F.col("value") >= 10, min_gap=1, min_length=1)
    return sampling.pick_in_ranges(runs, ["user_id"], "begin", "end", sampling.uniform(F.col("user_id"), 3), "t")


@query(f"""with {_F} select event_id, [round(coalesce(lead(value, 1) over w, last_value(value) over x), 6), round(coalesce(lead(value, 2) over w, last_value(value) over x), 6)] as chunk,
      [frame + 1 >= n, frame + 2 >= n] as is_pad from f window w as (partition by user_id order by frame), x as (partition by user_id order by frame rows between unbounded preceding and unbounded following)""")
def action_chunk(t: Tables):
    e = sequences.history_and_future(frames(t), ["user_id"], "frame", "value", history=1, future=2)
    return e.select("event_id", F.transform("future", lambda x: rounded(x, 6)).alias("chunk"), F.array(F.col("frame") + 1 >= F.col("n"), F.col("frame") + 2 >= F.col("n")).alias("is_pad"))


@query("""select vec_id as key, list_transform([1, 2, 3], lambda k: round(cast(embedding[2] as double) + k * (cast(embedding[2] as double) - cast(embedding[1] as double)), 5)) as kept from embeddings""")
def rolling_forecast(t: Tables):
    def step(df):
        a, b = F.get("history", F.lit(0)), F.get("history", F.lit(1))
        return df.select("key", F.array(2 * b - a, 3 * b - 2 * a).alias("future"))

    start = t.embeddings.select(F.col("vec_id").alias("key"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("history"))
    return schedule.rollout(start, step, rounds=3, keep=1, history=2).select("key", F.transform("kept", lambda x: rounded(x, 5)).alias("kept"))


@query("""with s as (select conv_id, turn, cast(length(text) as double) as v, lead(turn) over (partition by conv_id order by turn) as t2, lead(cast(length(text) as double)) over (partition by conv_id order by turn) as v2 from conversations),
      g as (select conv_id, turn + h as t, s.turn, v, t2, v2, h from s cross join (values (0.0::double), (0.25::double)) as x(h))
    select conv_id, t, round(case when t2 is null then v else v + (t - turn) / (t2 - turn) * (v2 - v) end, 6) as v from g""")
def resampled(t: Tables):
    c = t.conversations.select("conv_id", F.col("turn").cast("double").alias("turn"), F.length("text").cast("double").alias("v"))
    grid = c.select("conv_id", F.explode(F.array(F.col("turn"), F.col("turn") + 0.25)).alias("t"))
    return schedule.resample(c, ["conv_id"], "turn", "v", grid, "t").select("conv_id", "t", rounded("v", 6).alias("v"))


@query(f"""with {_F}, m as (select frame, avg(value) over (partition by user_id order by frame rows between 4 preceding and current row) as m from f)
    select frame, round(avg(m), 6) as node_mean, count(*) as n_nodes from m group by frame""")
def node_mean(t: Tables):
    m = sequences.trailing_mean(frames(t), ["user_id"], ["frame"], "value", 5, "m")
    return m.groupBy("frame").agg(rounded(F.avg("m"), 6).alias("node_mean"), F.count("*").alias("n_nodes"))


@query("""select doc_id, text from (select doc_id, source as text from documents where lang = 'fr') order by doc_id limit 25""")
def source_head(t: Tables):
    """An equality filter and the first rows in order (a head limit is the feature)."""
    return t.documents.where("lang = 'fr'").orderBy("doc_id").limit(25).select("doc_id", F.col("source").alias("text"))


@query("""with h as (select distinct o_custkey as house from orders), k as (select house, (house + 11) % 2147483648 * 2654435761 % 4294967296 as u from h),
      r as (select *, row_number() over (order by u, house) as rn, count(*) over () as n from k)
    select house, case when rn <= greatest(1, floor(n * 0.05)) then 'val' else 'train' end as part from r""")
def house_split(t: Tables):
    houses = t.orders.select(F.col("o_custkey").alias("house")).distinct()
    return sampling.split_least(houses, "house", 0.05, seed=11)
