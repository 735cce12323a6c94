"""Queries that SQL can't say: solvers, k-means and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assignment, clusters, metrics, packing
from ..sources.files import write_files
from ..storage import new_folder
from ..streaming import events, polling
from .registry import Tables, query, rounded


def _policy(rows: str, shards: str, then: str) -> str:
    """The buffered packer as a recursion over each shard's rows in order: all choices of the six
    rows held are tried, the fullest leaves (of equals the one without later rows). ``r`` has
    what is held after each row, ``gone`` what left."""
    over = "(x.a + 63) // 64 > 128 or x.b > 4"
    of = lambda v: f"list_sum([{v} * ((m >> (i - 1)) & 1) for i in range(1, len(x.held) + 1)])"
    return f"""with recursive d as ({rows}), s as (select {shards} as shards), e as (select key, a, b, key % shards as shard, row_number() over (partition by key % shards order by key) as n from d cross join s),
      l as (select shard, max(n) as m from e group by 1),
      r as (select shard, 0::bigint as n, []::struct(key bigint, a bigint, b bigint)[] as held, 0::bigint as bins, []::struct(key bigint, a bigint, b bigint)[] as gone from l union all
        select shard, n, case when due then [held[i] for i in range(1, len(held) + 1) if (mask >> (i - 1)) & 1 = 0] else held end || case when stays then [row] else [] end, bins + (due or alone)::int,
            case when alone then [row] when due then [held[i] for i in range(1, len(held) + 1) if (mask >> (i - 1)) & 1 = 1] else [] end
        from (select *, case when best % 4096 = 0 then 1 else 4096 - best % 4096 end as mask from (select x.*, {{'key': x.key, 'a': x.a, 'b': x.b}} as row, x.key is not null and ({over}) as alone, x.key is not null and not ({over}) as stays,
            len(x.held) > 0 and (x.key is null or not ({over}) and len(x.held) >= 6) as due,
            list_max([case when {of("((x.held[i].a + 63) // 64)")} <= 128 and {of("x.held[i].b")} <= 4 then {of("x.held[i].a")} * 4096 - m else -1 end for m in range(1, 1 << len(x.held))]) as best
          from (select r.shard, r.n + 1 as n, r.held, r.bins, e.key, e.a, e.b from r left join e on e.shard = r.shard and e.n = r.n + 1 where e.key is not null or len(r.held) > 0) as x)))
    {then}"""


_GONE = "select shard, bins - 1 as bin, cast(place as bigint) as place, x.key as key, x.a as a, x.b as b from (select shard, bins, unnest(gone) as x, unnest(range(len(gone))) as place from r)"
_SIZES = "select doc_id as key, n_chars as a, 1::bigint as b from documents"
#: The limits of these queries: 8192 characters, four documents.
LIMITS = (8192, 4)


@query(_policy(_SIZES, "(select greatest(8, (count(*) + 49999) // 50000) from documents)", _GONE))
def knapsack_pack(t: Tables):
    return packing.knapsack_pack(t.documents.withColumn("one", F.lit(1)), "doc_id", "n_chars", "one", LIMITS, buffer=6)


def _pairs(t: Tables):
    """True and said points of a frame: vectors of one label, all components, of 120 each."""
    p = t.embeddings.select("label", F.floor(F.col("vec_id") / 120).cast("long").alias("frame"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    a, b = p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1")
    j = a.select("label", "frame", F.col("vec_id").alias("true_id"), F.col("p").alias("q")).join(b.withColumnRenamed("vec_id", "said_id"), ["label", "frame"])
    return j.withColumn("d", g.l2(F.col("p"), F.col("q"))).drop("p", "q")


#: Pairs of each frame, and their least cost over all matchings: rows of the smaller side are matched one
#: by one (i), a state is the set of columns taken (mask), and of equal sets the cheapest is kept.
_FRAMES = """p as (select label, vec_id // 120 as frame, vec_id, cast(embedding as double[]) as v from embeddings),
    d as (select a.label, a.frame, a.vec_id as t, b.vec_id as s, list_distance(a.v, b.v) as d from p a join p b on a.label = b.label and a.frame = b.frame and a.vec_id % 2 = 0 and b.vec_id % 2 = 1),
    n as (select label, frame, count(distinct t) as nt, count(distinct s) as ns from d group by 1, 2),
    c as (select d.*, dense_rank() over (partition by label, frame order by if(nt <= ns, t, s)) as i, dense_rank() over (partition by label, frame order by if(nt <= ns, s, t)) - 1 as j from d join n using (label, frame))"""


def _matchings(cost: str, carried: str, first: str) -> str:
    """The states, with what is carried along by the best way into each."""
    return f"""r as (select label, frame, 0::bigint as i, 0::bigint as mask, 0::double as cost, {first} as held from n union all
    select label, frame, i, mask, min(cost), arg_min(held, cost) from (select r.label, r.frame, c.i, r.mask | (1::bigint << c.j) as mask, r.cost + {cost} as cost, {carried} as held
      from r join c on c.label = r.label and c.frame = r.frame and c.i = r.i + 1 and (r.mask >> c.j) & 1 = 0) group by 1, 2, 3, 4),
    best as (select label, frame, nt, ns, min(r.cost) as cost, arg_min(r.held, r.cost) as held from r join n using (label, frame) where r.i = least(nt, ns) group by 1, 2, 3, 4)"""


@query("""with e as (select doc_id // 8 as grp, row_number() over (partition by doc_id // 8 order by doc_id) - 1 as k, n_chars as a from documents), g as (select distinct grp from e), m as (select grp, mask from g cross join (select unnest(range(256)) as mask)),
      s as (select m.grp, m.mask, coalesce(sum(a), 0) as total, count(a) as n from m left join e on e.grp = m.grp and (m.mask >> e.k) & 1 = 1 group by 1, 2)
    select grp, cast(max(total) as bigint) as best from s where total <= 8192 and n <= 3 group by grp""")
def knapsack_best(t: Tables):
    """The fullest choice of at most three of each eight documents under a limit."""
    d = t.documents.select(F.floor(F.col("doc_id") / 8).cast("long").alias("grp"), "doc_id", "n_chars")
    return packing.fullest(d, "grp", "doc_id", "n_chars", (8192, 3))


_P3 = """p as (select vec_id // 6 as grp, vec_id, cast(embedding[1:3] as double[]) as v from embeddings), t as (select grp, vec_id, v, row_number() over (partition by grp order by vec_id) as k from p where vec_id % 2 = 0),
    s as (select grp, vec_id, v, row_number() over (partition by grp order by vec_id) as k from p where vec_id % 2 = 1), c as (select t.grp, t.k as i, s.k as j, list_distance(t.v, s.v) as d from t join s using (grp)), w as (select grp from c group by grp having count(*) = 9)"""


@query(f"""with {_P3} select a.grp, round(min(a.d + b.d + c3.d), 6) as cost from c a join c b on a.grp = b.grp and a.i = 1 and b.i = 2 and a.j <> b.j join c c3 on c3.grp = a.grp and c3.i = 3 and c3.j <> a.j and c3.j <> b.j join w on w.grp = a.grp group by a.grp""")
def assignment_cost(t: Tables):
    """The least cost of matching three points with three, of each six vectors."""
    p = t.embeddings.select(F.floor(F.col("vec_id") / 6).cast("long").alias("grp"), "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("p"))
    a = p.where("vec_id % 2 = 0").withColumnsRenamed({"vec_id": "true_id", "p": "q"})
    j = a.join(p.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "said_id"), "grp").withColumn("d", g.l2(F.col("p"), F.col("q")))
    whole = j.groupBy("grp").count().where("count = 9").select("grp")
    best = metrics.least_cost(j.join(whole, "grp", "left_semi"), ["grp"], "true_id", "said_id", "d")
    return best.select("grp", rounded("cost", 6).alias("cost"))


@query("""with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as f, event_type as t, coalesce(lead(event_type) over (partition by user_id order by ts, event_id), event_type) as p, 1 / (1 + abs(value - coalesce(lead(value) over (partition by user_id order by ts, event_id), value))) as s from events),
      nt as (select user_id, t, count(*) as nt from e group by 1, 2), np as (select user_id, p, count(*) as np from e group by 1, 2), al as (select (i * 5) / 100.0::double as a from (select unnest(range(1, 20)) as i)),
      h as (select user_id, a, count(*) filter (s >= a - 1e-12) as hits, count(*) as n, coalesce(sum(s) filter (s >= a - 1e-12), 0) as loc from e cross join al group by 1, 2),
      m as (select e.user_id, a, e.t, e.p, count(*) as m from e cross join al where s >= a - 1e-12 group by 1, 2, 3, 4),
      k as (select m.user_id, a, sum(m * m / cast(greatest(nt + np - m, 1) as double)) as x from m join nt on nt.user_id = m.user_id and nt.t = m.t join np on np.user_id = m.user_id and np.p = m.p group by 1, 2),
      r as (select h.user_id, hits / cast(greatest(2 * n - hits, 1) as double) as det, coalesce(x, 0) / greatest(hits, 1) as ass, case when hits > 0 then loc / hits else 1 end as loc, hits / cast(n as double) as re from h left join k on k.user_id = h.user_id and k.a = h.a)
    select user_id, round(avg(sqrt(det * ass)), 5) as hota, round(avg(det), 5) as det_a, round(avg(ass), 5) as ass_a, round(avg(loc), 5) as loc_a, round(avg(re), 5) as det_re, round(avg(re), 5) as det_pr from r group by user_id""")
def hota_single(t: Tables):
    """HOTA of tracks with one true and one said object a frame, whose matching is plain."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", F.row_number().over(w).alias("f"), F.col("event_type").alias("t"), F.coalesce(F.lead("event_type").over(w), "event_type").alias("p"), (1 / (1 + F.abs(F.col("value") - F.coalesce(F.lead("value").over(w), "value")))).alias("s"))
    r = metrics.hota(e, "user_id", "f", "t", "p", "s")
    return r.select("user_id", *[rounded(c, 5).alias(c) for c in ("hota", "det_a", "ass_a", "loc_a", "det_re", "det_pr")])


@query(f"""with recursive {_FRAMES}, {_matchings("c.d", "r.held + (c.d <= 1.3)::int", "0")},
      f as (select label, frame, cast(held as bigint) as hits, held / cast(ns as double) as precision, held / cast(nt as double) as recall from best)
    select label, frame, hits, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall + 1e-10), 6) as f1 from f""")
def hungarian_f1(t: Tables):
    f = metrics.matched_f1(_pairs(t), ["label", "frame"], "true_id", "said_id", "d", 1.3)
    return f.select("label", "frame", "hits", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""with recursive {_FRAMES}, {_matchings("c.d", "0", "0")}
    select label, frame, nt as n_true, ns as n_said, least(nt, ns) as n_pairs, round(cost, 6) as cost, round(cost, 6) as price, true as feasible, true as tight from best""")
def assignment_certificate(t: Tables):
    """The least cost of matching each frame's points, with the prices that prove it: the other
    engine tries all matchings and has to find the same cost, and prices that add up to it."""
    by = ["label", "frame"]
    c = assignment.certificate(assignment.assigned(_pairs(t), by, "true_id", "said_id", "d"), by)
    return c.withColumns({x: rounded(x, 6) for x in ("cost", "price")})


@query(f"""with recursive {_FRAMES}, x as (select label, frame, i, j, t % 120 as t, s % 120 as s, 1 - d / 2 as x from c),
      sh as (select *, sum(x) over (partition by label, frame, t) + sum(x) over (partition by label, frame, s) - x as w from x),
      nt as (select label, t, count(distinct frame) as ct from x group by 1, 2), ns as (select label, s, count(distinct frame) as cs from x group by 1, 2),
      al as (select label, t, s, sum(x / w) as a from sh group by 1, 2, 3), gl as (select al.label, al.t, al.s, a / (ct + cs - a) as g, ct, cs from al join nt using (label, t) join ns using (label, s)),
      k as (select x.*, g * x as gain from x join gl using (label, t, s)),
      r as (select label, frame, 0::bigint as i, 0::bigint as mask, 0::double as gain, []::bigint[] as held from n union all
        select label, frame, i, mask, max(gain), arg_max(held, gain) from (select r.label, r.frame, k.i, r.mask | (1::bigint << k.j) as mask, r.gain + k.gain as gain, list_append(r.held, k.t * 1000 + k.s) as held
          from r join k on k.label = r.label and k.frame = r.frame and k.i = r.i + 1 and (r.mask >> k.j) & 1 = 0) group by 1, 2, 3, 4),
      best as (select label, frame, unnest(arg_max(r.held, r.gain)) as pair from r join n using (label, frame) where r.i = least(nt, ns) group by 1, 2),
      m as (select x.label, x.t, x.s, x.x from best join x on x.label = best.label and x.frame = best.frame and x.t * 1000 + x.s = best.pair),
      th as (select i / 20.0::double as a from (select unnest(range(1, 20)) as i)),
      ln as (select label, a, t, s, count(*) as m, sum(x) as loc from m cross join th where x >= a - 1e-12 group by 1, 2, 3, 4),
      sm as (select ln.label, a, sum(m) as hits, sum(loc) as loc, sum(m * m / cast(greatest(ct + cs - m, 1) as double)) as ass from ln join gl using (label, t, s) group by 1, 2),
      tot as (select label, st, ss from (select label, sum(ct) as st from nt group by 1) join (select label, sum(cs) as ss from ns group by 1) using (label)),
      e as (select tot.label, coalesce(hits, 0) as h, coalesce(loc, 0) as loc, coalesce(ass, 0) as ass, st, ss from tot cross join th left join sm on sm.label = tot.label and sm.a = th.a)
    select label, round(avg(sqrt(h / greatest(st + ss - h, 1) * ass / greatest(h, 1))), 6) as hota, round(avg(h / greatest(st + ss - h, 1)), 6) as det_a, round(avg(ass / greatest(h, 1)), 6) as ass_a, round(avg(case when h > 0 then loc / h else 1 end), 6) as loc_a,
      round(avg(h / greatest(st, 1)), 6) as det_re, round(avg(h / greatest(ss, 1)), 6) as det_pr from e group by label""")
def hota(t: Tables):
    """HOTA of frames with several true and said objects."""
    near = _pairs(t).withColumn("similarity", 1 - F.col("d") / 2)
    h = metrics.hota(near.withColumn("true_id", F.col("true_id") % 120).withColumn("said_id", F.col("said_id") % 120), "label", "frame", "true_id", "said_id", "similarity")
    return h.select("label", *[rounded(c, 6).alias(c) for c in ("hota", "det_a", "ass_a", "loc_a", "det_re", "det_pr")])


def _clusters(k: int, rounds: int, passes: int, share: float) -> str:
    """The same steps of k-means as tables, each made of the one before."""
    u = lambda r: f"((('0x' || substr(sha256(cast(id as varchar) || ':{r}'), 1, 8))::bigint) + 0.5) / 4294967296.0"
    near = lambda points, centres: f"select p.id, arg_min(c.o, [list_distance(p.v, c.v), c.o::double]) as o, min(list_distance(p.v, c.v)) as d from {points} p cross join {centres} c group by p.id"
    ctes = ["p as materialized (select vec_id as id, cast(embedding as double[]) as v from embeddings)", f"s0 as materialized (select 0::bigint as o, v from (select v, row_number() over (order by {u(0)}, id) as n from p) where n = 1)"]
    for r in range(1, rounds + 1):
        ctes += [f"n{r} as materialized ({near('p', f's{r - 1}')})",
            f"s{r} as materialized (select * from s{r - 1} union all select (select count(*) from s{r - 1}) + row_number() over (order by id) - 1, v from p join n{r} using (id) where {u(r)} < {share} / (select sum(d * d) from n{r}) * d * d)"]
    ctes += [f"w as materialized ({near('p', f's{rounds}')})", f"c0 as materialized (select row_number() over (order by n desc, o) - 1 as o, v from (select s.o, s.v, count(w.id) as n from s{rounds} s left join w using (o) group by all) qualify row_number() over (order by n desc, o) <= {k})"]
    for i in range(passes):
        ctes += [f"a{i} as materialized ({near('p', f'c{i}')})",
            f"m{i} as materialized (select o, list(m order by k) as v from (select o, k, avg(x) as m from (select a{i}.o, unnest(p.v) as x, unnest(range(len(p.v))) as k from a{i} join p using (id)) group by 1, 2) group by 1)",
            f"c{i + 1} as materialized (select c{i}.o, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (o))"]
    ctes += [f"f as materialized ({near('p', f'c{passes}')})", "g as (select o, count(*) as n, arg_min(id, [d, id::double]) as point_id from f group by 1)"]
    return f"with {', '.join(ctes)} select g.o as cluster, n, point_id, axis, round(x, 5) as centre from (select o, unnest(v) as x, unnest(range(len(v))) as axis from c{passes}) join g using (o)"


@query(_clusters(100, 3, 5, 200.0))
def kmeans_points(t: Tables):
    """A hundred clusters of the vectors: centres, sizes and the vector nearest to each centre."""
    centres, points = clusters.kmeans(t.embeddings, "vec_id", "embedding", 100, passes=5, rounds=3)
    rows = [(k, axis, float(x)) for k, c in enumerate(centres) for axis, x in enumerate(c)]  # a hundred times the vector's length
    own = t.spark.createDataFrame(rows, "cluster long, axis long, centre double")
    near = clusters.representatives(points).withColumnRenamed("id", "point_id")
    return own.join(near, "cluster").select("cluster", "n", "point_id", "axis", rounded("centre", 5).alias("centre"))


@query("""select time_bucket(interval '1 hour', ts) as "start", event_type, count(*) as n from events group by 1, 2""")
def stream_tumbling(t: Tables):
    n = events.table_of(events.tumbling_counts(events.read_stream(t.spark, f"{t.folder}/events*"), "1 hour"), "complete")
    return n.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select event_id, user_id, event_type from events")
def stream_dedup(t: Tables):
    s = events.read_stream(t.spark, f"{t.folder}/events*")
    return events.table_of(events.deduplicated(s, ["event_id"])).select("event_id", "user_id", "event_type")


def _sizes(t: Tables, path: str):
    return events.read_stream(t.spark, path, "documents", files_per_trigger=1_000_000).withColumn("one", F.lit(1))


@query(_policy(_SIZES, "4", _GONE))
def stream_pack(t: Tables):
    return events.packed_table(_sizes(t, f"{t.folder}/documents*"), "doc_id", "n_chars", "one", LIMITS, buffer=6)


@query("select doc_id as key, n_chars as a from documents")
def stream_pack_rows(t: Tables):
    """Every row of the stream is in one bin, those that waited at its end included."""
    return events.packed_table(_sizes(t, f"{t.folder}/documents*"), "doc_id", "n_chars", "one", (8192, 16)).select("key", "a")


def _stopped_and_resumed(t: Tables):
    """A stream of the first half of the ids, stopped; then one that begins again with all ids and
    the same checkpoint: what each emitted, and the checkpoint."""
    folder, marks = new_folder(t.spark, "waves"), new_folder(t.spark, "marks")
    half, emitted = F.col("doc_id") <= (t.documents.agg(F.max("doc_id")).first()[0] or 0) // 2, []
    for k, wave in enumerate((t.documents.where(half), t.documents)):
        wave.write.parquet(f"{folder}/wave{k}")
        emitted.append(events.table_of(events.packed(_sizes(t, f"{folder}/wave*"), "doc_id", "n_chars", "one", LIMITS, buffer=6, growing=True), checkpoint=marks))
    return emitted, marks


@query(_policy("with w as (select * from documents where doc_id <= (select max(doc_id) // 2 from documents) union all select * from documents) select doc_id as key, any_value(n_chars) as a, 1::bigint as b from w group by 1", "4", _GONE))
def stream_pack_replayed(t: Tables):
    """The packer is stopped half-way and begins again at the beginning of its input: rows that it
    has seen are left out, and the bins are those of one pass."""
    (one, two), marks = _stopped_and_resumed(t)
    return one.unionByName(two).unionByName(events.drained(t.spark, marks, LIMITS, 6))


@query(_policy(_SIZES, "4", "select r.shard, (select max(key) from e where e.shard = r.shard) as last, r.bins as bins, [h.key for h in r.held] as waiting from r join l on l.shard = r.shard and l.m = r.n"))
def packer_state(t: Tables):
    """What a checkpoint of the packer says: the last id, the bins so far, and the ids that wait."""
    _, marks = _stopped_and_resumed(t)
    held, bins, last = (events.state_of(t.spark, marks, n) for n in ("held", "bins", "last"))
    return last.join(bins, "shard", "left").join(held, "shard", "left").select("shard", "last", F.coalesce("bins", F.lit(0)).alias("bins"), F.transform(F.coalesce("held", F.array()), lambda x: x["key"]).alias("waiting"))


@query("select 'n' || cast(s_nationkey as varchar) as unit, count(*) as n_files, cast(sum(strlen(s_name)) as bigint) as bytes from supplier group by 1")
def polled_folder(t: Tables):
    """A file for each supplier, in a folder of its nation; nations arrive in two waves, the second
    while the first is taken up. Folders come out once they have been left alone."""
    folder, log, marks = (new_folder(t.spark, n) for n in ("inbox", "log", "marks"))
    files = t.supplier.select(F.format_string("n%d/s%d.txt", "s_nationkey", "s_suppkey").alias("path"), F.col("s_name").cast("binary").alias("content"), (F.col("s_nationkey") % 2).alias("wave"), "s_nationkey")
    write_files(files.where("wave = 0"), folder)
    query, wanted = polling.poll(t.spark, folder, log, marks, 1500, pattern="*.txt", depth=1), 0
    try:
        for wave in (0, 1):
            if wave:
                write_files(files.where("wave = 1"), folder)
            wanted += files.where(F.col("wave") == wave).select("s_nationkey").distinct().count()
            polling.wait(query, log, wanted)
    finally:
        polling.stop(query)
    return polling.done(t.spark, log).select("unit", "n_files", "bytes")
