"""Queries on orders, draws, samplers, beams, packing of arrays and resumed work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decoding, joins, ordering, packing, recovery, sampling, schedule, sequences
from .registry import Tables, query, rounded

ORDER = ["ts", "event_id"]


@query("select doc_id, row_number() over (order by source, doc_id) - 1 as place from documents")
def total_order(t: Tables):
    return ordering.global_position(t.documents.select("source", "doc_id"), ["source", "doc_id"], "place").select("doc_id", "place")


@query("""with l as (select label, vec_id, row_number() over (partition by label order by ((vec_id + 5) % 2147483648) * 2654435761 % 4294967296, vec_id) - 1 as r, count(*) over (partition by label) as n from embeddings),
      p as (select distinct label, n from l), x as (select label, n, unnest(range(64)) as j from p),
      i as (select label, j, case when n >= 64 or j < n then j else ((label * 1000 + j + 5) % 2147483648) * 2654435761 % 4294967296 % n end as r from x)
    select i.label, i.j as place, l.vec_id from i join l on l.label = i.label and l.r = i.r""")
def sample_with_extras(t: Tables):
    return sampling.sample_with_extras(t.embeddings.select("label", "vec_id"), "label", "vec_id", 64, seed=5)


@query("""with f as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as frame from events),
      s as (select user_id, event_type, 10 * cast(coalesce(bool_and(value <= 60) filter (frame < 3), false) as int) + coalesce(avg(cast(value <= 60 as double)) filter (frame >= 3), 0) as score from f group by 1, 2)
    select user_id, event_type, round(score, 6) as score from (select *, row_number() over (partition by user_id order by score desc, event_type) as k from s) where k <= 2""")
def score_points(t: Tables):
    f = sequences.frame_index(t.events, ["user_id", "event_type"], ORDER)
    s = sampling.best_seen_points(f, ["user_id"], "event_type", F.col("frame") < 3, F.col("value") <= 60, 2)
    return s.select("user_id", "event_type", rounded("score", 6).alias("score"))


@query("""with e as (select doc_id, ep as epoch, ((doc_id * 31 + ep * 7919 + 4) % 2147483648) * 2654435761 % 4294967296 as h from documents cross join (select unnest(range(3)) as ep))
    select doc_id, epoch, row_number() over (partition by epoch order by h, doc_id) - 1 as place from e""")
def epoch_permutation(t: Tables):
    return schedule.epoch_order(t.documents.select("doc_id"), "doc_id", 3, 4)


@query("""with e as (select doc_id, row_number() over (order by ((doc_id * 31 + 4) % 2147483648) * 2654435761 % 4294967296, doc_id) - 1 as place from documents)
    select doc_id, place % 4 as shard, place // 8 % 2 as rank, place // 8 // 2 % 3 as worker from e""")
def permuted_shards(t: Tables):
    e = schedule.epoch_order(t.documents.select("doc_id"), "doc_id", 1, 4)
    rank, worker = schedule.owner(F.col("place"), ranks=2, workers=3, batch=8)
    return e.select("doc_id", (F.col("place") % 4).alias("shard"), rank.alias("rank"), worker.alias("worker"))


def _rates(t: Tables) -> dict[str, float]:
    """A rate for each language, as many as there are."""
    return {r["lang"]: float(r["n"]) for r in t.documents.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}


_RATES = "c as (select lang as source, count(*) as n from documents where lang is not null group by 1), e as (select source, n, sum(n) over (order by source) as run, sum(n) over () as total from c)"


@query(f"""with {_RATES}, d as (select i as position, ((i + 9) % 2147483648) * 2654435761 % 4294967296 / 4294967296.0 as u from (select unnest(range((select count(*) from documents))) as i)),
      s as (select position, arg_min(source, run) as source from d join e on u * total < run group by 1)
    select position, source, row_number() over (partition by source order by position) - 1 as nth from s""")
def multinomial_schedule(t: Tables):
    """As many draws as there are documents, of a language with its share of them."""
    return schedule.multinomial_draws(t.spark, _rates(t), t.documents.count(), 9)


@query(f"""with {_RATES}, s as (select source, n / total::double as rate from e), d as (select source, rate, unnest(range(cast(ceil((select count(*) from documents) * rate) as bigint) + 1)) as nth from s),
      r as (select source, nth, row_number() over (order by (nth + 0.5::double) / rate, source) - 1 as position from d)
    select position, source, nth from r where position < (select count(*) from documents)""")
def stratified_schedule(t: Tables):
    return schedule.stratified_draws(t.spark, _rates(t), t.documents.count())


@query("""with c as (select user_id, event_type, count(*) as n from events group by 1, 2),
      r as (select *, sum(n) over (partition by user_id order by event_type) as run, sum(n) over (partition by user_id) as total, ((user_id + 2) % 2147483648) * 2654435761 % 4294967296 / 4294967296.0 as u from c),
      k as (select *, row_number() over (partition by user_id order by event_type) as rn from r where run > u * total)
    select user_id, event_type, cast(floor(((user_id * 17 + 6) % 2147483648) * 2654435761 % 4294967296 / 4294967296.0 * n) as bigint) as t from k where rn = 1""")
def weighted_start(t: Tables):
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    c = schedule.weighted_choice(c, ["user_id"], "event_type", "n", sampling.uniform(F.col("user_id"), 2))
    return c.select("user_id", "event_type", F.floor(sampling.uniform(F.col("user_id") * 17, 6) * F.col("n")).cast("long").alias("t"))


_STEPS = """o as (select o_custkey, o_orderpriority as p, lead(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as q from orders),
      c as (select p, q, count(*) as n from o where q is not null group by 1, 2), s as (select p, q, ln(n / cast(sum(n) over (partition by p) as double)) as l from c)"""


def transitions(t: Tables):
    """(token, next, logp): which priority follows which, over all customers."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    c = t.orders.select(F.col("o_orderpriority").alias("token"), F.lead("o_orderpriority").over(w).alias("next")).where("next is not null")
    c = c.groupBy("token", "next").agg(F.count("*").alias("n"))
    return c.select("token", "next", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("token"))).alias("logp"))


@query(f"""with {_STEPS}, r as (select *, row_number() over (partition by p order by l desc, q) as k from s), t as (select * from r where k <= 3),
      n as (select p, q, l - ln(sum(exp(l)) over (partition by p)) as l from t), x as (select *, sum(exp(l)) over (partition by p order by l desc, q rows between unbounded preceding and current row) - exp(l) as before from n),
      y as (select p, q, l - ln(sum(exp(l)) over (partition by p)) as l from x where before < 0.6)
    select p as token, q as "next", round(l, 6) as logp from y""")
def top_k_top_p_tokens(t: Tables):
    out = decoding.top_k_top_p(transitions(t), ["token"], "next", "logp", 3, 0.6)
    return out.select("token", "next", rounded("logp", 6).alias("logp"))


_MIX = lambda x, seed: f"(({x} + {seed}) % 2147483648) * 2654435761 % 4294967296"


@query(f"""with {_STEPS}, j as (select c_custkey, s.q, s.l, {_MIX("c_custkey * 13 + length(s.q) * 101 + ascii(s.q) * 7", 1)} as h0 from customer join s on s.p = case c_custkey % 2 when 0 then '1-URGENT' else '5-LOW' end),
      a as (select *, {_MIX("xor(h0, h0 >> 15)", 2)} as h1 from j), b as (select *, {_MIX("xor(h1, h1 >> 15)", 3)} / 4294967296.0::double as u from a),
      r as (select *, row_number() over (partition by c_custkey order by l - ln(-ln(greatest(u, 1e-12))) desc, q desc) as n from b)
    select c_custkey, q as "next" from r where n = 1""")
def gumbel_tokens(t: Tables):
    start = F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW")
    j = t.customer.select("c_custkey", start.alias("token")).join(F.broadcast(transitions(t)), "token")
    u = sampling.mixed(F.col("c_custkey") * 13 + F.length("next") * 101 + F.ascii("next") * 7, 1)
    return decoding.gumbel_pick(j, ["c_custkey"], "next", "logp", u)


@query(f"""with {_STEPS}, k as (select c_custkey, s.q, sum(exp(s.l)) over (partition by c_custkey order by s.q rows between unbounded preceding and current row) as run, ((c_custkey + 3) % 2147483648) * 2654435761 % 4294967296 / 4294967296.0 as u
      from customer join s on s.p = '1-URGENT') select c_custkey, min(q) as "next" from k where run > u group by c_custkey""")
def multinomial_tokens(t: Tables):
    j = t.customer.select("c_custkey").crossJoin(F.broadcast(transitions(t).where("token = '1-URGENT'")))
    return decoding.multinomial_pick(j, ["c_custkey"], "next", "logp", sampling.uniform(F.col("c_custkey"), 3))


def _beam_sql(score: str) -> str:
    """Three unrolled rounds of a search with four beams."""
    parts, before = [], "b0 as (select p as id, [p] as beam, 0.0::double as score from (select distinct p from s))"
    for k in range(3):
        parts.append(f"""g{k} as (select id, list_append(beam, s.q) as beam, b.score + {score} as score from b{k} b join s on s.p = b.beam[-1] where {score} is not null),
          b{k + 1} as (select id, beam, score from (select *, row_number() over (partition by id order by round(score, 9) desc, beam) as rn from g{k}) where rn <= 4)""")
    return f"with {_STEPS}, {before}, {', '.join(parts)} select id, beam, round(score, 6) as score from b3"


def _beams(t: Tables, *rules: decoding.Rule):
    steps = transitions(t)
    start = steps.select(F.col("token").alias("id"), "token").distinct()
    return decoding.beam_search(start, steps, 4, 3, rules).select("id", "beam", rounded("score", 6).alias("score"))


@query(_beam_sql("s.l"))
def beam_search(t: Tables):
    return _beams(t)


@query(_beam_sql("(case when list_contains(b.beam, s.q) then s.l * 1.5 else s.l end)"))
def beam_repetition_penalty(t: Tables):
    return _beams(t, decoding.repetition_penalty(1.5))


@query(_beam_sql("(s.l - 0.7 * len(list_filter(b.beam, lambda x: x = s.q)))"))
def beam_frequency_penalty(t: Tables):
    return _beams(t, decoding.frequency_penalty(0.7))


@query(_beam_sql("(case when len(b.beam) >= 2 and list_contains(list_transform(range(1, len(b.beam)), lambda i: concat(b.beam[i], '>', b.beam[i + 1])), concat(b.beam[-1], '>', s.q)) then null else s.l end)"))
def beam_no_repeats(t: Tables):
    return _beams(t, decoding.no_repeated_ngrams(2))


@query("""with u as (select user_id, min(epoch(ts)) as a, max(epoch(ts)) as b from events group by user_id), g as (select user_id, a + k * 43200.0 as at_s, k from u cross join (select unnest(range(400)) as k) where a + k * 43200.0 <= b),
      j as (select g.user_id, g.k, e.event_id, abs(epoch(e.ts) - g.at_s) as gap, row_number() over (partition by g.user_id, g.k order by abs(epoch(e.ts) - g.at_s), e.event_id) as rn from g join events e on e.user_id = g.user_id and abs(epoch(e.ts) - g.at_s) <= 21600)
    select g.user_id, g.k, j.event_id as near_event, round(j.gap, 3) as gap from g left join j on j.user_id = g.user_id and j.k = g.k and j.rn = 1""")
def fps_grid(t: Tables):
    """A grid of times at a fixed rate, and the nearest event to each."""
    s = t.events.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    ends = s.groupBy("user_id").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    grid = ends.select("user_id", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / 43200.0).cast("long"))).alias("k"))
    grid = grid.select("user_id", "k", (F.col("a") + F.col("k") * 43200.0).alias("s"), F.concat_ws("-", "user_id", "k").alias("key"))
    near = joins.nearest_join(grid, s.select("user_id", "s", "event_id"), ["user_id"], "s", "key", "event_id", 21600.0)
    return near.select("user_id", "k", F.col("near_event_id").alias("near_event"), rounded("gap", 3).alias("gap"))


@query("""select 'train' as split, doc_id from documents where doc_id % 5 <> 0 union all select 'test', doc_id from documents where doc_id % 5 = 0 union all select 'bench', item_id from benchmark""")
def union_splits(t: Tables):
    part = lambda df, name, key: df.select(F.lit(name).alias("split"), F.col(key).alias("doc_id"))
    return part(t.documents.where("doc_id % 5 <> 0"), "train", "doc_id").unionAll(part(t.documents.where("doc_id % 5 = 0"), "test", "doc_id")).unionAll(part(t.benchmark, "bench", "item_id"))


@query("""with x as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as ix, least(length(text) % 6 + 1, 6) as n from conversations),
      e as (select conv_id, ix, unnest(range(n)) as k from x), o as (select conv_id, ix, k from e)
    select conv_id, list(ix * 10 + k order by ix, k) as tokens, list(ix * 100000 + k order by ix, k) as segment_ids, list(k order by ix, k) as position_ids from o group by conv_id""")
def pack_arrays(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t.conversations.withColumn("ix", (F.row_number().over(w) - 1).cast("long"))
    n = F.least(F.length("text") % 6 + 1, F.lit(6))
    x = x.withColumn("tokens", F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda k: F.col("ix") * 10 + k))
    return packing.concatenated(x, ["conv_id"], "ix", "tokens")


@query("""with recursive x as (select conv_id, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
      c as (select *, sum(n) over (partition by conv_id order by k) as cum, sum(n) over (partition by conv_id) as total, count(*) over (partition by conv_id) as m from x),
      g as (select conv_id, r, case when r = 4 then any_value(m) else min(k) filter (cum >= total * r / 4.0 - 1e-9) end as ends from c cross join (select unnest(range(1, 5)) as r) group by 1, 2),
      n as (select conv_id, list(n order by r) as n from (select conv_id, r, ends - coalesce(lag(ends) over (partition by conv_id order by r), 0) as n from g) group by 1),
      s as (select conv_id, 1 as k, n from n union all
        select conv_id, k + 1, case when n[k] > 0 or donor is null then n else [n[i] + (i = k)::bigint - (i = donor)::bigint for i in range(1, 5)] end
        from (select *, case when k < 4 and n[k + 1] > 1 then k + 1 else coalesce([d for d in range(k - 1, 0, -1) if n[d] > 1][1], [d for d in range(k + 1, 5) if n[d] > 1][1]) end as donor from s where k <= 4)),
      e as (select conv_id, unnest(n) as n_items, unnest(range(4)) as rank from s where k = 5), f as (select *, sum(n_items) over (partition by conv_id order by rank) - n_items as first from e)
    select f.conv_id, rank, cast(first as bigint) as first, n_items, cast(coalesce(sum(x.n), 0) as bigint) as n_counted from f left join x on x.conv_id = f.conv_id and x.k > first and x.k <= first + n_items group by 1, 2, 3, 4""")
def balanced_split(t: Tables):
    """Turns of each conversation dealt to four ranks by their length; long turns leave ranks empty
    that then take a turn from their neighbours."""
    x = t.conversations.select("conv_id", "turn", F.char_length("text").alias("n"))
    return packing.balanced_split(x, ["conv_id"], "turn", "n", 4)


@query("""with x as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as p from events),
      c as (select user_id, event_type, count(*) as n from x group by 1, 2), o as (select *, coalesce(sum(n) over (partition by user_id order by event_type rows between unbounded preceding and 1 preceding), 0) as a from c)
    select x.event_id, cast(o.a + x.p as bigint) as point from x join o on x.user_id = o.user_id and x.event_type = o.event_type""")
def merge_groups(t: Tables):
    x = sequences.frame_index(t.events, ["user_id", "event_type"], ORDER, "p")
    return sequences.merged_on_points(x, ["user_id"], "event_type", "p", "point").select("event_id", "point")


@query("""select vec_id, f as frame, p as point, round(cast(embedding[f * 8 + p + 1] as double), 6) as v from embeddings cross join (select unnest([0, 2, 5]) as f) cross join (select unnest([1, 6]) as p)""")
def gather_grid(t: Tables):
    return sequences.gathered(t.embeddings, ["vec_id"], "embedding", 8, [0, 2, 5], [1, 6]).select("vec_id", "frame", "point", rounded(F.col("v").cast("double"), 6).alias("v"))


_CLIPS = """f as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events),
      a as (select user_id, frame, frame - row_number() over (partition by user_id order by frame) as g from f where value >= 10), c as (select user_id, min(frame) as t0, max(frame) as t1 from a group by user_id, g having count(*) >= 3)"""


@query(f"with {_CLIPS} select c.user_id, c.t0, f.frame - c.t0 as frame, f.event_id from c join f on f.user_id = c.user_id and f.frame between c.t0 and c.t1")
def clip_slices(t: Tables):
    f = sequences.frame_index(t.events, ["user_id"], ORDER)
    clips = sequences.islands(f, ["user_id"], "frame", F.col("value") >= 10, min_gap=1, min_length=3).select("user_id", F.col("begin").alias("t0"), F.col("end").alias("t1"))
    return joins.sliced(clips, f.select("user_id", "frame", "event_id"), ["user_id"], "t0", "t1", "frame").select("user_id", "t0", "frame", "event_id")


@query("""with x as (select conv_id, row_number() over (partition by conv_id order by turn) as ix, [length(text) % 5, -1, length(role)] as ids from conversations),
      o as (select *, cast(coalesce(sum(4) over (partition by conv_id order by ix rows between unbounded preceding and 1 preceding), 0) as bigint) as a from x)
    select conv_id, flatten(list(list_transform(ids, lambda i: case when i < 0 then -1 else i + a end) order by ix)) as ids from o group by conv_id""")
def token_offsets(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    ids = F.array((F.length("text") % 5).cast("long"), F.lit(-1).cast("long"), F.length("role").cast("long"))
    x = t.conversations.select("conv_id", F.row_number().over(w).cast("long").alias("ix"), ids.alias("ids"), F.lit(4).cast("long").alias("n"))
    return packing.offset_ids(x, ["conv_id"], "ix", "ids", "n")


@query("""with n as (select count(*) as n from supplier), p as (select i as position, i // n as epoch, ((i % n) * 7 + (i // n + 1) * 13) % n as row from n cross join (select unnest(range(1000)) as i))
    select position, epoch, row from p""")
def endless_examples(t: Tables):
    epoch, row = schedule.endless_place(F.col("id"), t.supplier.count(), 7, 13)
    return t.spark.range(1000).select(F.col("id").alias("position"), epoch.alias("epoch"), row.alias("row"))


@query("""select user_id as worker, max(event_id) as version, arg_max(event_type, event_id) as state from events group by user_id""")
def merged_states(t: Tables):
    return recovery.newest_states(t.events, "user_id", "event_id", "event_type").toDF("worker", "version", "state")


@query("""with s as (select user_id, max(event_id) filter (event_type = 'view') as seen from events group by user_id) select e.event_id from events e join s using (user_id) where e.event_id > coalesce(seen, -1)""")
def fast_forward(t: Tables):
    seen = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("seen"))
    return recovery.after_checkpoint(t.events, seen, "user_id", "event_id", "seen").select("event_id")


@query("""with m as (select max(o_orderdate) as now from orders) select o_orderkey from orders cross join m where o_orderdate <= now - interval 30 day and o_orderkey not in (select l_orderkey from lineitem)""")
def settled_files(t: Tables):
    """Orders as files with a change time, shipped ones as those in the done log."""
    now = t.orders.agg(F.max("o_orderdate").alias("now"))
    return recovery.settled(t.orders.crossJoin(F.broadcast(now)), "o_orderdate", F.col("now"), "30 days", t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey")


@query("""select * from (values ('count_langs', 1, 'ran'), ('count_sources', 1, 'ran'), ('count_langs', 2, 'skipped'), ('count_sources', 2, 'skipped')) as x(stage, run, outcome)""")
def stage_runner(t: Tables):
    from ..storage import scratch_dir
    import uuid

    folder = f"{scratch_dir(t.spark)}/stages-{uuid.uuid4().hex}"
    stages = {"count_langs": lambda: t.documents.groupBy("lang").count(), "count_sources": lambda: t.documents.groupBy("source").count()}
    rows = [(s, k, o) for k in (1, 2) for s, o in recovery.run_stages(t.spark, stages, folder)]
    return t.spark.createDataFrame(rows, "stage string, run int, outcome string")
