"""Queries on prompts, templates, frame rates, tilings and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import sampling
from .registry import Tables, query, rounded

_HASH = "({key} + {seed}) % 2147483648 * 2654435761 % 4294967296"


def joined_with_and(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


@query("""with i as (select doc_id, lang, list_filter([case when doc_id % 2 = 0 then 'depth' end, case when doc_id % 3 = 0 then 'pose' end, case when doc_id % 5 < 3 then 'points' end], lambda x: x is not null) as x from documents)
    select doc_id, 'Predict the motion in ' || lang || case len(x) when 0 then '' when 1 then ' given ' || x[1] when 2 then ' given ' || x[1] || ' and ' || x[2] else ' given ' || x[1] || ', ' || x[2] || ', and ' || x[3] end || '.' as prompt from i""")
def prompt_assembly(t: Tables):
    part = lambda ok, s: F.when(ok, F.lit(s))
    x = F.filter(F.array(part(F.col("doc_id") % 2 == 0, "depth"), part(F.col("doc_id") % 3 == 0, "pose"), part(F.col("doc_id") % 5 < 3, "points")), lambda s: s.isNotNull())
    given = F.when(F.size(x) > 0, F.concat(F.lit(" given "), joined_with_and(x))).otherwise("")
    return t.documents.select("doc_id", F.concat(F.lit("Predict the motion in "), "lang", given, F.lit(".")).alias("prompt"))


@query(f"""select conv_id, turn, ['{{}}', 'Q: {{}}', 'Please answer: {{}}'][{_HASH.format(key="conv_id * 31 + turn", seed=5)} % 3 + 1] as template from conversations""")
def template_choice(t: Tables):
    templates = F.array(*[F.lit(s) for s in ("{}", "Q: {}", "Please answer: {}")])
    h = sampling.key_hash(F.col("conv_id") * 31 + F.col("turn"), 5)
    return t.conversations.select("conv_id", "turn", F.element_at(templates, (h % 3 + 1).cast("int")).alias("template"))


@query("""with o as (select p_brand, list(distinct p_type order by p_type) as x from part group by p_brand)
    select p_brand, array_to_string(list_transform(x, lambda s, i: chr(cast(64 + i as int)) || '. ' || s), chr(10)) as options from o""")
def choice_options(t: Tables):
    o = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("x"))
    line = F.transform("x", lambda s, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), s))
    return o.select("p_brand", F.array_join(line, "\n").alias("options"))


@query("""select doc_id, case when n_chars < 800 then 'short' when n_chars < 3000 then 'medium' else 'long' end || '_' || case lang when 'en' then 'caption' when 'de' then 'beschreibung' else 'any' end || ' ' || cast(n_chars // 500 * 500 as bigint) as style from documents""")
def style_prefix(t: Tables):
    size = F.when(F.col("n_chars") < 800, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    kind = F.when(F.col("lang") == "en", "caption").when(F.col("lang") == "de", "beschreibung").otherwise("any")
    hint = (F.floor(F.col("n_chars") / 500) * 500).cast("long").cast("string")
    return t.documents.select("doc_id", F.concat(size, F.lit("_"), kind, F.lit(" "), hint).alias("style"))


@query("""select page_id, max(fps) as fps from pages cross join (values (1), (2), (4), (8)) as c(fps)
    where floor(len(html) / 24.0 * fps) <= 600 or fps = 1 group by page_id""")
def frame_rate(t: Tables):
    fps = F.explode(F.array(*[F.lit(v) for v in (1, 2, 4, 8)])).alias("fps")
    fits = (F.floor(F.length("html") / 24.0 * F.col("fps")) <= 600) | (F.col("fps") == 1)
    return t.pages.select("page_id", "html", fps).where(fits).groupBy("page_id").agg(F.max("fps").alias("fps"))


@query("""with c as (select a.i as r, b.i as c from range(1, 7) as a(i) cross join range(1, 7) as b(i) where a.i * b.i <= 8),
      s as (select p_partkey, r, c, least(1.0::double, least(c * 336.0::double / (200 + p_size * 40), r * 336.0::double / (150 + p_partkey % 900))) as scale, r * c as n from part cross join c),
      k as (select *, row_number() over (partition by p_partkey order by scale desc, n, r) as k from s)
    select p_partkey, r as tile_rows, c as tile_columns from k where k = 1""")
def tiling(t: Tables):
    cells = [(r, c) for r in range(1, 7) for c in range(1, 7) if r * c <= 8]
    options = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(c).cast("long").alias("c")) for r, c in cells])
    scale = lambda o: F.least(F.lit(1.0), o["c"] * 336.0 / (200 + F.col("p_size") * 40), o["r"] * 336.0 / (150 + F.col("p_partkey") % 900))
    best = F.array_max(F.transform(options, lambda o: F.struct(scale(o).alias("scale"), (-o["r"] * o["c"]).alias("few"), (-o["r"]).alias("flat"), o.alias("o"))))["o"]
    return t.part.select("p_partkey", best.alias("o")).select("p_partkey", F.col("o.r").alias("tile_rows"), F.col("o.c").alias("tile_columns"))


@query(f"""with c as (select s_nationkey, list(s_suppkey order by s_suppkey) as x from supplier group by s_nationkey)
    select s_nationkey, cast(slot as bigint) as slot, x[cast({_HASH.format(key="s_nationkey * 16 + slot", seed=9)} % len(x) as int) + 1] as camera from c cross join range(3) as s(slot)""")
def camera_slots(t: Tables):
    c = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("x"))
    c = c.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    at = (sampling.key_hash(F.col("s_nationkey") * 16 + F.col("slot"), 9) % F.size("x")).cast("int")
    return c.select("s_nationkey", "slot", F.get("x", at).alias("camera"))


@query(f"""with u as (select event_id, {_HASH.format(key="event_id", seed=3)} / 4294967296.0::double as u, value from events)
    select event_id, case when u < 0.3 then 'all' when u < 0.6 then 'none' else 'some' end as dropped, round(value * 255 / 1000, 6) as scaled from u""")
def depth_dropout(t: Tables):
    u = sampling.uniform(F.col("event_id"), 3)
    kind = F.when(u < 0.3, "all").when(u < 0.6, "none").otherwise("some")
    return t.events.select("event_id", kind.alias("dropped"), rounded(F.col("value") * 255 / 1000, 6).alias("scaled"))


@query("""with p as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as f, value from events),
      n as (select user_id, count(*) as n from events group by user_id), w as (select user_id, n, unnest([-2, 0, 7, 10000]) as t from n)
    select w.user_id, cast(w.t as bigint) as t, round(p.value, 6) as value from w join p on p.user_id = w.user_id and p.f = least(greatest(w.t, 0), n - 1)""")
def pose_clamp(t: Tables):
    from ..operators import sequences

    p = sequences.frame_index(t.events, ["user_id"], ["ts", "event_id"], "f").select("user_id", "f", "value")
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    w = n.withColumn("t", F.explode(F.array(*[F.lit(v).cast("long") for v in (-2, 0, 7, 10000)])))
    w = w.withColumn("f", F.least(F.greatest("t", F.lit(0)), F.col("n") - 1))
    return w.join(p, ["user_id", "f"]).select("user_id", "t", rounded("value", 6).alias("value"))


@query("""with m as (select user_id, max(ts) as last, count(*) filter (event_type = 'purchase') as c from events group by user_id)
    select user_id from m where c > 0 and last <= (select max(ts) from events) - interval '1 hour'""")
def checkpoint_ready(t: Tables):
    m = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    end = t.events.agg((F.max("ts") - F.expr("interval 1 hour")).alias("end"))
    return m.where("c > 0").join(F.broadcast(end), F.col("last") <= F.col("end")).select("user_id")


@query("""select o_custkey, step, row_number() over (partition by o_custkey order by step) as turn from (select o_custkey, try_cast(regexp_extract('step' || o_orderkey, 'step(\\d+)$', 1) as bigint) as step from orders) where step % 4 = 0""")
def poll_every(t: Tables):
    step = F.regexp_extract(F.concat(F.lit("step"), "o_orderkey"), "step(\\d+)$", 1).try_cast("long")
    s = t.orders.select("o_custkey", step.alias("step")).where("step % 4 = 0")
    return s.select("o_custkey", "step", F.row_number().over(Window.partitionBy("o_custkey").orderBy("step")).cast("long").alias("turn"))


@query("""with p as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as v from embeddings)
    select vec_id, cast(i // 8 // 2 as bigint) as patch_row, cast(i % 8 // 2 as bigint) as patch_column, round(sum(v), 5) as total from p group by all""")
def patch_sums(t: Tables):
    p = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    p = p.select("vec_id", F.floor(F.col("i") / 16).cast("long").alias("patch_row"), F.floor(F.col("i") % 8 / 2).cast("long").alias("patch_column"), F.col("v").cast("double").alias("v"))
    return p.groupBy("vec_id", "patch_row", "patch_column").agg(rounded(F.sum("v"), 5).alias("total"))


@query("""select conv_id, list(mark || ': ' || text order by turn) as numbered from (select conv_id, turn, text, case role when 'user' then 'Q' else 'A' end || row_number() over (partition by conv_id, role order by turn) as mark from conversations) group by conv_id""")
def numbered_messages(t: Tables):
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("string")
    mark = F.concat(F.when(F.col("role") == "user", "Q").otherwise("A"), n, F.lit(": "), F.col("text"))
    c = t.conversations.select("conv_id", "turn", mark.alias("s")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("x"))
    return c.select("conv_id", F.transform("x", lambda v: v["s"]).alias("numbered"))
