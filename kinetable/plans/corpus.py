"""Queries on manifests, mixtures, sampling, packing, joins and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, metrics, packing, sampling, sequences
from .registry import Tables, query


@query("select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size <= 10)")
def key_filter(t: Tables):
    keys = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return joins.keep_listed_keys(t.lineitem, keys, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("""select o_custkey, count(*) as n_clips, cast(sum(n) as bigint) as n_total from (select o_custkey, o_orderstatus, count(*) as n from orders where o_orderstatus in ('O', 'F') group by 1, 2) group by o_custkey""")
def key_intersection(t: Tables):
    c = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("clips"))
    c = c.withColumn("clips", F.map_filter("clips", lambda k, v: F.array_contains(F.array(F.lit("O"), F.lit("F")), k))).where(F.size("clips") > 0)
    return c.select("o_custkey", F.size("clips").cast("long").alias("n_clips"), F.aggregate(F.map_values("clips"), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_total"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def resume_anti(t: Tables):
    return joins.without_done(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("select d.doc_id, coalesce(l.quality, -1) as quality from documents d left join labels l using (doc_id)")
def caption_left(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""with e as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)
    select c_custkey, o_orderkey from customer join e on c_custkey = o_custkey and n = 1""")
def last_key_wins(t: Tables):
    e = joins.last_of_duplicates(t.orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))
    return t.customer.join(e, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("""select d.doc_id, case when a and b then 'both' when a then 'quality' when b then 'toxic' else 'none' end as bucket from
    (select doc_id, doc_id in (select doc_id from labels where quality = 1) as a, doc_id in (select doc_id from labels where toxic = 1) as b from documents) d""")
def seen_buckets(t: Tables):
    d = joins.member_flag(t.documents.select("doc_id"), t.labels.where("quality = 1"), ["doc_id"], "a")
    d = joins.member_flag(d, t.labels.where("toxic = 1"), ["doc_id"], "b")
    bucket = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "quality").when(F.col("b"), "toxic").otherwise("none")
    return d.select("doc_id", bucket.alias("bucket"))


@query("""with x as (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as turn from part)
    select p_partkey, p_brand, turn from x order by turn, p_brand limit 37""")
def round_robin_pick(t: Tables):
    return sampling.round_robin_pick(t.part, "p_brand", ["p_retailprice", "p_partkey"], 37).select("p_partkey", "p_brand", F.col("turn").cast("long").alias("turn"))


@query("""with x as (select *, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as n from orders)
    select o_orderkey, o_orderpriority from x where n <= case o_orderpriority when '1-URGENT' then 20 when '5-LOW' then 10 else 0 end""")
def bucket_plan(t: Tables):
    return sampling.bucket_plan(t.orders, "o_orderpriority", ["o_totalprice", "o_orderkey"], {"1-URGENT": 20, "5-LOW": 10}).select("o_orderkey", "o_orderpriority")


@query("""with x as (select *, dense_rank() over (partition by l_suppkey order by l_orderkey) as g from lineitem)
    select l_suppkey, l_orderkey, l_linenumber from x where g <= 3""")
def cap_groups(t: Tables):
    return sampling.first_groups(t.lineitem, "l_suppkey", "l_orderkey", 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""with g as (select label, list(vec_id order by vec_id) as ids from embeddings group by label), i as (select unnest(range(8)) as i)
    select label, cast(i as bigint) as i, case when len(ids) >= 8 then ids[cast(floor(i * len(ids) / cast(8 as double)) as int) + 1] else ids[i % len(ids) + 1] end as vec_id from g cross join i""")
def uniform_stride(t: Tables):
    return sampling.strided_rows(t.embeddings, "label", "vec_id", 8)


@query("""with x as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as r, count(*) over (partition by label) as n from embeddings)
    select label, vec_id, r // 8 as chunk from x where r // 8 < n // 8""")
def chunk_points(t: Tables):
    return sampling.full_chunks(t.embeddings, "label", "vec_id", 8).select("label", "vec_id", "chunk")


@query("""with c as (select source, count(*) as n_rows from documents group by source) select source, n_rows, round(sqrt(n_rows) / sum(sqrt(n_rows)) over (), 9) as weight from c""")
def mixture_sqrt(t: Tables):
    return sampling.sqrt_mixture(t.documents, "source").withColumn("weight", F.round("weight", 9))


@query("""with c as (select lang, source, count(*) as n_rows from documents group by 1, 2),
      r as (select *, case lang when 'en' then 2.0::double when 'de' then 0.5::double else 1.0::double end * sqrt(n_rows) / sum(sqrt(n_rows)) over (partition by lang) as raw from c)
    select lang, source, n_rows, round(raw / sum(raw) over (), 9) as rate from r""")
def mixture_nested(t: Tables):
    return sampling.nested_mixture(t.documents, "lang", "source", {"en": 2.0, "de": 0.5}).withColumn("rate", F.round("rate", 9))


@query("select doc_id, (row_number() over (partition by source order by doc_id) - 1) % 4 as shard from documents")
def shard_modulo(t: Tables):
    return sampling.shard(t.documents, ["doc_id"], 4, ["source"]).select("doc_id", "shard")


@query("select s_suppkey, case when (s_suppkey % 2147483648) * 2654435761 % 4294967296 < 429496729 then 'val' else 'train' end as part from supplier")
def hash_split(t: Tables):
    return t.supplier.select("s_suppkey", sampling.split(F.col("s_suppkey"), 0.1).alias("part"))


@query("""with x as (select c_custkey, row_number() over (partition by c_mktsegment order by ((c_custkey + 7) % 2147483648) * 2654435761 % 4294967296, c_custkey) as n from customer)
    select c_custkey from x where n <= 10""")
def sample_without_replacement(t: Tables):
    w = Window.partitionBy("c_mktsegment").orderBy(sampling.key_hash(F.col("c_custkey"), 7), "c_custkey")
    return t.customer.withColumn("n", F.row_number().over(w)).where("n <= 10").select("c_custkey")


@query("select doc_id, cast(coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as at from documents")
def offset_prefix(t: Tables):
    return sequences.prefix_offset(t.documents, ["source"], ["doc_id"], "n_chars", "at").select("doc_id", "at")


@query("""with p as (select c_nationkey, c_custkey, greatest(c_acctbal, 0) as w from customer),
      r as (select *, sum(w) over (partition by c_nationkey order by c_custkey) as run, sum(w) over (partition by c_nationkey) as a from p)
    select c_nationkey, min(c_custkey) as c_custkey from r where run >= 0.37 * a group by c_nationkey""")
def cdf_pick(t: Tables):
    c = t.customer.withColumn("w", F.greatest("c_acctbal", F.lit(0.0)))
    return sampling.cdf_pick(c, "c_nationkey", "c_custkey", "w", 0.37).select("c_nationkey", "c_custkey")


@query("""with c as (select source, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as p from documents group by source),
      r as (select *, sum(p) over (order by p desc, source rows between unbounded preceding and current row) as s from c)
    select source, n from r where s - p < 0.9""")
def top_p(t: Tables):
    c = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return sampling.top_p(c, 0.9, "p", "source").select("source", "n")


@query("""select vec_id, list_concat(list_transform(embedding, lambda x: cast(x as double)), list_transform(range(16), lambda i: cast(-1 as double))) as padded,
    list_transform(embedding[1:16], lambda x: cast(x as double)) as cut from embeddings""")
def pad_collate(t: Tables):
    """Whole vectors, filled up to 80 items and cut to 16."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return t.embeddings.select("vec_id", packing.pad(x, 80, -1.0).alias("padded"), packing.pad(x, 16, -1.0).alias("cut"))




@query("""with x as (select doc_id, source, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as a from documents)
    select doc_id, cast(a // 8192 as bigint) as bin, cast(a % 8192 as bigint) as "offset", row_number() over (partition by source, a // 8192 order by doc_id) - 1 as position from x""")
def pack_segments(t: Tables):
    return packing.segments(t.documents, ["source"], ["doc_id"], "n_chars", 8192).select("doc_id", "bin", "offset", "position")


@query("select doc_id, least(cast(floor(n_chars % 64 * 8 / 64.0) as bigint), 7 - cast(floor(n_chars % 64 * 8 / 64.0) as bigint)) as rank from documents")
def zigzag_shard(t: Tables):
    return t.documents.select("doc_id", packing.zigzag_chunk(F.col("n_chars") % 64, 64, 4).alias("rank"))


@query("""with n as (select o_custkey, case o_orderkey % 3 when 0 then 'run/step' || cast(o_orderkey as varchar) when 1 then 'run/step' || cast(o_orderkey - 1 as varchar) || '-unsharded' else 'run/latest' end as path, case o_orderkey % 3 when 1 then o_orderkey - 1 when 0 then o_orderkey end as step, o_orderkey % 3 = 1 as whole from orders)
    select o_custkey, arg_max(path, struct_pack(s := step, w := not whole)) as sharded, arg_max(path, struct_pack(s := step, w := whole)) as unsharded, max(step) as step from n where step is not null group by 1""")
def selected_checkpoint(t: Tables):
    """Of folders' names the one of the latest step; of equal steps the kind that is preferred."""
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("run/step"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("run/step"), (k - 1).cast("string"), F.lit("-unsharded"))).otherwise("run/latest")
    step, whole = text.checkpoint_name(F.col("path"))
    n = t.orders.select("o_custkey", path.alias("path")).withColumns({"step": step, "whole": whole}).where("step is not null")
    best = lambda w: F.max_by("path", F.struct("step", w.alias("w")))
    return n.groupBy("o_custkey").agg(best(~F.col("whole")).alias("sharded"), best(F.col("whole")).alias("unsharded"), F.max("step").alias("step"))


@query("select o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as latest from orders group by o_custkey")
def latest_step(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("""select lang, source, n_rows from (select lang, source, count(*) as n_rows, rank() over (partition by lang order by count(*) desc) as r from documents group by 1, 2) where r = 1""")
def counts_extreme(t: Tables):
    return metrics.extremes(t.documents, "lang", "source")


@query("""select lang, source, n_rows from (select lang, source, count(*) as n_rows, rank() over (partition by lang order by count(*)) as r from documents group by 1, 2) where r = 1""")
def counts_least(t: Tables):
    return metrics.extremes(t.documents, "lang", "source", least=True)


@query("""with c as (select source, lang, count(*) as n from documents group by 1, 2), k as (select *, max(n) over (partition by source) as top from c)
    select source, lang, n from k where n >= 10 or (top < 10)""")
def threshold_with_fallback(t: Tables):
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.withColumn("top", F.max("n").over(Window.partitionBy("source"))).where("n >= 10 or top < 10").select("source", "lang", "n")


@query("""with c as (select conv_id, role, count(*) as n from conversations group by 1, 2), m as (select conv_id, list(role order by role) as ties from c where n = (select max(n) from c as o where o.conv_id = c.conv_id) group by 1),
      a as (select conv_id, min(role) as least_role from c group by 1)
    select conv_id, ties[cast(floor(((conv_id + 5) % 2147483648) * 2654435761 % 4294967296 / 4294967296.0 * len(ties)) as bigint) + 1] as role, least_role from m join a using (conv_id)""")
def mode_answer(t: Tables):
    """The most frequent answer, drawn from those that are as frequent, and the first by name."""
    c = metrics.extremes(t.conversations, "conv_id", "role").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("ties"))
    nth = F.floor(sampling.uniform(F.col("conv_id"), 5) * F.size("ties")).cast("int")
    least = t.conversations.groupBy("conv_id").agg(F.min("role").alias("least_role"))
    return c.join(least, "conv_id").select("conv_id", F.get("ties", nth).alias("role"), "least_role")


@query("""select o_orderkey, least(cast(5 as bigint), coalesce(count(l_linenumber), 0)) as valid_length from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def valid_length(t: Tables):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.least(F.lit(5).cast("long"), F.coalesce("n", F.lit(0))).alias("valid_length"))


@query("select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as mean_price from lineitem group by l_returnflag")
def weighted_mean(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(metrics.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("mean_price"))


@query("""with c as (select count(*) filter (quality = 1 and toxic = 1) as hit, count(*) filter (quality = 1) as n_said, count(*) filter (toxic = 1) as n_true from labels),
      r as (select *, case when n_said > 0 then hit / cast(n_said as double) else cast(n_true = 0 as double) end as p, case when n_true > 0 then hit / cast(n_true as double) else cast(n_said = 0 as double) end as r from c)
    select hit, n_said, n_true, round(p, 9) as "precision", round(r, 9) as recall, round(2 * p * r / (p + r + 1e-10), 9) as f1 from r""")
def prf1(t: Tables):
    r = metrics.precision_recall(t.labels, F.col("quality") == 1, F.col("toxic") == 1)
    return r.select("hit", "n_said", "n_true", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("select l_suppkey, count(*) as n_rows, count(*) filter (l_returnflag = 'R') as n_failed, round(count(*) filter (l_returnflag = 'R') / greatest(cast(count(*) as double), 1), 9) as failure_rate from lineitem group by l_suppkey")
def parse_counters(t: Tables):
    failed = F.count_if(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), failed.alias("n_failed"), F.round(failed / F.greatest(F.count("*").cast("double"), F.lit(1.0)), 9).alias("failure_rate"))


@query("select s_nationkey, list_sort(list(distinct s_suppkey % 10)) as uids, count(distinct s_suppkey % 10) as n from supplier group by s_nationkey")
def distinct_sets(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_set(F.col("s_suppkey") % 10)).alias("uids"), F.count_distinct(F.col("s_suppkey") % 10).alias("n"))


@query("select doc_id from documents where n_chars < 500 union select doc_id from labels where quality = 1")
def union_ids(t: Tables):
    return t.documents.where("n_chars < 500").select("doc_id").union(t.labels.where("quality = 1").select("doc_id")).distinct()


@query("select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 1")
def intersect_ids(t: Tables):
    return t.documents.where("lang = 'en'").select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("select doc_id from documents where lang = 'en' except select doc_id from labels")
def except_ids(t: Tables):
    return t.documents.where("lang = 'en'").select("doc_id").exceptAll(t.labels.select("doc_id")).distinct()


@query("select source, ntile(4) over (partition by lang order by doc_id) as part, doc_id from documents")
def equal_groups(t: Tables):
    return sampling.equal_parts(t.documents.select("source", "lang", "doc_id"), "lang", "doc_id", 4, "part").select("source", "part", "doc_id")


@query("select c_custkey from customer where not (c_acctbal < 0) and c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def success_gate(t: Tables):
    ok = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("ok"))
    return t.customer.join(ok, "c_nationkey", "left").where(F.coalesce("ok", F.lit(False)) & (F.col("c_acctbal") >= 0)).select("c_custkey")


@query("select conv_id, string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>'), chr(10) order by turn) as chat from conversations group by conv_id")
def chat_format(t: Tables):
    return text.chat_text(t.conversations, "conv_id", "turn", "role", "text")


@query("select p_partkey, lower(split_part(p_name, ' ', 1)) as category, split_part(p_name, ' ', 2) as uuid, split_part(p_type, ' ', -1) as receptacle from part")
def name_split(t: Tables):
    part = lambda c, i: F.split_part(F.col(c), F.lit(" "), F.lit(i))
    return t.part.select("p_partkey", F.lower(part("p_name", 1)).alias("category"), part("p_name", 2).alias("uuid"), part("p_type", -1).alias("receptacle"))


@query("""select doc_id, list_filter(list_transform(string_split(text, '|'), lambda s: trim(s, ' ')), lambda s: s <> '') as objects from documents""")
def object_list(t: Tables):
    return t.documents.select("doc_id", text.object_list(F.col("text")).alias("objects"))




@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""with s as (select event_id, cast(event_id * 37 % 864000 as bigint) as h from events)
    select event_id, printf('%02d:%02d:%02d.%02d', h // 360000, h // 6000 % 60, h // 100 % 60, h % 100) as shown, cast(h / cast(100 as double) as double) as seconds from s""")
def timestamp_round_trip(t: Tables):
    s = t.events.select("event_id", ((F.col("event_id") * 37 % 864000) / 100.0).alias("s"))
    s = s.withColumn("shown", text.format_time(F.col("s")))
    return s.select("event_id", "shown", F.round(text.parse_time(F.col("shown")), 2).alias("seconds"))


@query("select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as links, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as shown from pages")
def html_points(t: Tables):
    return t.pages.select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("links"), text.escape_html(F.col("url")).alias("shown"))


@query("""select doc_id, coalesce(nullif(trim(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then ' ' || lang else lang end), ''),
    array_to_string(string_split('a_' || source || '_' || lang || '_z', '_')[2:3], ' ')) as caption from documents""")
def caption_fallback(t: Tables):
    given = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), F.col("lang"))).otherwise(F.col("lang"))
    stem = F.concat_ws("_", F.lit("a"), "source", "lang", F.lit("z"))
    return t.documents.select("doc_id", text.caption(given, stem).alias("caption"))


#: Questions and whether they ask to count things.
QUESTIONS = (
    ("How many dogs are there?", True), ("how many years is it?", False), ("Please count the cars", True), ("do not count all of them", False), ("Approximately how many dogs", False), ("there are ___ birds", True),
    ("what is the number of chairs", True), ("what is the total amount of money", False), ("How many kilometers", False), ("so,\nhow many cups?", True), ("a discount on the cars", False), ("What's the exact count of the rest", False),
)


@query(f"""select conv_id, turn, [{", ".join(str(v).lower() for _, v in QUESTIONS)}][(conv_id + turn) % {len(QUESTIONS)} + 1] as counting from conversations""")
def counting_question(t: Tables):
    """Questions of all kinds before the texts of conversations."""
    asked = F.array(*[F.lit(q) for q, _ in QUESTIONS])
    q = F.element_at(asked, ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", text.counting_question(F.concat(q, F.lit(" "), F.coalesce("text", F.lit("")))).alias("counting"))


@query("select conv_id, list(cast(role = 'assistant' as int) order by turn) as mask from conversations group by conv_id")
def loss_mask(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", text.loss_mask(F.transform("x", lambda v: v["role"])).alias("mask"))


@query("select doc_id, sha256(text) as digest, concat_ws('/', lang, source, doc_id) as example_id from documents")
def example_hash(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("example_id"))


@query("""select n_nationkey, n_name, r_name, 'nation' as origin from nation join region on n_regionkey = r_regionkey""")
def tag_source(t: Tables):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.lit("nation").alias("origin"))


@query("""select p_brand, round(avg(case when p_size > 25 then 1.0 else 0.0 end), 6) as share_cut, count(distinct p_type) filter (p_size > 0) as n_segments from part group by p_brand""")
def batch_statistics(t: Tables):
    return t.part.groupBy("p_brand").agg(F.round(F.avg((F.col("p_size") > 25).cast("double")), 6).alias("share_cut"), F.count_distinct(F.when(F.col("p_size") > 0, F.col("p_type"))).alias("n_segments"))


@query("""select nation, case when o_orderdate < timestamp '1996-01-01' then 'early' else 'late' end as half, count(*) as n from orders join customer on o_custkey = c_custkey
    join (select n_nationkey, n_name as nation from nation) on c_nationkey = n_nationkey group by all having count(*) >= 3""")
def group_size_floor(t: Tables):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    half = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "early").otherwise("late")
    return o.groupBy(F.col("n_name").alias("nation"), half.alias("half")).agg(F.count("*").alias("n")).where("n >= 3")
