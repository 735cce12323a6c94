"""Queries on regions of pictures: masks of polygons as compressed runs, patches between text tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks
from ..operators import interleave
from .registry import Tables, query

#: Corners of two polygons a supplier, three and four of them, by its key; pictures of 60 times 80 pixels.
_CORNERS = [[(3.2, 17, 0.9), (2.1, 13, 1.3), (60.3, 11, -1.7), (9.4, 7, 2.2), (20.7, 19, 1.1), (55.6, 5, -2.3)], [(10.15, 23, 1.6), (5.35, 9, 0.7), (70.45, 8, -0.9), (12.85, 12, 1.9), (44.25, 15, 1.2), (50.95, 6, -1.4), (25.05, 10, 1.5), (58.15, 4, 0.3)]]
_XY = [[f"({a}::double + s_suppkey % {m} * {f}::double)" for a, m, f in part] for part in _CORNERS]
_EDGES = " union all ".join(f"select s_suppkey as k, {i} as part, {p[2 * e]} as x1, {p[2 * e + 1]} as y1, {p[(2 * e + 2) % len(p)]} as x2, {p[(2 * e + 3) % len(p)]} as y2 from supplier" for i, p in enumerate(_XY) for e in range(len(p) // 2))


@query(f"""with g as (select {_EDGES[7:]}), px as (select unnest(range(60)) as i), pj as (select unnest(range(80)) as j),
      c as (select k, part, i, j, count(*) % 2 as odd from g cross join px cross join pj where (y1 > i + 0.5) <> (y2 > i + 0.5) and j + 0.5 < x1 + (i + 0.5 - y1) * (x2 - x1) / (y2 - y1) group by all),
      m as (select s_suppkey as k, pj.j * 60 + px.i as at_, coalesce(max(odd), 0) as v from supplier cross join px cross join pj left join c on c.k = s_suppkey and c.i = px.i and c.j = pj.j group by all),
      e as (select *, v <> coalesce(lag(v) over (partition by k order by at_), 0) as new from m), r as (select k, cast(sum(new::int) over (partition by k order by at_) as bigint) as nth, v from e),
      n as (select k, nth, count(*) as n from r group by 1, 2), z as (select k, unnest(range(max(nth) + 1)) as nth from r group by 1), f as (select z.k, z.nth, coalesce(n.n, 0) as n from z left join n using (k, nth)),
      d as (select k, nth, n - case when nth > 2 then lag(n, 2) over (partition by k order by nth) else 0 end as x from f),
      w as (select k, nth, x, case when x between -16 and 15 then 1 when x between -512 and 511 then 2 else 3 end as groups from d),
      t as (select k, nth, q, chr(cast(48 + ((x >> (5 * q)) & 31) + case when q < groups - 1 then 32 else 0 end as int)) as s from (select *, unnest(range(groups)) as q from w)),
      s as (select k, string_agg(s, '' order by nth, q) as code from t group by 1)
    select f.k as s_suppkey, list(n order by nth) as counts, any_value(code) as code, cast(coalesce(sum(n) filter (nth % 2 = 1), 0) as bigint) as area from f join s using (k) group by 1""")
def polygon_unions(t: Tables):
    """The union of two polygons as runs of pixels, as compressed text, and its area."""
    value = lambda a, m, f: F.lit(a) + F.col("s_suppkey") % m * F.lit(f)
    parts = F.array(*[F.array(*[value(*c) for c in part]) for part in _CORNERS])
    return masks.polygon_runs(t.supplier.select("s_suppkey", parts.alias("parts"), F.lit(60).alias("h"), F.lit(80).alias("w")), "s_suppkey", "parts", "h", "w")


@query("""select p_partkey, [cast(p_size as bigint), 3, 2, 40 * p_size, p_partkey % 7, 1000000, 33] as counts, cast(3 + 40 * p_size + 1000000 as bigint) as area from part""")
def expanded_masks(t: Tables):
    """Run lengths through their compressed text and back."""
    counts = F.array(F.col("p_size").cast("long"), F.lit(3), F.lit(2), F.col("p_size") * 40, F.col("p_partkey") % 7, F.lit(1000000), F.lit(33)).cast("array<long>")
    code = F.pandas_udf(lambda s: s.map(masks.compress), "string")
    return masks.expanded(t.part.select("p_partkey", code(counts).alias("code")), "p_partkey", "code")


@query("""with x as (select conv_id, turn, role, 1 + conv_id % 4 as h, 2 + turn % 3 as w, [length(s) for s in string_split(text, ' ')] as ids from conversations),
      y as (select *, (h + 1) // 2 as rows, (w + 1) // 2 as columns, coalesce(sum(case when role = 'user' then h * w end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from x),
      z as (select conv_id, turn, case when role = 'user' then list_concat([-2], flatten([list_concat([-3 for c in range(columns)], [-4]) for r in range(rows)]), [-5], ids) else list_append(ids, 0) end as ids, role,
        case when role = 'user' then [[case when (k // columns) * 2 + q // 2 - (2 * rows - h) // 2 between 0 and h - 1 and (k % columns) * 2 + q % 2 - (2 * columns - w) // 2 between 0 and w - 1
          then before + ((k // columns) * 2 + q // 2 - (2 * rows - h) // 2) * w + (k % columns) * 2 + q % 2 - (2 * columns - w) // 2 else -1 end for q in range(4)] for k in range(rows * columns)] else [] end as pooled from y),
      f as (select conv_id, flatten(list(ids order by turn)) as ids, flatten(list([(role <> 'user')::int for i in ids] order by turn)) as mask, flatten(list(pooled order by turn)) as pooled from z group by conv_id)
    select conv_id, cast(ids[:len(ids) - 1] as bigint[]) as input_tokens, cast(ids[2:] as bigint[]) as target_tokens, cast(mask[2:] as bigint[]) as loss_masks, range(len(ids) - 1) as position_ids, cast(pooled as bigint[][]) as pooled from f""")
def interleaved_patches(t: Tables):
    """A picture before each user turn, in the place of its mark: tokens, targets, losses and the
    patches that each picture token pools, counted on over the pictures of a conversation."""
    user = F.col("role") == "user"
    ids = F.transform(F.split("text", " "), lambda s: F.length(s).cast("long"))
    x = t.conversations.select("conv_id", "turn", F.when(user, F.concat(F.array(F.lit(-1).cast("long")), ids)).otherwise(F.concat(ids, F.array(F.lit(0).cast("long")))).alias("ids"), user.alias("user"), F.struct((1 + F.col("conv_id") % 4).alias("h"), (2 + F.col("turn") % 3).alias("w")).alias("grid"))
    x = x.withColumn("loss", F.transform("ids", lambda i: F.when(F.col("user"), 0).otherwise(1).cast("long")))
    x = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ids", "loss", "user", "grid"))).alias("v"))
    flat = lambda c: F.flatten(F.transform("v", lambda r: r[c])).alias(c)
    x = x.select("conv_id", flat("ids"), flat("loss"), F.transform(F.filter("v", lambda r: r["user"]), lambda r: r["grid"]).alias("grids"))
    return interleave.interleaved(x, "conv_id", "ids", "loss", "grids")
