"""SQL for queries whose steps are longer than the queries themselves. SQL has no CRC-32, so it is
made from its polynomial: a table of 256 remainders, then a step a byte, or, for very many
features, the sum of what each byte at its distance from the end gives."""

from __future__ import annotations

#: The remainder of each byte.
_CRC = """b8 as (select i, i::bigint as c, 0 as k from (select unnest(range(256)) as i) union all
      select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from b8 where k < 8),
    tb as materialized (select i, c from b8 where k = 8)"""

#: Conversations one by one, prefixes as lists of turns.
HEAVY_PATHS = f"""
    with recursive {_CRC},
    cr as (select distinct conv_id as conv, cast(conv_id as varchar) as s, 0 as k, 4294967295::bigint as c from conversations where conv_id is not null union all
      select conv, s, k + 1, xor(cr.c >> 8, tb.c) from cr join tb on tb.i = (xor(cr.c, ascii(s[k + 1])) & 255) where k < length(s)),
    h as (select conv, xor(c, 4294967295) % 4 as h from cr where k = length(s)),
    t as (select conv_id as conv, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as p from conversations where conv_id is not null),
    n as (select conv, count(*) as n from t group by 1),
    r as (select h.conv, t.p as d, t.role, t.text from h join t on t.conv = h.conv - h.conv % 20 and t.p <= h.h union all
      select h.conv, t.p - h.h + least(h.h, coalesce(n.n, 0)), t.role, t.text from h join t on t.conv = h.conv and t.p > h.h left join n on n.conv = h.conv - h.conv % 20),
    f as (select h.conv, coalesce(list({{'r': r.role, 't': r.text}} order by r.d) filter (r.d is not null), []) as turns from h left join r on r.conv = h.conv group by 1),
    m as materialized (select conv, d, len(turns) = d as last, min(conv) over (partition by d, turns[:d]) as node, count(*) over (partition by d, turns[:d]) as n, case when d > 0 then len(regexp_extract_all(turns[d].t, '[^\\x20\\x09-\\x0D]+')) else 0 end as words
      from (select conv, turns, unnest(range(len(turns) + 1)) as d from f)),
    v as (select a.node as conv_id, a.d as depth, b.node as parent_conv_id, a.n, a.words from m a left join m b on b.conv = a.conv and b.d = a.d - 1 where a.conv = a.node),
    k as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from v where depth > 0 group by 1, 2),
    u as (select distinct a.node as conv_id, a.d as depth, b.node as below, b.d as below_depth from m a join m b on b.conv = a.conv and b.d >= a.d),
    s as (select u.conv_id, u.depth, count(*) filter (k.n_children is null) as n_leaves, sum((v.n - 1) * v.words) as saved from u join v on v.conv_id = below and v.depth = below_depth left join k on k.conv_id = below and k.depth = below_depth group by 1, 2),
    e as (select node as conv_id, d as depth, sha256(string_agg(cast(conv as varchar), ',' order by conv)) as ends from m where last group by 1, 2)
    select v.conv_id, v.depth, v.parent_conv_id, v.n as n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
    from v join s using (conv_id, depth) left join k using (conv_id, depth) left join e using (conv_id, depth)"""

#: Distinct runs of words, the bytes of each, and their remainders.
POSITION_NGRAMS = f"""
    with recursive {_CRC},
    d as (select row_number() over () as row, doc_id, text from documents),
    w as (select row, unnest(ws) as w, unnest(range(len(ws))) as p from (select row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from (select row, text from d union all select -item_id - 1, text from benchmark))),
    l as (select row, w, lead(w) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by row order by p)),
    f as materialized (select row, w as f from l union all select row, w || ' ' || w2 from l where w2 is not null union all select row, w || ' ' || w2 || ' ' || w3 from l where w3 is not null),
    x as materialized (select f, hex(encode(f)) as x from (select distinct f from f)),
    z as (select 0 as n, 4294967295::bigint as c union all select n + 1, xor(z.c >> 8, tb.c) from z join tb on tb.i = (z.c & 255) where n < (select max(length(x)) // 2 from x)),
    e as (select 0 as n, upper(printf('%02x', i)) as b, c from tb union all select n + 1, b, xor(e.c >> 8, tb.c) from e join tb on tb.i = (e.c & 255) where n < (select max(length(x)) // 2 from x)),
    y as (select f, length(x) // 2 as n, unnest(range(length(x) // 2)) as i, x from x),
    q as (select y.f, any_value(y.n) as n, bit_xor(e.c) as c from y join e on e.n = y.n - 1 - i and e.b = x[2 * i + 1:2 * i + 2] group by 1),
    b as materialized (select q.f, cast(xor(xor(q.c, z.c), 4294967295) % 10000 as bigint) as b from q join z using (n)),
    g as materialized (select f.row, b.b from f join b using (f)),
    s as (select b, count(*) filter (row > 0) as s, count(*) filter (row < 0) as t from g group by 1), a as (select sum(s) as s, sum(t) as t from s),
    gain as (select s.b, cast(floor(1000 * ln((s.t + 1)::double * (a.s + 10000)::double / ((s.s + 1)::double * (a.t + 10000)::double))) as bigint) as gain from s cross join a),
    m as (select row, count(*) as n, sum(gain) as weight from g join gain using (b) where row > 0 group by 1), k as (select row, count(*) as words from w group by 1),
    o as (select d.row, doc_id, coalesce(m.n, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight, coalesce(words, 0) as words, ('0x' || sha256('42:' || cast(doc_id as varchar))[1:8])::bigint as h from d left join m using (row) left join k using (row)),
    c as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double))) as bigint) as score from o),
    p as (select *, words >= 20 and score is not null as may, row_number() over (partition by words >= 20 and score is not null order by score desc, doc_id, row) as place, count(*) filter (words >= 20 and score is not null) over () as among from c)
    select doc_id, n_features, weight, score, case when may and place <= 5 * among // 100 then place end as rank from p"""
