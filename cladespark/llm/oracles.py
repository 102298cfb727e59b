"""DuckDB SQL that computes what the queries of the subpackage return."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op3_stupid_backoff": f"""
with w as (select doc_id, unnest(x) as w, generate_subscripts(x, 1) as i from (select doc_id, {_WORDS} as x from documents)),
c as (select w, count(*) as n from w group by w),
total as (select count(*) as n from w),
known as (select w.doc_id, w.i, case when c.n * 1000000 >= (select n from total) then 'w' || w.w else 'u' end as w from w join c using (w)),
uni as (select w, count(*) as n from known group by w),
pairs as (select doc_id, i, w as b, lag(w) over (partition by doc_id order by i) as a from known),
bi as (select a, b, count(*) as n from pairs where a is not null group by a, b),
scored as (
  select p.doc_id, case when bi.n >= 2 then 1 else 0 end as seen,
    case when bi.n >= 2 then ln(bi.n) - ln(ua.n)
         when p.a is not null then ln(0.4) + ln(ub.n) - ln((select n from total))
         else ln(ub.n) - ln((select n from total)) end as s
  from pairs p join uni ub on p.b = ub.w left join uni ua on p.a = ua.w left join bi on p.a = bi.a and p.b = bi.b)
select d.doc_id, count(s)::bigint as n_words, coalesce(sum(seen), 0)::bigint as n_seen, round(case when count(s) > 0 then sum(s) / count(s) else 0.0 end, 4) as score
from documents d left join scored using (doc_id) group by d.doc_id
""",
    "op5_pareto_mix": r"""
with slim as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '~') || '|' || md5(coalesce(text, ''))), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from documents),
sizes as (select source, sum(size)::bigint as source_size, count(*) as n from slim group by source),
weighed as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from sizes),
lim as (select *, source_size * 2.0::double as lim, source_size * 2.0::double / w as ratio from weighed),
lev as (select *, ((select sum(source_size) from sizes) * 1.5::double - coalesce(sum(lim) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
  / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as level from lim),
goal as (select *, least(lim, coalesce(w * (select level from lev l2 where l2.ratio > l2.level order by ratio, source nulls last limit 1), lim)) as target from lev),
figures as (select source, source_size, target, n, case when source_size > 0 then target / source_size else 0.0 end as r from goal),
figs as (select *, floor(r)::bigint as whole, r - floor(r) as f, source_size::double / n as mean, 0.5 * least(r - floor(r), 1 - (r - floor(r))) as tilt from figures),
rows0 as (select s.*, g.source_size, g.target, g.whole, g.f, g.tilt, case when s.size + g.mean > 0 then s.size / (s.size + g.mean) else 0.0 end as v
  from slim s join figs g on s.source is not distinct from g.source),
centred as (select *, sum(size * v) over (partition by source) / greatest(sum(size) over (partition by source), 1) as centre from rows0),
p as (select *, f + tilt * (v - centre) as p from centred),
q as (select *, case when p > 0 then ((u / (1 - u)) * ((1 - p) / p)) / (1 + (u / (1 - u)) * ((1 - p) / p)) else u end as q from p),
ranked as (select *, coalesce(sum(size) over (partition by source order by q, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before, target - whole * source_size as wanted from q)
select doc_id, size, source_size, target, ((whole + case when wanted > 0 and before + size / 2.0 <= wanted then 1 else 0 end) * size)::bigint as taken, source,
  (whole + case when wanted > 0 and before + size / 2.0 <= wanted then 1 else 0 end)::int as copies
from ranked
""",
}
