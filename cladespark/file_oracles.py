"""DuckDB SQL for the queries of parsers, writers and small operators."""

from __future__ import annotations

#: Keys of a file.
FILE = 40

_PARTS = f"p as (select *, p_partkey // {FILE} as file, 'P' || lpad(p_partkey::varchar, 12, '0') as taxon, p_partkey % {FILE} + 1 as place, count(*) over (partition by p_partkey // {FILE}) as n, row_number() over (partition by p_partkey // {FILE} order by p_partkey) as k from part)"
_SITES = "translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACG')"
_HEAP = "select file, 'n' || (place // 2) as parent, 'n' || place as child from p where place > 1"
_DEPTH = "case when n = 1 then 0 when k <= 2 then n - 1 else n - k + 1 end"

FILE_ORACLES: dict[str, str] = {
    "fastc_parse": f"with {_PARTS}, w as (select file, taxon, p_size, string_split(p_name, ' ') as ws from p), s as (select file, taxon, p_size, ws, unnest(range(len(ws))) as site from w) select file, taxon, site::int as site, ws[site + 1] || case when site = len(ws) - 1 then '|s' || p_size else '' end as symbols from s",
    "gap_removal": f"with {_PARTS} select file, taxon, nullif(replace({_SITES}, 'A', ''), '') as sequence from p",
    "prealigned_expansion": f"with {_PARTS}, s as (select file, taxon, {_SITES} as t, unnest(range(6)) as site from p) select file, taxon, site::int as site, t[site + 1] as state from s",
    "nexus_parse": f"with {_PARTS} select file, taxon, 0 as site, case when p_size % 5 = 0 then null else (p_size % 5)::varchar end as state from p union all select file, taxon, 1, (length(p_brand) % 4)::varchar from p union all select file, taxon, 2, (length(p_type) % 5)::varchar from p",
    "tnt_parse": f"with {_PARTS} select file, taxon, 0 as site, (p_size % 10)::varchar as state from p union all select file, taxon, 1, (p_partkey % 7)::varchar from p union all select file, taxon, 2, null from p",
    "tnt_tree": f"with {_PARTS} select file, taxon, ({_DEPTH})::int as depth from p",
    "tnt_score": f"""with recursive {_PARTS}, leaf as (select file, k, n, 1::bigint << (p_partkey % 7)::int as m from p),
up as (select file, k, n, m, 0::bigint as cost from leaf where k = 1 union all select u.file, l.k, u.n, case when u.m & l.m <> 0 then u.m & l.m else u.m | l.m end, u.cost + case when u.m & l.m <> 0 then 0 else 1 end from up u join leaf l on l.file = u.file and l.k = u.k + 1)
select file, cost from up where k = n""",
    "ver_parse": f"with {_PARTS} {_HEAP}",
    "dot_parse": f"with {_PARTS} {_HEAP}",
    "newick_write": f"with {_PARTS} select file, case when count(*) = 1 then min(taxon) else coalesce(string_agg('(' || taxon || ',', '' order by k) filter (k < n), '') || max(taxon) || repeat(')', count(*)::int - 1) end || ';' as newick, count(*)::int as leaves from p group by file",
    "unrooted_edges": f"with {_PARTS} select file, place // 2 as a, place as b from p where place > 3 union all select file, 2, 3 from p where place = 3 union all select file, 1, 2 from p where place = 2 and n = 2",
    "tcm_parse": """with q as (select p_partkey as file, p_size, greatest(4 // gcd(p_size, 4), 4 // gcd(p_size + 1, 4)) as up from part),
c as (select file, up, unnest([0, 1, 2]) as a, p_size from q), d as (select file, up, a, unnest([0, 1, 2]) as b, p_size from c)
select file, 'ab-' as symbols, a, b, ((case when a = b then 0 when (a, b) in ((0, 1), (1, 0)) then p_size / 4.0 when 0 in (a, b) then 2.0 else (p_size + 1) / 4.0 end) * up)::bigint as cost, 1.0::double / up as scale from d""",
    "tcm_diagnosis": "select p_partkey as file, case when p_size % 2 = 0 then 'UltraMetric' else 'Metric' end as structure, p_size::bigint as factor, (2 + p_size % 2)::bigint as first from part",
    "full_coverage": "select * from (select l_orderkey as dag_id, l_returnflag as resolution_id, bit_or(1::bigint << (l_suppkey % 2)::int) as leaves, min(l_quantity) as cost from lineitem group by 1, 2) where leaves = 3",
    "compatible_topologies": """with s as (select l_orderkey, coalesce(list(distinct l_linenumber) filter (l_returnflag = 'R'), []) as i, coalesce(list(distinct l_linenumber) filter (l_returnflag = 'A'), []) as x from lineitem group by 1)
select a.l_orderkey, not list_has_any(a.i, b.x) and not list_has_any(b.i, a.x) as together from s a join s b on b.l_orderkey = a.l_orderkey + 1""",
    "average_length": "select p_brand, avg(length(p_name)) as average from part group by 1",
    "leaf_characters": "select c_custkey as taxon, n as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey",
    "graph_roots": f"with {_PARTS} select distinct file as dag_id, 1::bigint as node_id from p where n > 1",
    "graph_leaves": f"with {_PARTS} select file as dag_id, place as node_id from p where place > 1 and 2 * place > n",
}
