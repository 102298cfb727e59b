"""DuckDB SQL for the registered queries, over the driver's tables; trees are unrolled level by level."""

from __future__ import annotations

from cladespark.file_oracles import FILE_ORACLES

LEVELS, STATES, FOUR_STATES = 4, 5, 4
WIDEST = "1e300::double"
#: Costs between A, C, G and T.
DNA_COSTS = [[0, 2, 1, 2], [2, 0, 2, 1], [1, 2, 0, 2], [2, 1, 2, 0]]


def values(rows: list[tuple], names: str) -> str:
    return f"(values {', '.join(str(r) for r in rows)}) as t({names})"


def _obs(states: int) -> str:
    return f"obs as (select l_suppkey % 16 + 16 as node, l_partkey as char_id, bit_or((1::bigint << (l_quantity::bigint % {states})::int)) as mask from lineitem group by all)"


_GRID = "grid as (select char_id, n.node from (select distinct l_partkey as char_id from lineitem) c, (select unnest(range(16, 32)) as node) n)"


def _fitch_levels() -> str:
    out = [_obs(STATES), _GRID, f"v4 as (select g.char_id, g.node, coalesce(o.mask, {(1 << STATES) - 1})::bigint as m, 0::bigint as c from grid g left join obs o using (char_id, node))"]
    for k in reversed(range(LEVELS)):
        out.append(f"v{k} as (select char_id, node // 2 as node, case when bit_and(m) <> 0 then bit_and(m) else bit_or(m) end as m, (sum(c) + case when bit_and(m) <> 0 then 0 else 1 end)::bigint as c from v{k + 1} group by char_id, node // 2)")
    return ", ".join(out)


def _all(select: str = "*") -> str:
    return " union all ".join(f"select {select} from v{k}" for k in range(LEVELS + 1))


def _fitch_final(strict: bool) -> str:
    kids = ", ".join(f"k{k} as (select char_id, node // 2 as node, bit_or(m) as lr from v{k + 1} group by char_id, node // 2)" for k in range(LEVELS))
    parts = ["f0 as (select char_id, node, m as f, m from v0)"]
    for k in range(1, LEVELS):
        a = "p.f" if strict else "p.m"
        third = f"({a} | (k.lr & v.m))" if strict else a
        parts.append(f"f{k} as (select v.char_id, v.node, case when ({a} & v.m) = {a} then {a} when k.lr = v.m then ({a} | v.m) else {third} end as f, v.m from v{k} v join f{k - 1} p on p.char_id = v.char_id and p.node = v.node // 2 join k{k} k on k.char_id = v.char_id and k.node = v.node)")
    rows = " union all ".join(f"select char_id, node, f from f{k}" for k in range(LEVELS)) + f" union all select char_id, node, m from v{LEVELS}"
    return f"with {_fitch_levels()}, {kids}, {', '.join(parts)} select char_id, node as node_id, f as mask from ({rows})"


def _interval_levels(column: str) -> str:
    out = [f"obs as (select l_suppkey % 16 + 16 as node, l_partkey as char_id, min({column}) as lo, max({column}) as hi from lineitem group by all)", _GRID, f"v4 as (select g.char_id, g.node, coalesce(o.lo, -{WIDEST}) as lo, coalesce(o.hi, {WIDEST}) as hi, 0::double as c from grid g left join obs o using (char_id, node))"]
    for k in reversed(range(LEVELS)):
        out.append(f"v{k} as (select char_id, node // 2 as node, least(max(lo), min(hi)) as lo, greatest(max(lo), min(hi)) as hi, sum(c) + greatest(max(lo) - min(hi), 0) as c from v{k + 1} group by char_id, node // 2)")
    return ", ".join(out)


def _interval_final() -> str:
    kids = ", ".join(f"k{k} as (select char_id, node // 2 as node, min(lo) as ulo, max(hi) as uhi from v{k + 1} group by char_id, node // 2)" for k in range(LEVELS))
    parts = ["f0 as (select char_id, node, lo as flo, hi as fhi from v0)"]
    for k in range(1, LEVELS):
        parts.append(f"""j{k} as (select v.char_id, v.node, v.lo as slo, v.hi as shi, p.flo as alo, p.fhi as ahi, k.ulo, k.uhi, greatest(least(k.ulo, v.lo), p.flo) as xlo, least(greatest(k.uhi, v.hi), p.fhi) as xhi
          from v{k} v join f{k - 1} p on p.char_id = v.char_id and p.node = v.node // 2 join k{k} k on k.char_id = v.char_id and k.node = v.node),
        n{k} as (select *, case when shi < xlo then shi else slo end as near, case when shi < alo then shi else slo end as mine, case when uhi < alo then uhi else ulo end as theirs from j{k}),
        f{k} as (select char_id, node,
          case when greatest(alo, slo) = alo and least(ahi, shi) = ahi then alo when ulo <= ahi and uhi >= alo then case when slo <= xhi and shi >= xlo then xlo else least(near, xhi) end else least(mine, theirs) end as flo,
          case when greatest(alo, slo) = alo and least(ahi, shi) = ahi then ahi when ulo <= ahi and uhi >= alo then case when slo <= xhi and shi >= xlo then xhi else greatest(near, xlo) end else greatest(mine, theirs) end as fhi from n{k})""")
    rows = " union all ".join(f"select char_id, node, flo, fhi from f{k}" for k in range(LEVELS)) + f" union all select char_id, node, lo, hi from v{LEVELS}"
    return f"with {_interval_levels('l_quantity')}, {kids}, {', '.join(parts)} select char_id, node as node_id, flo as lo, fhi as hi from ({rows})"


def _best(row: list[int], table: str = "") -> str:
    return "least(" + ", ".join(f"{x} + {table}c{t}" for t, x in enumerate(row)) + ", 1099511627776)"


def _sankoff_levels() -> str:
    n = FOUR_STATES
    leaf = ", ".join(f"case when coalesce(o.mask, {(1 << n) - 1}) >> {s} & 1 = 1 then 0 else 1099511627776 end::bigint as c{s}" for s in range(n))
    out = [_obs(n), _GRID, f"v4 as (select g.char_id, g.node, {leaf} from grid g left join obs o using (char_id, node))"]
    for k in reversed(range(LEVELS)):
        cells = ", ".join(f"least(sum({_best(DNA_COSTS[s])}), 1099511627776)::bigint as c{s}" for s in range(n))
        out.append(f"v{k} as (select char_id, node // 2 as node, {cells} from v{k + 1} group by char_id, node // 2)")
    return ", ".join(out)


def _sankoff_final() -> str:
    n = FOUR_STATES
    least = "least(" + ", ".join(f"c{s}" for s in range(n)) + ")"
    bits = lambda conds: "(" + " | ".join(f"case when {c} then {1 << s}::bigint else 0::bigint end" for s, c in enumerate(conds)) + ")"
    parts = [f"f0 as (select char_id, node, {bits([f'c{s} = {least}' for s in range(n)])} as f from v0)"]
    for k in range(1, LEVELS):
        best = lambda s: "least(" + ", ".join(f"{x} + v.c{t}" for t, x in enumerate(DNA_COSTS[s])) + ")"
        conds = [" or ".join(f"(p.f >> {s} & 1 = 1 and {DNA_COSTS[s][t]} + v.c{t} = {best(s)})" for s in range(n)) for t in range(n)]
        parts.append(f"f{k} as (select v.char_id, v.node, {bits(conds)} as f from v{k} v join f{k - 1} p on p.char_id = v.char_id and p.node = v.node // 2)")
    rows = " union all ".join(f"select char_id, node, f from f{k}" for k in range(LEVELS)) + f" union all select char_id, node, {bits([f'c{s} = 0' for s in range(n)])} from v{LEVELS}"
    return f"with {_sankoff_levels()}, {', '.join(parts)} select char_id, node as node_id, f as mask from ({rows})"


_CELLS = """(select p_partkey as tcm_id, i, j, case when i = j or p_partkey % 11 = 0 then 0 when i + j = 1 then 1 + p_size % 3 + case when i > j and p_partkey % 5 = 0 then 1 else 0 end
 when i + j = 2 then 1 + p_size // 3 % 4 else 1 + p_size // 12 % 3 end::bigint as cost from part, (select unnest([0, 1, 2]) as i) as a, (select unnest([0, 1, 2]) as j) as b) as t"""
_COSTS = "select c_nationkey as block_id, case when o_orderstatus = 'O' then 'dynamic' else 'additive' end as bin, floor(o_totalprice) as cost, (1 + o_orderkey % 4)::double as weight, (o_custkey % 10)::double as length from orders join customer on o_custkey = c_custkey"
#: Heap graphs of 12 parts; nodes 9 and 11 have a second parent in some of them.
_ALL_EDGES = """(select p_partkey // 12 as dag_id, (p_partkey % 12 + 1) // 2 as parent, p_partkey % 12 + 1 as child from part where p_partkey % 12 > 0
 union all select p_partkey // 12, 5, 9 from part where p_partkey % 12 = 8 and p_size % 2 = 0 union all select p_partkey // 12, 6, 11 from part where p_partkey % 12 = 10 and p_size % 3 = 0) as t"""
_NATION = "sizes as (select c_nationkey as dag_id, count(*) as n from customer group by 1), edges as (select dag_id, c // 2 as parent, c as child from (select dag_id, unnest(range(2, greatest(n, 2) + 1)) as c from sizes))"


def _resolutions(side: int) -> str:
    return f"select l_orderkey as dag_id, 1::bigint << (l_suppkey % 8)::int as leaves, min(l_quantity) as cost from lineitem where l_linenumber % 2 = {side} group by all"


_PRODUCT = f"with a as ({_resolutions(0)}), b as ({_resolutions(1)}) select a.dag_id, a.leaves as left_id, b.leaves as right_id, a.leaves | b.leaves as leaves, a.cost + b.cost as cost from a join b using (dag_id) where a.leaves & b.leaves = 0"


def _extreme(agg: str) -> str:
    return f"select p_brand, p_size, p_partkey from part where (p_brand, p_size) in (select p_brand, {agg}(p_size) from part group by 1)"


def _medians() -> str:
    n = FOUR_STATES
    rows = []
    for a in range(1, 1 << n):
        for b in range(1, 1 << n):
            total = [min(DNA_COSTS[i][j] for j in range(n) if a >> j & 1) + min(DNA_COSTS[i][j] for j in range(n) if b >> j & 1) for i in range(n)]
            rows.append((a, b, sum(1 << i for i, x in enumerate(total) if x == min(total)), min(total)))
    return values(rows, "a, b, median, cost")


def _candidates() -> str:
    return f"""with recursive e as (select * from {_ALL_EDGES}),
up as (select dag_id, parent as anc, child as node from e union select u.dag_id, u.anc, e.child from up u join e on e.dag_id = u.dag_id and e.parent = u.node),
nets as (select dag_id, child as net, min(parent) as p1, max(parent) as p2 from e group by 1, 2 having count(*) > 1),
other as (select dag_id, net, p1 as one, p2 as two from nets union all select dag_id, net, p2, p1 from nets),
roots as (select distinct dag_id, parent as r from e where (dag_id, parent) not in (select dag_id, child from e)),
implied as (select distinct c.dag_id, x.anc, c.node from up c join other o on o.dag_id = c.dag_id and c.anc = o.one join up x on x.dag_id = o.dag_id and x.node = o.two)
select a.dag_id, a.parent as src1, a.child as tgt1, b.parent as src2, b.child as tgt2 from e a join e b on a.dag_id = b.dag_id and a.parent <> b.parent
where not exists (select 1 from roots r where r.dag_id = a.dag_id and r.r in (a.parent, b.parent))
 and not exists (select 1 from nets n where n.dag_id = b.dag_id and n.net in (b.parent, b.child))
 and not exists (select 1 from up u where u.dag_id = a.dag_id and u.anc = a.child and u.node = b.parent)
 and not exists (select 1 from up u where u.dag_id = a.dag_id and u.anc = b.parent and u.node = a.parent)
 and not exists (select 1 from implied u where u.dag_id = a.dag_id and u.anc = a.child and u.node = b.parent)
 and not exists (select 1 from implied u where u.dag_id = a.dag_id and u.anc = b.child and u.node = a.parent)
 and not exists (select 1 from other o join up u on u.dag_id = o.dag_id and u.anc = o.two where o.dag_id = b.dag_id and o.one = b.parent and u.node = a.child)
 and not exists (select 1 from other o join up u on u.dag_id = o.dag_id and u.anc = o.two where o.dag_id = a.dag_id and o.one = a.parent and o.net = a.child and u.node = b.child)"""


ORACLES: dict[str, str] = {
    "fitch_length": f"with {_fitch_levels()} select char_id, c as cost from v0",
    "fitch_states": f"with {_fitch_levels()} select char_id, node as node_id, m as mask, c as cost from ({_all()})",
    "fitch_final": _fitch_final(False),
    "fitch_final_strict": _fitch_final(True),
    "additive_length": f"with {_interval_levels('l_quantity')} select char_id, c as cost from v0",
    "continuous_length": f"with {_interval_levels('l_extendedprice')} select char_id, round(c, 2) as cost from v0",
    "additive_final": _interval_final(),
    "sankoff_length": f"with {_sankoff_levels()} select char_id, least(c0, c1, c2, c3) as cost from v0",
    "sankoff_final": _sankoff_final(),
    "score_matrix": f"select * from (with {_fitch_levels()} select char_id, 'nonAdditive' as bin, c::double as cost from v0) union all select * from (with {_interval_levels('l_quantity')} select char_id, 'additive' as bin, c as cost from v0)",
    "three_way_median": f"""with {_obs(STATES)}, s as (select char_id, coalesce(bit_or(mask) filter (node % 3 = 0), 31)::bigint as a, coalesce(bit_or(mask) filter (node % 3 = 1), 31)::bigint as b, coalesce(bit_or(mask) filter (node % 3 = 2), 31)::bigint as c from obs group by 1)
select char_id, case when a & b & c <> 0 then a & b & c when (a & b) | (a & c) | (b & c) <> 0 then (a & b) | (a & c) | (b & c) else a | b | c end as mask, case when a & b & c <> 0 then 0 when (a & b) | (a & c) | (b & c) <> 0 then 1 else 2 end::bigint as cost from s""",
    "mask_round_trip": """select p_partkey, mask, symbols, mask & -mask as first from (select p_partkey, (1::bigint << (p_size % 10)) | (1::bigint << (p_partkey % 10)::int) as mask,
 case when p_size % 10 = p_partkey % 10 then (p_size % 10)::varchar else least(p_size % 10, p_partkey % 10)::varchar || ',' || greatest(p_size % 10, p_partkey % 10)::varchar end as symbols from part)""",
    "tcm_structure": f"""with c as (select * from {_CELLS}),
b as (select tcm_id, bool_and((cost = 0) = (i = j)) as zeros, bool_and(cost = abs(i - j)) as additive, bool_and(cost = case when i = j then 0 else 1 end) as discrete from c group by 1),
s as (select x.tcm_id, bool_and(x.cost = y.cost) as sym from c x join c y on x.tcm_id = y.tcm_id and x.i = y.j and x.j = y.i group by 1),
t as (select ab.tcm_id, bool_and(ab.cost <= ac.cost + cb.cost) as metric, bool_and(ab.cost <= greatest(ac.cost, cb.cost)) as ultra from c ab join c ac on ab.tcm_id = ac.tcm_id and ab.i = ac.i and ab.j < ac.j and ab.i < ab.j join c cb on cb.tcm_id = ab.tcm_id and cb.i = ac.j and cb.j = ab.j group by 1),
d as (select b.tcm_id, case when not sym then 'NonSymmetric' when not (zeros and coalesce(metric, true)) then 'Symmetric' when additive then 'Additive' when not (zeros and coalesce(ultra, true)) then 'Metric' when not discrete then 'UltraMetric' else 'NonAdditive' end as structure from b join s using (tcm_id) left join t using (tcm_id))
select tcm_id, structure, case structure when 'NonAdditive' then 'nonAdditive' when 'Additive' then 'additive' when 'Metric' then 'metric' when 'UltraMetric' then 'metric' else 'nonMetric' end as bin from d""",
    "tcm_factor": f"select tcm_id, list_reduce(list_sort(list(cost)), lambda a, b: gcd(a, b))::bigint as factor from {_CELLS} group by 1",
    "tcm_median": f"""with {_obs(FOUR_STATES)}, h as (select char_id, bit_or(mask) filter (node % 2 = 0) as a, bit_or(mask) filter (node % 2 = 1) as b from obs group by 1), m as (select * from {_medians()})
select char_id, h.a, h.b, m.median::bigint as median, m.cost::bigint as cost from h join m on h.a = m.a and h.b = m.b""",
    "block_cost": f"select block_id, sum(cost * weight) as cost from ({_COSTS}) group by 1",
    "static_cost": f"select block_id, sum(case when bin <> 'dynamic' then cost * weight else 0 end) as cost from ({_COSTS}) group by 1",
    "root_cost": f"select block_id, sum(weight / 2 * case when bin = 'dynamic' then length else 1 end) * 2 as cost from ({_COSTS}) group by 1",
    "dag_cost": "select dag_id, sum(c) as cost from (select l_suppkey as dag_id, l_partkey, min(l_quantity) as c from lineitem group by 1, 2) group by 1",
    "taxon_outer_merge": """with c as (select right(c_name, 6) as taxon, sum(c_nationkey)::bigint as customers from customer group by 1), s as (select right(s_name, 6) as taxon, sum(s_nationkey)::bigint as suppliers from supplier group by 1), p as (select lpad(p_partkey::varchar, 6, '0') as taxon, sum(p_size)::bigint as parts from part group by 1)
select taxon, customers, suppliers, parts from c full join s using (taxon) full join p using (taxon)""",
    "missing_taxa": "select distinct c_custkey::varchar as taxon from customer where c_custkey not in (select o_custkey from orders)",
    "extra_taxa": "select distinct c_custkey::varchar as taxon from customer where c_custkey not in (select o_custkey from orders)",
    "duplicate_taxa": "select o_custkey::varchar as taxon from orders group by 1 having count(*) > 1",
    "last_source_wins": "select key, source, value from (select l_partkey as key, l_linenumber as source, max(l_quantity) as value, row_number() over (partition by l_partkey order by l_linenumber desc) as r from lineitem group by 1, 2) where r = 1",
    "pad_missing": f"with {_obs(STATES)}, grid as (select char_id, node from (select distinct char_id from obs), (select distinct node from obs)) select g.node::varchar as taxon, g.char_id, coalesce(o.mask, 31)::bigint as mask from grid g left join obs o using (char_id, node)",
    "distance_matrix_discrete": f"with {_obs(STATES)} select a.node::varchar as i, b.node::varchar as j, sum(case when a.node = b.node or a.mask & b.mask <> 0 then 0 else 1 end)::double as distance from obs a join obs b using (char_id) group by 1, 2",
    "distance_matrix_interval": "with obs as (select l_suppkey % 16 + 16 as node, l_partkey as char_id, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by all) select a.node::varchar as i, b.node::varchar as j, sum(2 * greatest(greatest(a.lo, b.lo) - least(a.hi, b.hi), 0))::double as distance from obs a join obs b using (char_id) group by 1, 2",
    "alphabet_histogram": "select c as value, count(*) as count from (select unnest(string_split(p_name, '')) as c from part) where c <> '' group by 1",
    "observed_alphabet": "select p_brand, string_agg(c, '' order by c) || '-' as alphabet from (select distinct p_brand, unnest(string_split(p_name, '')) as c from part) where c <> '' and c not in ('-', '?') group by 1",
    "most_common_state": "select p_brand, p_size as value from (select p_brand, p_size, row_number() over (partition by p_brand order by count(*) desc, p_size) as r from part group by 1, 2) where r = 1",
    "argmin_with_ties": _extreme("min"),
    "argmax_with_ties": _extreme("max"),
    "argmin_first": "select p_brand, p_size, p_partkey from (select *, row_number() over (partition by p_brand order by p_size, p_partkey) as r from part) where r = 1",
    "functional_dependency": "select l_partkey, count(distinct l_linestatus) = 1 as invariant from lineitem group by 1",
    "leaf_sets": "select l_partkey, bit_or(1::bigint << (l_suppkey % 60)::int) as leaves from lineitem group by 1",
    "node_kinds": f"""with e as (select * from {_ALL_EDGES}), n as (select dag_id, parent as node_id, 1 as below, 0 as above from e union all select dag_id, child, 0, 1 from e)
select dag_id, node_id, case when sum(below) = 0 then 'leaf' when sum(above) = 0 then 'root' when sum(above) > 1 then 'network' else 'tree' end as kind from n group by 1, 2""",
    "network_edges": f"select dag_id, parent, child from {_ALL_EDGES} where (dag_id, child) in (select dag_id, child from {_ALL_EDGES} group by 1, 2 having count(*) > 1)",
    "ancestor_closure": "with recursive e as (select c_custkey // 2 as parent, c_custkey as child from customer where c_custkey > 1), up as (select parent as ancestor, child as node from e union all select u.ancestor, e.child from up u join e on e.parent = u.node) select ancestor, node from up",
    "candidate_edges": _candidates(),
    "insert_edge": f"""with {_NATION}, top as (select dag_id, max(child) as child, max(greatest(parent, child)) + 1 as free from edges group by 1),
hit as (select t.dag_id, t.child // 2 as parent, t.child, free from top t)
select dag_id, parent, child from edges where (dag_id, child) not in (select dag_id, child from hit) union all select dag_id, parent, free from hit union all select dag_id, free, child from hit union all select dag_id, free, free + 1 from hit""",
    "connect_edge": f"""with {_NATION}, top as (select dag_id, max(greatest(parent, child)) + 1 as s from edges where dag_id in (select dag_id from edges where child = 6) group by 1)
select dag_id, parent, child from edges where not (child in (4, 6) and dag_id in (select dag_id from top)) union all select dag_id, 2, s from top union all select dag_id, s, 4 from top union all select dag_id, 3, s + 1 from top union all select dag_id, s + 1, 6 from top union all select dag_id, s, s + 1 from top""",
    "prune_edges": f"with {_NATION} select dag_id, parent, child from edges where child % 3 <> 0",
    "contract_ids": f"with {_NATION}, n as (select dag_id, parent as node_id from edges where child % 3 <> 0 union select dag_id, child from edges where child % 3 <> 0) select dag_id, node_id, (row_number() over (partition by dag_id order by node_id) - 1)::int as new_id from n",
    "display_products": _PRODUCT,
    "soft_wired_resolutions": f"{_PRODUCT} union all select dag_id, leaves, null, leaves, cost from a",
    "minimal_display_per_block": "select block_id, display_id, cost from (select l_partkey as block_id, l_suppkey as display_id, sum(l_quantity) as cost, row_number() over (partition by l_partkey order by sum(l_quantity), l_suppkey) as r from lineitem group by 1, 2) where r = 1",
    "punitive_cost": """with i as (select l_suppkey as dag_id, year(l_shipdate) as block_id, l_linenumber as e, l_quantity as q from lineitem),
m as (select dag_id, block_id, sum(q) as cost, list_distinct(list(e)) as edges from i group by 1, 2), b as (select dag_id, list_distinct(list(e)) as top from i where e <= 2 group by 1), u as (select dag_id, list_distinct(list(e)) as used, count(distinct block_id) as n from i group by 1),
p as (select dag_id, sum(cost * len(list_filter(edges, lambda x: not list_contains(top, x)))) as paid from m join b using (dag_id) group by 1)
select dag_id, case when len(list_filter(range(1, 8), lambda x: not list_contains(used, x))) > 0 then 'infinity'::double else paid / (2 * n) end as penalty, array_to_string(list_filter(range(1, 8), lambda x: not list_contains(used, x)), ',') as unused from u join p using (dag_id)""",
    "pairwise_alignment_cost": "select a.p_partkey, levenshtein(a.p_name, b.p_name)::bigint as cost from part a join part b on a.p_partkey = b.p_partkey + 1",
    "cluster_single_cut": f"""with recursive {_obs(STATES)}, d as (select a.node as i, b.node as j, sum(case when a.mask & b.mask <> 0 then 0 else 1 end)::double as x from obs a join obs b using (char_id) where a.node <> b.node group by 1, 2),
steps as (select min(x) as x from d), tree(node, reach, height) as (select 16, [16]::bigint[], 0::double union all select n.j, list_append(t.reach, n.j), n.x from tree t, lateral (select j, x from d where list_contains(t.reach, i) and not list_contains(t.reach, j) order by x, j limit 1) n),
top as (select max(height) * 0.9 as h from tree), links as (select i, j from d, top where x <= h), comp as (select distinct i as node, i as low from d union select l.i, c.low from comp c join links l on l.j = c.node)
select node::varchar as taxon, min(low::varchar) as cluster from comp group by 1""",
    "fasta_parse": "select p_brand, 'P' || p_partkey as taxon, upper(replace(p_name, ' ', '')) as sequence from part",
    "newick_parse": "select p_brand, p_partkey::varchar as taxon, case when count(*) over w = 1 then 0 when row_number() over o = 1 then count(*) over w - 1 else count(*) over w - row_number() over o + 1 end::bigint as depth from part window w as (partition by p_brand), o as (partition by p_brand order by p_partkey)",
}

ORACLES |= FILE_ORACLES
ORACLES |= {
    "distance_matrix_dynamic": """with s as (select p_partkey // 16 as c, lpad((p_partkey % 16)::varchar, 2, '0') as t, translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', '123012301230123012301230120') as q from part)
select a.t as i, b.t as j, sum(case when a.t = b.t then 0 else levenshtein(a.q, b.q) end)::double as distance from s a join s b using (c) group by 1, 2""",
    "sankoff_extra": f"""with {_sankoff_levels()}, r as (select char_id, c0, c1, c2, c3, least(c0, c1, c2, c3) as m from v0), s as (select char_id, unnest([0, 1, 2, 3]) as state, [c0 - m, c1 - m, c2 - m, c3 - m] as x from r)
select char_id, state, x[state + 1]::bigint as above, least((case state when 0 then 0 when 1 then 2 when 2 then 1 else 2 end) + x[1], (case state when 0 then 2 when 1 then 0 when 2 then 2 else 1 end) + x[2], (case state when 0 then 1 when 1 then 2 when 2 then 0 else 2 end) + x[3], (case state when 0 then 2 when 1 then 1 when 2 then 2 else 0 end) + x[4], 1099511627776)::bigint as leaving from s""",
    "total_cost": f"""with c as (select char_id * 2 as id, cost::double as cost from (with {_fitch_levels()} select char_id, c as cost from v0) union all select char_id * 2 + 1, cost from (with {_interval_levels('l_quantity')} select char_id, c::double as cost from v0))
select sum(cost * (1.0 + id % 7)) as block_cost, 0.0::double as root_cost, 0.0::double as network_cost, sum(cost * (1.0 + id % 7)) as total from c""",
}
