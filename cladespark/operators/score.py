"""Scoring of any number of characters on trees and networks.

Characters are independent given a topology: they are dealt out by character
number, the topology goes along with the tasks, and each task walks the graph
once for all its characters, in numpy. There is one shuffle.

A network is scored soft-wired: each block of characters takes the display
tree on which it is cheapest. For a dynamic character every edge of a display
tree is tried as the place of the root.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.functions import masks
from cladespark.operators import kernels
from cladespark.operators.alignment import Aligner, Dynamic, encode
from cladespark.operators.tcm import Tcm, default_tcm
from cladespark.operators.topology import Topology

OBS = "taxon string, char_id int, mask bigint, lo double, hi double, seq array<bigint>"
CHARACTERS = "char_id int, block_id int, name string, bin string, weight double, alphabet array<string>, tcm_id int, source string"
STATIC = ("continuous", "nonAdditive", "additive", "metric", "nonMetric")
#: Characters of one task's group, fewer where there are many taxa: a group has CELLS observations at most.
CHUNK, CELLS = 4096, 1_000_000
#: A dynamic character takes about as long as this many static ones.
DYNAMIC = 64
WIDEST = 1e300
#: Stands for a missing mask in pandas, where a null would turn the column into floats, which hold 53 bits.
UNKNOWN = -1


def static_pass(tree: Topology, leaf_states: dict[int, np.ndarray], merge) -> tuple[dict[int, np.ndarray], np.ndarray | float]:
    """States of all nodes and the summed step costs; nodes with more than two children are merged from the left."""
    states, cost = dict(leaf_states), 0
    for n in tree.postorder():
        below = tree.children.get(n, ())
        if not below:
            continue
        state = states[below[0]]
        for c in below[1:]:
            state, step = merge(state, states[c])
            cost = cost + step
        states[n] = state
    return states, cost


def directed_states(tree: Topology, leaf_states: dict[int, Dynamic], aligner: Aligner):
    """(cost, state) of the subtree on the far side of each directed edge of the unrooted tree, each computed once."""
    near: dict[int, list[int]] = {}
    for e in unrooted_edges(tree):
        near.setdefault(e[0], []).append(e[1])
        near.setdefault(e[1], []).append(e[0])
    memo: dict[tuple[int, int], tuple[int, Dynamic]] = {}

    def state(node: int, origin: int) -> tuple[int, Dynamic]:
        stack = [(node, origin)]
        while stack:
            n, o = stack[-1]
            if (n, o) in memo:
                stack.pop()
                continue
            below = [x for x in near.get(n, []) if x != o]
            todo = [(x, n) for x in below if (x, n) not in memo]
            if todo:
                stack += todo
                continue
            if n in leaf_states:
                memo[n, o] = 0, leaf_states[n]
            else:
                cost, merged = memo[below[0], n]
                for x in below[1:]:
                    c, s = memo[x, n]
                    step, merged = aligner.align(merged, s)
                    cost += c + step
                memo[n, o] = cost, merged
            stack.pop()
        return memo[node, origin]

    return state


def unrooted_edges(tree: Topology) -> list[tuple[int, int]]:
    """The edges of the tree without its root: a root with two children is one edge between them."""
    out = []
    roots = set(tree.roots)
    for p, cs in tree.children.items():
        if p in roots and len(cs) == 2:
            out.append(cs)
        else:
            out += [(p, c) for c in cs]
    return out


def dynamic_cost(tree: Topology, leaf_states: dict[int, Dynamic], aligner: Aligner, reroot: bool = True) -> tuple[int, tuple[int, int] | None]:
    """Least cost over the edges as places of the root, and the first edge that has it."""
    if not tree.children:
        return 0, None
    if not reroot:
        states, cost = static_pass(tree, leaf_states, lambda a, b: aligner.align(a, b)[::-1])
        return int(cost), None
    state = directed_states(tree, leaf_states, aligner)
    best = None
    for a, b in unrooted_edges(tree):
        (ca, sa), (cb, sb) = state(a, b), state(b, a)
        total = ca + cb + aligner.align(sa, sb)[0]
        if best is None or total < best[0]:
            best = total, (a, b)
    return best


def full_sets(symbols: np.ndarray) -> np.ndarray:
    """All symbols of each character's alphabet; as Python's numbers if some alphabet is wider than 63 bits."""
    if any(map(masks.is_wide, symbols.tolist())):
        return np.array([(1 << s) - 1 for s in symbols.tolist()], object)
    return (np.int64(1) << symbols) - 1


def observed_sets(rows: pd.DataFrame, symbols: np.ndarray) -> np.ndarray:
    """The set of each row, UNKNOWN where it is missing."""
    narrow = rows["mask"].fillna(UNKNOWN).to_numpy(np.int64)
    if not any(map(masks.is_wide, symbols.tolist())):
        return narrow
    out = narrow.astype(object)
    for k, (seq, s) in enumerate(zip(rows.seq, symbols.tolist(), strict=True)):
        if masks.is_wide(s):
            out[k] = UNKNOWN if seq is None or isinstance(seq, float) else masks.unpacked(seq, s)[0]
    return out


def components_of(tree: Topology) -> list[Topology]:
    return [tree.subtree(r) for r in tree.roots]


def character_costs(tree: Topology, rows: pd.DataFrame, tcms: dict[int, Tcm], reroot: bool = True) -> pd.DataFrame:
    """(char_id, cost, length) of the characters in rows(taxon, char_id, bin, symbols, tcm_id, mask, lo, hi, seq)."""
    leaves = [n for n in tree.leaves]
    place = {tree.labels.get(n, str(n)): n for n in leaves}
    order = {t: i for i, t in enumerate(place)}
    out = []
    for (kind, tcm_id), part in rows.groupby(["bin", pd.to_numeric(rows.tcm_id).fillna(-1).astype(int)], sort=True):
        chars = np.sort(part.char_id.unique())
        column = {c: i for i, c in enumerate(chars)}
        known = part[part.taxon.isin(place)]
        at = known.char_id.map(column).to_numpy(int)
        node = known.taxon.map(place).to_numpy(int)
        row = known.taxon.map(order).to_numpy(int)
        symbols = part.groupby("char_id").symbols.first().reindex(chars).to_numpy(int)
        lengths = np.zeros(len(chars))
        if kind == "dynamic":
            tcm = tcms.get(tcm_id)
            costs = np.zeros(len(chars))
            sequences = list(known.seq)
            for i in range(len(chars)):
                aligner = Aligner(tcm or default_tcm(symbols[i]))
                states: dict[int, Dynamic] = dict.fromkeys(leaves)
                for k in np.flatnonzero(at == i):
                    states[node[k]] = encode(masks.unpacked(sequences[k], int(symbols[i])))
                sizes = [len(s) for s in states.values() if s is not None]
                lengths[i] = sum(sizes) / len(sizes) if sizes else 0
                costs[i] = sum(dynamic_cost(t, {n: states[n] for n in t.leaves}, aligner, reroot)[0] for t in components_of(tree))
        elif kind in ("continuous", "additive"):
            spans = np.empty((len(leaves), 2, len(chars)))
            spans[:, 0], spans[:, 1] = -WIDEST, WIDEST
            lo, hi = known.lo.to_numpy(float), known.hi.to_numpy(float)
            there = ~np.isnan(lo) & ~np.isnan(hi)
            spans[row[there], 0, at[there]], spans[row[there], 1, at[there]] = lo[there], hi[there]
            table = dict(zip(leaves, spans, strict=True))
            costs = np.broadcast_to(static_pass(tree, table, kernels.Interval().merge)[1], len(chars)).astype(float)
        else:
            sets = np.tile(full_sets(symbols), (len(leaves), 1))
            mask = observed_sets(known, symbols[at])
            there = mask >= 0
            sets[row[there], at[there]] = mask[there]
            table = dict(zip(leaves, sets, strict=True))
            if kind == "nonAdditive":
                costs = np.broadcast_to(static_pass(tree, table, kernels.Fitch().merge)[1], len(chars)).astype(float)
            else:
                sankoff = kernels.Sankoff(tcms[tcm_id])
                states, _ = static_pass(tree, {n: sankoff.leaf(m) for n, m in table.items()}, lambda a, b: (sankoff.merge(a, b), 0))
                costs = sum(states[r].min(0) for r in tree.roots).astype(float)
        out.append(pd.DataFrame({"char_id": chars, "cost": costs, "length": lengths}))
    return pd.concat(out) if out else pd.DataFrame({"char_id": [], "cost": [], "length": []})


def _dealt(obs: DataFrame, characters: DataFrame, taxa: int) -> DataFrame:
    size = max(1, min(CHUNK, CELLS // max(taxa, 1)))
    meta = characters.select("char_id", "bin", F.size("alphabet").alias("symbols"), "tcm_id")
    return obs.withColumn("mask", F.coalesce("mask", F.lit(UNKNOWN).cast("long"))).join(meta, "char_id").withColumn("chunk", F.when(F.col("bin") == "dynamic", -1 - F.floor(F.col("char_id") / max(1, size // DYNAMIC))).otherwise(F.floor(F.col("char_id") / size)).cast("long"))


def display_costs(obs: DataFrame, characters: DataFrame, topology: Topology, tcms: dict[int, Tcm] | None = None, reroot: bool = True) -> DataFrame:
    """(display_id, char_id, cost, length): the unweighted cost of each character on each display tree."""
    trees = [t for t, _, _ in topology.display_trees()]
    tcms = tcms or {}

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [character_costs(t, rows, tcms, reroot).assign(display_id=i) for i, t in enumerate(trees)]
        out = pd.concat(parts)
        return out.astype({"char_id": "int32", "display_id": "int32", "cost": float, "length": float})[["display_id", "char_id", "cost", "length"]]

    return _dealt(obs, characters, len(topology.leaves)).groupBy("chunk").applyInPandas(each, "display_id int, char_id int, cost double, length double")


def block_costs(costs: DataFrame, characters: DataFrame, n_roots: int = 1) -> DataFrame:
    """(display_id, block_id, cost, root_cost): weighted costs of blocks, and what further roots cost.

    A further root costs half a character's weight, times the average length
    of a dynamic character.
    """
    meta = characters.select("char_id", "block_id", "bin", "weight")
    joined = costs.join(meta, "char_id")
    per_root = F.col("weight") / 2 * F.when(F.col("bin") == "dynamic", F.col("length")).otherwise(1.0)
    return joined.groupBy("display_id", "block_id").agg(F.sum(F.col("cost") * F.col("weight")).alias("cost"), (F.sum(per_root) * max(0, n_roots - 1)).alias("root_cost"))


def minimal_displays(blocks: DataFrame) -> DataFrame:
    """Of each block the cheapest display tree, the first of equal ones."""
    least = F.min(F.struct((F.col("cost") + F.col("root_cost")).alias("total"), "display_id", "cost", "root_cost")).alias("m")
    return blocks.groupBy("block_id").agg(least).select("block_id", "m.display_id", "m.cost", "m.root_cost")


def most_parsimonious(blocks: DataFrame) -> DataFrame:
    """The display tree with the least sum over blocks, the first of equal ones: (display_id, total)."""
    return blocks.groupBy("display_id").agg(F.sum(F.col("cost") + F.col("root_cost")).alias("total")).orderBy("total", "display_id").limit(1)


def punitive_cost(minima: Iterable[tuple[int, float, frozenset]], best: frozenset, network_edges: Iterable, n_edges: int) -> tuple[float, set]:
    """What a network costs beyond its blocks, and its unused network edges.

    minima: (block, cost, network edges of its display tree). An edge that no
    block uses makes the network infinitely costly. Else each block pays its
    cost times the edges that the overall best display tree lacks, over twice
    the number of edges.
    """
    minima = list(minima)
    used = frozenset().union(*(e for _, _, e in minima)) if minima else frozenset()
    unused = set(network_edges) - used
    if unused:
        return float("inf"), unused
    return sum(cost * len(edges - best) for _, cost, edges in minima) / (2 * n_edges) if n_edges else 0.0, set()


def score(obs: DataFrame, characters: DataFrame, topology: Topology, tcms: dict[int, Tcm] | None = None, reroot: bool = True) -> dict:
    """Total cost of a topology: blocks at their cheapest display trees, network penalty, cost of further roots."""
    displays = list(topology.display_trees())
    blocks = block_costs(display_costs(obs, characters, topology, tcms, reroot), characters, len(topology.roots)).cache()
    try:
        chosen = minimal_displays(blocks).collect()  # one row for each block, that is for each input file
        best = most_parsimonious(blocks).collect()
    finally:
        blocks.unpersist()
    top = displays[best[0].display_id][1] if best else frozenset()
    penalty, unused = punitive_cost([(r.block_id, r.cost, displays[r.display_id][1]) for r in chosen], top, topology.network_edges, len(topology.edges))
    block, root = sum(r.cost for r in chosen), sum(r.root_cost for r in chosen)
    return {"block_cost": block, "root_cost": root, "network_cost": penalty, "total": block + root + penalty, "unused_edges": sorted(unused), "blocks": [(r.block_id, r.display_id, r.cost) for r in sorted(chosen, key=lambda r: r.block_id)]}


def score_pruned(obs: DataFrame, characters: DataFrame, topology: Topology, tcms: dict[int, Tcm] | None = None, reroot: bool = True) -> tuple[Topology, dict]:
    """Network edges that no block uses are pruned and the graph is scored again, until all are used."""
    while True:
        got = score(obs, characters, topology, tcms, reroot)
        if not got["unused_edges"]:
            return topology, got
        topology = topology.pruned(got["unused_edges"]).contracted()
