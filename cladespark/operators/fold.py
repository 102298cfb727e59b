"""Tree passes in the JVM: one row for each character, the tree as a fold over an array of merges.

The observations of a character are gathered into an array with one place for
each leaf (one shuffle, by character), and a higher-order function appends the
inner nodes in post-order. There is no join for each level and no Python. The
array is copied at each append, so this suits trees of up to a few hundred
leaves; `score` walks larger ones in numpy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.functions import intervals, masks
from cladespark.operators.topology import Topology

#: The array of states is copied at each merge, and the places of the leaves are broadcast.
MOST_LEAVES = 4096


class Plan:
    """Places of the nodes of a binary tree: leaves first, then inner nodes in post-order."""

    def __init__(self, tree: Topology):
        inner = [n for n in tree.postorder() if tree.children.get(n)]
        if any(len(tree.children[n]) != 2 for n in inner) or tree.reticulations:
            raise ValueError("a binary tree is needed")
        if len(tree.leaves) > MOST_LEAVES:
            raise ValueError(f"more than {MOST_LEAVES} leaves; operators.score takes larger trees")
        self.tree, self.leaves = tree, tree.leaves
        self.order = [*self.leaves, *inner]
        self.place = {n: i for i, n in enumerate(self.order)}
        self.merges = [tuple(self.place[c] for c in tree.children[n]) for n in inner]
        self.above = {c: p for p, cs in tree.children.items() for c in cs}

    def leaf_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.tree.labels.get(n, str(n)), i) for i, n in enumerate(self.leaves)], "taxon string, place int")

    def merges_column(self) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in self.merges])


def gather(obs: DataFrame, plan: Plan, state: Column, missing: Column, keep: list[str]) -> DataFrame:
    """(keep..., states): the state of each leaf, in the order of the plan; `missing` where there is no row or a null."""
    leaves = F.broadcast(plan.leaf_frame(obs.sparkSession))  # as many rows as the tree has leaves
    rows = obs.join(leaves, "taxon").select(*keep, "place", state.alias("state"), missing.alias("missing"))
    held = rows.groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.struct("place", "state"))).alias("m"), F.first("missing").alias("missing"))
    places = F.sequence(F.lit(0), F.lit(len(plan.leaves) - 1))
    return held.select(*keep, F.transform(places, lambda i: F.coalesce(F.element_at("m", i), F.col("missing"))).alias("states"))


def _post(states: Column, plan: Plan, leaf, merge) -> Column:
    return F.aggregate(plan.merges_column(), F.transform(states, leaf), lambda acc, op: F.array_append(acc, merge(acc[op["l"]], acc[op["r"]])))


def fitch_nodes(obs: DataFrame, tree: Topology, keep: list[str], full: Column) -> DataFrame:
    """(keep..., nodes): state `m` and subtree cost `c` of every node, of obs(taxon, mask)."""
    plan = Plan(tree)

    def merge(a: Column, b: Column) -> Column:
        state, step = masks.fitch(a["m"], b["m"])
        return F.struct(state.alias("m"), (a["c"] + b["c"] + step).alias("c"))

    leaf = lambda s: F.struct(s.alias("m"), F.lit(0).cast("long").alias("c"))
    return gather(obs, plan, F.col("mask"), full, keep).select(*keep, _post(F.col("states"), plan, leaf, merge).alias("nodes"))


def interval_nodes(obs: DataFrame, tree: Topology, keep: list[str], widest: Column) -> DataFrame:
    """(keep..., nodes): range `r` and subtree cost `c` of every node, of obs(taxon, lo, hi)."""
    plan = Plan(tree)

    def merge(a: Column, b: Column) -> Column:
        state, step = intervals.merge(a["r"], b["r"])
        return F.struct(state.alias("r"), (a["c"] + b["c"] + step).alias("c"))

    own = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), intervals.interval(F.col("lo").cast("double"), F.col("hi").cast("double")))
    leaf = lambda s: F.struct(s.alias("r"), F.lit(0.0).alias("c"))
    return gather(obs, plan, own, widest, keep).select(*keep, _post(F.col("states"), plan, leaf, merge).alias("nodes"))


def sankoff_nodes(obs: DataFrame, tree: Topology, keep: list[str], cost: list[list[int]]) -> DataFrame:
    """(keep..., nodes): the cost of each state at every node, of obs(taxon, mask); null masks are all states."""
    plan, n, most = Plan(tree), len(cost), 1 << 40
    rows = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in row]) for row in cost])

    def directed(child: Column) -> Column:
        return F.transform(rows, lambda row: F.least(F.array_min(F.zip_with(row, child, lambda x, y: x + y)), F.lit(most)))

    def leaf(mask: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(0).cast("long")).otherwise(F.lit(most).cast("long")))

    merge = lambda a, b: F.zip_with(directed(a), directed(b), lambda x, y: F.least(x + y, F.lit(most)))
    full = F.lit((1 << n) - 1)
    return gather(obs, plan, F.col("mask"), full, keep).select(*keep, _post(F.col("states"), plan, leaf, merge).alias("nodes"))


def by_node(nodes: DataFrame, tree: Topology, keep: list[str]) -> DataFrame:
    """One row for each node: keep..., node_id, state."""
    plan = Plan(tree)
    ids = F.array(*[F.lit(n) for n in plan.order])
    return nodes.select(*keep, F.posexplode("nodes").alias("place", "state")).select(*keep, F.element_at(ids, F.col("place") + 1).alias("node_id"), "state")


def _places(plan: Plan) -> Column:
    """Of each node in pre-order: its place, its parent's, its children's (-1: none) and its parent's in pre-order."""
    order = list(reversed(plan.order))
    at = {n: i for i, n in enumerate(order)}
    none = (-1, -1)

    def of(n: int) -> Column:
        up = plan.above.get(n)
        left, right = (plan.place[c] for c in plan.tree.children[n]) if plan.tree.children.get(n) else none
        values = {"s": plan.place[n], "p": -1 if up is None else plan.place[up], "l": left, "r": right, "f": -1 if up is None else at[up]}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    return F.array(*[of(n) for n in order])


def fitch_finals(nodes: DataFrame, tree: Topology, keep: list[str], strict: bool = False) -> DataFrame:
    """(keep..., node_id, final) of every node. Roots and leaves keep their preliminary set.

    By default an inner node looks at its parent's preliminary set, in which
    case the third rule gives the parent's set itself; `strict` looks at the
    parent's final set.
    """
    plan = Plan(tree)
    state = lambda i: F.col("nodes")[i]["m"]

    def final(acc: Column, op: Column) -> Column:
        own, left, right = state(op["s"]), state(op["l"]), state(op["r"])
        above = acc[op["f"]] if strict else state(op["p"])
        third = above.bitwiseOR(left.bitwiseOR(right).bitwiseAND(own)) if strict else above
        inner = F.when(above.bitwiseAND(own) == above, above).when(left.bitwiseOR(right) == own, above.bitwiseOR(own)).otherwise(third)
        return F.when((op["p"] < 0) | (op["l"] < 0), own).otherwise(inner)

    return _finals(nodes, plan, keep, final, "bigint")


def interval_finals(nodes: DataFrame, tree: Topology, keep: list[str]) -> DataFrame:
    plan = Plan(tree)
    state = lambda i: F.col("nodes")[i]["r"]

    def final(acc: Column, op: Column) -> Column:
        own = state(op["s"])
        inner = intervals.finalize(acc[op["f"]], own, state(op["l"]), state(op["r"]))
        return F.when((op["p"] < 0) | (op["l"] < 0), own).otherwise(inner)

    return _finals(nodes, plan, keep, final, "struct<lo:double,hi:double>")


def sankoff_finals(nodes: DataFrame, tree: Topology, keep: list[str], cost: list[list[int]]) -> DataFrame:
    """Final sets: at the root the states of least cost, below those that are best for some final state of the parent; leaves keep theirs."""
    plan, n = Plan(tree), len(cost)
    rows = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in row]) for row in cost])
    bits = lambda flags: F.aggregate(F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    def final(acc: Column, op: Column) -> Column:
        own = F.col("nodes")[op["s"]]
        root = bits(F.transform(own, lambda x: x == F.array_min(own)))
        leaf = bits(F.transform(own, lambda x: x == 0))
        above = acc[op["f"]]

        def best(t: Column) -> Column:
            """Whether state t of the child is a best one below some final state of the parent."""
            states = F.sequence(F.lit(0), F.lit(n - 1))
            total = lambda s: F.zip_with(rows[s], own, lambda x, y: x + y)
            return F.exists(states, lambda s: (F.call_function("shiftright", above, s).bitwiseAND(F.lit(1).cast("long")) == 1) & (total(s)[t] == F.array_min(total(s))))

        inner = bits(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), best))
        return F.when(op["p"] < 0, root).when(op["l"] < 0, leaf).otherwise(inner)

    return _finals(nodes, plan, keep, final, "bigint")


def _finals(nodes: DataFrame, plan: Plan, keep: list[str], final, kind: str) -> DataFrame:
    ids = F.array(*[F.lit(n) for n in reversed(plan.order)])
    done = F.aggregate(_places(plan), F.lit(None).cast(f"array<{kind}>"), lambda acc, op: F.when(acc.isNull(), F.array(final(F.array().cast(f"array<{kind}>"), op))).otherwise(F.array_append(acc, final(acc, op))))
    return nodes.select(*keep, F.posexplode(done).alias("place", "final")).select(*keep, F.element_at(ids, F.col("place") + 1).alias("node_id"), "final")
