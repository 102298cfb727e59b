"""Graph operators over edges(dag_id, parent, child): relational, for any number of graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.functions import masks

#: Path lengths double in each round of the closure, so this covers depths of 2**30.
MOST_ROUNDS = 30


def node_kinds(edges: DataFrame) -> DataFrame:
    """(dag_id, node_id, kind) by degrees: leaf, root, network or tree."""
    ends = edges.select("dag_id", F.col("parent").alias("node_id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select("dag_id", F.col("child").alias("node_id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    degrees = ends.groupBy("dag_id", "node_id").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    kind = F.when(F.col("below") == 0, "leaf").when(F.col("above") == 0, "root").when(F.col("above") > 1, "network").otherwise("tree")
    return degrees.select("dag_id", "node_id", kind.alias("kind"))


def network_edges(edges: DataFrame) -> DataFrame:
    """Edges into nodes with several parents."""
    many = edges.groupBy("dag_id", "child").agg(F.count("*").alias("n")).filter("n > 1").select("dag_id", "child")
    return edges.join(many, ["dag_id", "child"], "left_semi").select(*edges.columns)


def leaves(edges: DataFrame) -> DataFrame:
    above = edges.select("dag_id", F.col("parent").alias("child"))
    return edges.select("dag_id", "child").distinct().join(above, ["dag_id", "child"], "left_anti").withColumnRenamed("child", "node_id")


def roots(edges: DataFrame) -> DataFrame:
    below = edges.select("dag_id", F.col("child").alias("parent"))
    return edges.select("dag_id", "parent").distinct().join(below, ["dag_id", "parent"], "left_anti").withColumnRenamed("parent", "node_id")


def ancestor_closure(edges: DataFrame) -> DataFrame:
    """(dag_id, ancestor, node): every pair on a path. The closure is joined with itself, so rounds are logarithmic in the depth."""
    closure = edges.select("dag_id", F.col("parent").alias("ancestor"), F.col("child").alias("node")).distinct()
    before = closure.count()
    for _ in range(MOST_ROUNDS):
        longer = closure.alias("a").join(closure.alias("b"), (F.col("a.dag_id") == F.col("b.dag_id")) & (F.col("a.node") == F.col("b.ancestor")))
        closure = closure.unionByName(longer.select("a.dag_id", "a.ancestor", "b.node")).distinct()
        if edges.sparkSession.conf.get("spark.checkpoint.dir", None) or edges.sparkSession.sparkContext.getCheckpointDir():
            closure = closure.checkpoint()
        else:
            closure = closure.cache()
        if (now := closure.count()) == before:
            break
        before = now
    return closure


def candidate_network_edges(edges: DataFrame, include_root: bool = False) -> DataFrame:
    """(dag_id, src1, tgt1, src2, tgt2): ordered pairs of edges between which a network edge can be put, first to second.

    Neither edge starts at a root (or, if roots are allowed, not both do); the
    second is not incident to a network node; sources differ and neither edge
    lies above the other, also by way of the other parent of a network node
    above it. The graphs are driver-sized, so the self join is of edges alone.
    """
    closure = ancestor_closure(edges)
    tops = roots(edges).select(F.col("dag_id").alias("rd"), F.col("node_id").alias("r"))
    marked = edges.join(tops, (F.col("dag_id") == F.col("rd")) & (F.col("parent") == F.col("r")), "left").select("dag_id", "parent", "child", F.col("r").isNotNull().alias("top"))
    many = edges.groupBy("dag_id", "child").agg(F.count("*").alias("n"), F.min("parent").alias("p1"), F.max("parent").alias("p2")).filter("n > 1")
    nets = many.select("dag_id", F.col("child").alias("net"), "p1", "p2")
    incident = nets.select(F.col("dag_id").alias("nd"), F.col("net").alias("v"))
    touches = edges.join(incident, (F.col("dag_id") == F.col("nd")) & ((F.col("child") == F.col("v")) | (F.col("parent") == F.col("v"))), "left_semi").select(F.col("dag_id").alias("td"), F.col("parent").alias("tp"), F.col("child").alias("tc"))
    a = marked.select("dag_id", F.col("parent").alias("src1"), F.col("child").alias("tgt1"), F.col("top").alias("top1"))
    b = marked.select(F.col("dag_id").alias("bd"), F.col("parent").alias("src2"), F.col("child").alias("tgt2"), F.col("top").alias("top2"))
    tops_ok = ~(F.col("top1") & F.col("top2")) if include_root else ~F.col("top1") & ~F.col("top2")
    pairs = a.join(b, F.col("dag_id") == F.col("bd")).filter((F.col("src1") != F.col("src2")) & tops_ok)
    pairs = pairs.join(touches, (F.col("dag_id") == F.col("td")) & (F.col("src2") == F.col("tp")) & (F.col("tgt2") == F.col("tc")), "left_anti")

    def without(df: DataFrame, ancestor: str, node: str, above: DataFrame) -> DataFrame:
        x = above.select(F.col("dag_id").alias("d"), F.col("ancestor").alias("x"), F.col("node").alias("y"))
        return df.join(x, (F.col("dag_id") == F.col("d")) & (F.col(ancestor) == F.col("x")) & (F.col(node) == F.col("y")), "left_anti")

    pairs = without(pairs, "tgt1", "src2", closure)
    pairs = without(pairs, "src2", "src1", closure)
    # Nodes implied to be as old: above the other parent of a network node, one of whose parents is above the source.
    other = nets.select("dag_id", F.col("p1").alias("one"), F.col("p2").alias("two")).unionByName(nets.select("dag_id", F.col("p2").alias("one"), F.col("p1").alias("two")))
    implied = closure.alias("c").join(other.alias("o"), (F.col("c.dag_id") == F.col("o.dag_id")) & (F.col("c.ancestor") == F.col("o.one"))).join(closure.alias("e"), (F.col("e.dag_id") == F.col("o.dag_id")) & (F.col("e.node") == F.col("o.two"))).select("c.dag_id", F.col("e.ancestor").alias("ancestor"), F.col("c.node").alias("node")).distinct()
    pairs = without(pairs, "tgt1", "src2", implied)
    pairs = without(pairs, "tgt2", "src1", implied)
    # A source that is a parent of a network node, whose other parent lies above the other edge's target.
    away = other.alias("o").join(closure.alias("c"), (F.col("c.dag_id") == F.col("o.dag_id")) & (F.col("c.ancestor") == F.col("o.two"))).select("o.dag_id", F.col("o.one").alias("ancestor"), "c.node").distinct()
    pairs = without(pairs, "src2", "tgt1", away)
    into = nets.select("dag_id", "net", F.col("p1").alias("one"), F.col("p2").alias("two")).unionByName(nets.select("dag_id", "net", F.col("p2").alias("one"), F.col("p1").alias("two")))
    bad = into.alias("o").join(closure.alias("c"), (F.col("c.dag_id") == F.col("o.dag_id")) & (F.col("c.ancestor") == F.col("o.two"))).select(F.col("o.dag_id").alias("d"), F.col("o.one").alias("x"), F.col("o.net").alias("y"), F.col("c.node").alias("z"))
    pairs = pairs.join(bad, (F.col("dag_id") == F.col("d")) & (F.col("src1") == F.col("x")) & (F.col("tgt1") == F.col("y")) & (F.col("tgt2") == F.col("z")), "left_anti")
    return pairs.select("dag_id", "src1", "tgt1", "src2", "tgt2")


def _next_id(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dag_id").agg((F.max(F.greatest("parent", "child")) + 1).alias("free"))


def insert_leaf(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Split the edge that targets(dag_id, parent, child) names in each graph by a node with a new leaf."""
    hit = edges.join(targets, ["dag_id", "parent", "child"], "left_semi").join(_next_id(edges), "dag_id")
    new = F.explode(F.array(F.struct("parent", F.col("free").alias("child")), F.struct(F.col("free").alias("parent"), F.col("child")), F.struct(F.col("free").alias("parent"), (F.col("free") + 1).alias("child")))).alias("e")
    return edges.join(targets, ["dag_id", "parent", "child"], "left_anti").select("dag_id", "parent", "child").unionByName(hit.select("dag_id", new).select("dag_id", "e.parent", "e.child"))


def connect_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Split both edges of pairs(dag_id, src1, tgt1, src2, tgt2) and join the new nodes by an edge, first to second."""
    placed = pairs.join(_next_id(edges), "dag_id")
    s, t = F.col("free"), F.col("free") + 1
    link = lambda a, b: F.struct(a.alias("parent"), b.alias("child"))
    rows = F.array(link(F.col("src1"), s), link(s, F.col("tgt1")), link(F.col("src2"), t), link(t, F.col("tgt2")), link(s, t))
    gone = pairs.select("dag_id", F.col("src1").alias("parent"), F.col("tgt1").alias("child")).unionByName(pairs.select("dag_id", F.col("src2").alias("parent"), F.col("tgt2").alias("child")))
    return edges.join(gone, ["dag_id", "parent", "child"], "left_anti").select("dag_id", "parent", "child").unionByName(placed.select("dag_id", F.explode(rows).alias("e")).select("dag_id", "e.parent", "e.child"))


def prune_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["dag_id", "parent", "child"], "left_anti").select(*edges.columns)


def contract_ids(edges: DataFrame) -> DataFrame:
    """(dag_id, node_id, new_id): nodes renumbered from 0 without gaps, in their order."""
    nodes = edges.select("dag_id", F.col("parent").alias("node_id")).unionByName(edges.select("dag_id", F.col("child").alias("node_id"))).distinct()
    return nodes.withColumn("new_id", F.row_number().over(Window.partitionBy("dag_id").orderBy("node_id")) - 1)


def disjoint_products(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of resolutions(keys, resolution_id, leaves, cost) that share no leaf: a parent's resolutions."""
    a = left.select(*keys, F.col("resolution_id").alias("left_id"), F.col("leaves").alias("ll"), F.col("cost").alias("lc"))
    b = right.select(*keys, F.col("resolution_id").alias("right_id"), F.col("leaves").alias("rl"), F.col("cost").alias("rc"))
    joined = a.join(b, keys) if keys else a.join(b)
    return joined.filter(masks.disjoint(F.col("ll"), F.col("rl"))).select(*keys, "left_id", "right_id", F.col("ll").bitwiseOR(F.col("rl")).alias("leaves"), (F.col("lc") + F.col("rc")).alias("cost"))


def soft_wired(left: DataFrame, right: DataFrame, keys: list[str], left_network: bool = False, right_network: bool = False) -> DataFrame:
    """Resolutions of a node with two children: disjoint pairs, and either side alone where the other is a network child."""
    none = F.lit(None).cast("long")
    out = disjoint_products(left, right, keys).withColumns({"left_id": F.col("left_id").cast("long"), "right_id": F.col("right_id").cast("long")})
    if right_network:
        out = out.unionByName(left.select(*keys, F.col("resolution_id").cast("long").alias("left_id"), none.alias("right_id"), "leaves", "cost"))
    if left_network:
        out = out.unionByName(right.select(*keys, none.alias("left_id"), F.col("resolution_id").cast("long").alias("right_id"), "leaves", "cost"))
    return out


def covering(resolutions: DataFrame, full: Column) -> DataFrame:
    """Resolutions that hold every leaf."""
    return resolutions.filter(F.col("leaves") == full)


def compatible(included_a: Column, excluded_a: Column, included_b: Column, excluded_b: Column) -> Column:
    """Two topologies can hold together: neither has an edge that the other lacks."""
    return ~F.coalesce(F.arrays_overlap(included_a, excluded_b), F.lit(False)) & ~F.coalesce(F.arrays_overlap(included_b, excluded_a), F.lit(False))


def punitive_costs(minima: DataFrame, best: DataFrame, network: DataFrame, n_edges: DataFrame) -> DataFrame:
    """(dag_id, penalty, unused) of minima(dag_id, block_id, cost, edges), best(dag_id, edges), network(dag_id, edges), n_edges(dag_id, n).

    `edges` are arrays of edge names. Unused network edges make the penalty infinite.
    """
    used = minima.select("dag_id", F.explode_outer("edges").alias("e")).groupBy("dag_id").agg(F.collect_set("e").alias("used"))
    top = best.select("dag_id", F.col("edges").alias("top"))
    paid = minima.join(top, "dag_id").groupBy("dag_id").agg(F.sum(F.col("cost") * F.size(F.array_except("edges", "top"))).alias("paid"))
    joined = network.select("dag_id", F.col("edges").alias("all")).join(used, "dag_id").join(paid, "dag_id").join(n_edges, "dag_id")
    unused = F.array_sort(F.array_except("all", "used"))
    return joined.select("dag_id", F.when(F.size(unused) > 0, F.lit(float("inf"))).otherwise(F.col("paid") / (2 * F.col("n"))).alias("penalty"), unused.alias("unused"))
