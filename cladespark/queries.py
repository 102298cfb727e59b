"""The registered queries of the parsimony engine.

The driver's tables hold no biology, so characters are derived from them, over
whole tables: a character is a part, its taxon one of 16 groups of suppliers,
and its states come from the quantities and prices of the line items. Trees
are full binary ("heap") trees: leaf i is node 16 + i, a parent is half its child.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark import file_queries
from cladespark.functions import intervals, masks
from cladespark.operators import aggregates, distance, fold, graphs, score, search, unify
from cladespark.operators import tcm as tcms
from cladespark.operators.alignment import Aligner
from cladespark.operators.tcm import Tcm
from cladespark.operators.topology import Topology
from cladespark.oracles import DNA_COSTS, FOUR_STATES

LEVELS, STATES = 4, 5
TREE = Topology.heap(LEVELS, lambda i: str(i + (1 << LEVELS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def discrete(spark: SparkSession, sf_dir: str, states: int = STATES) -> DataFrame:
    """obs(taxon, char_id, mask): the quantities of a supplier group's items of a part, modulo the states."""
    items = table(spark, sf_dir, "lineitem")
    state = F.call_function("shiftleft", _long(1), (F.col("l_quantity").cast("long") % states).cast("int"))
    taxon = (F.col("l_suppkey") % (1 << LEVELS) + (1 << LEVELS)).cast("string")
    return items.groupBy(taxon.alias("taxon"), F.col("l_partkey").alias("char_id")).agg(F.bit_or(state).alias("mask"))


def ranges(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """obs(taxon, char_id, lo, hi): the range of a column in a supplier group's items of a part."""
    taxon = (F.col("l_suppkey") % (1 << LEVELS) + (1 << LEVELS)).cast("string")
    return table(spark, sf_dir, "lineitem").groupBy(taxon.alias("taxon"), F.col("l_partkey").alias("char_id")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def widest(obs: DataFrame) -> Column:
    return intervals.interval(F.lit(-score.WIDEST), F.lit(score.WIDEST))


def _fitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fitch_nodes(discrete(spark, sf_dir), TREE, ["char_id"], masks.full_mask(STATES))


def fitch_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitch(spark, sf_dir).select("char_id", F.element_at("nodes", -1)["c"].alias("cost"))


def fitch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fold.by_node(_fitch(spark, sf_dir), TREE, ["char_id"])
    return nodes.select("char_id", F.col("node_id").cast("long").alias("node_id"), F.col("state.m").alias("mask"), F.col("state.c").alias("cost"))


def _finals(df: DataFrame) -> DataFrame:
    return df.select("char_id", F.col("node_id").cast("long").alias("node_id"), F.col("final").alias("mask"))


def fitch_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(fold.fitch_finals(_fitch(spark, sf_dir), TREE, ["char_id"]))


def fitch_final_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(fold.fitch_finals(_fitch(spark, sf_dir), TREE, ["char_id"], strict=True))


def _additive(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    obs = ranges(spark, sf_dir, column)
    return fold.interval_nodes(obs, TREE, ["char_id"], widest(obs))


def additive_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _additive(spark, sf_dir, "l_quantity").select("char_id", F.element_at("nodes", -1)["c"].alias("cost"))


def continuous_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _additive(spark, sf_dir, "l_extendedprice").select("char_id", F.round(F.element_at("nodes", -1)["c"], 2).alias("cost"))


def additive_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = fold.interval_finals(_additive(spark, sf_dir, "l_quantity"), TREE, ["char_id"])
    return final.select("char_id", F.col("node_id").cast("long").alias("node_id"), F.col("final.lo").alias("lo"), F.col("final.hi").alias("hi"))


def _sankoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.sankoff_nodes(discrete(spark, sf_dir, FOUR_STATES), TREE, ["char_id"], DNA_COSTS)


def sankoff_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sankoff(spark, sf_dir).select("char_id", F.array_min(F.element_at("nodes", -1)).alias("cost"))


def sankoff_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(fold.sankoff_finals(_sankoff(spark, sf_dir), TREE, ["char_id"], DNA_COSTS))


def mixed_characters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Non-additive (even) and additive (odd) characters of the parts together."""
    sets = discrete(spark, sf_dir)
    both = sets.select("taxon", (F.col("char_id") * 2).cast("int").alias("char_id"), "mask", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("array<bigint>").alias("seq"))
    span = ranges(spark, sf_dir, "l_quantity")
    both = both.unionByName(span.select("taxon", (F.col("char_id") * 2 + 1).cast("int").alias("char_id"), F.lit(None).cast("long").alias("mask"), "lo", "hi", F.lit(None).cast("array<bigint>").alias("seq")))
    return both, _characters(both)


def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lengths by the vectorised executor: non-additive and additive characters together, one pass each."""
    costs = score.display_costs(*mixed_characters(spark, sf_dir), TREE)
    return costs.select((F.col("char_id") / 2).cast("long").alias("char_id"), F.when(F.col("char_id") % 2 == 0, "nonAdditive").otherwise("additive").alias("bin"), "cost")


def _characters(obs: DataFrame) -> DataFrame:
    kind = F.when(F.col("char_id") % 2 == 0, "nonAdditive").otherwise("additive")
    alphabet = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda i: i.cast("string"))
    return obs.select("char_id").distinct().select("char_id", (F.col("char_id") % 7).alias("block_id"), F.concat(F.lit("c"), "char_id").alias("name"), kind.alias("bin"), F.lit(1.0).alias("weight"), alphabet.alias("alphabet"), F.lit(None).cast("int").alias("tcm_id"), F.lit("lineitem").alias("source"))


def three_way_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the three states that order lines of three suppliers give a part."""
    obs = discrete(spark, sf_dir).withColumn("third", F.col("taxon").cast("int") % 3)
    sets = obs.groupBy("char_id").pivot("third", [0, 1, 2]).agg(F.bit_or("mask")).fillna((1 << STATES) - 1)
    median, cost = masks.discrete_three_way(F.col("0"), F.col("1"), F.col("2"))
    return sets.select("char_id", median.alias("mask"), cost.cast("long").alias("cost"))


def mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each part's brand and size group as a mask, and back."""
    alphabet = F.array(*[F.lit(str(i)) for i in range(10)])
    symbols = F.split(F.concat_ws(",", (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 10).cast("string")), ",")
    coded = table(spark, sf_dir, "part").select("p_partkey", masks.encode(symbols, alphabet).alias("mask"))
    return coded.select("p_partkey", "mask", F.array_join(masks.decode(F.col("mask"), alphabet), ",").alias("symbols"), masks.first_state(F.col("mask")).alias("first"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of three symbols for each part, of all structures: its size gives the costs, some keys skew or void them."""
    places = F.explode(F.sequence(F.lit(0), F.lit(2)))
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tcm_id"), "p_size", places.alias("i")).withColumn("j", places)
    size, key, at = F.col("p_size"), F.col("tcm_id"), F.col("i") + F.col("j")
    skew = F.when((F.col("i") > F.col("j")) & (key % 5 == 0), 1).otherwise(0)
    cost = F.when((F.col("i") == F.col("j")) | (key % 11 == 0), 0).when(at == 1, 1 + size % 3 + skew).when(at == 2, 1 + F.floor(size / 3) % 4).otherwise(1 + F.floor(size / 12) % 3)
    return cells.select("tcm_id", "i", "j", cost.cast("long").alias("cost"))


def tcm_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tcms.structure_frame(_cells(spark, sf_dir)).withColumn("bin", tcms.bin_column(F.col("structure")))


def tcm_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tcms.factor_frame(_cells(spark, sf_dir))


def tcm_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and cost of every pair of state sets that two supplier groups show of a part, under a cost matrix."""
    median, cost = Tcm.of(DNA_COSTS).dense()
    rows = [(a, b, int(median[a, b]), int(cost[a, b])) for a in range(1, 16) for b in range(1, 16)]
    lookup = F.broadcast(spark.createDataFrame(rows, "a long, b long, median long, cost long"))  # 225 rows
    obs = discrete(spark, sf_dir, FOUR_STATES)
    halves = obs.groupBy("char_id").agg(F.bit_or(F.when(F.col("taxon").cast("int") % 2 == 0, F.col("mask"))).alias("a"), F.bit_or(F.when(F.col("taxon").cast("int") % 2 == 1, F.col("mask"))).alias("b")).dropna()
    return halves.join(lookup, ["a", "b"]).select("char_id", "a", "b", "median", "cost")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are customers' nations, characters are orders: cost, weight, kind and length of each."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.when(F.col("o_orderstatus") == "O", "dynamic").otherwise("additive")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("block_id"), kind.alias("bin"), F.floor("o_totalprice").alias("cost"), (1 + F.col("o_orderkey") % 4).cast("double").alias("weight"), (F.col("o_custkey") % 10).cast("double").alias("length"))


def block_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.block_cost(_costs(spark, sf_dir))


def static_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.static_cost(_costs(spark, sf_dir))


def root_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.root_cost(_costs(spark, sf_dir), 3)


def dag_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs are suppliers, roots their parts, resolutions the line items."""
    items = table(spark, sf_dir, "lineitem")
    return aggregates.dag_cost(items.select(F.col("l_suppkey").alias("dag_id"), F.col("l_partkey").alias("root"), F.col("l_quantity").alias("cost")))


def taxon_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_name").substr(-6, 6).alias("taxon")).agg(F.sum(F.col("c_nationkey").cast("long")).alias("customers"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_name").substr(-6, 6).alias("taxon")).agg(F.sum(F.col("s_nationkey").cast("long")).alias("suppliers"))
    parts = table(spark, sf_dir, "part").groupBy(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("taxon")).agg(F.sum(F.col("p_size").cast("long")).alias("parts"))
    return unify.outer_merge([customers, suppliers, parts])


def _taxa(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("taxon")), table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("taxon"))


def missing_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.missing_taxa(*_taxa(spark, sf_dir))


def extra_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, taxa = _taxa(spark, sf_dir)
    return unify.extra_taxa(taxa, leaves)


def duplicate_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.duplicate_taxa(_taxa(spark, sf_dir)[1])


def last_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("source")).agg(F.max("l_quantity").alias("value"))
    return unify.last_wins(rows, ["key"], "source")


def pad_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = discrete(spark, sf_dir)
    padded = unify.pad(obs, obs.select("char_id").distinct())
    return padded.select("taxon", "char_id", F.coalesce("mask", masks.full_mask(STATES)).alias("mask"))


def distance_matrix_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = discrete(spark, sf_dir)
    return distance.discrete_pairs(obs, obs.select("char_id", F.lit(1.0).alias("weight")).distinct())


def distance_matrix_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = ranges(spark, sf_dir, "l_quantity")
    return distance.interval_pairs(obs, obs.select("char_id", F.lit(2.0).alias("weight")).distinct())


def alphabet_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", "")).alias("c")).filter("c <> ''")
    return aggregates.occurrences(letters, "c")


def observed_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = table(spark, sf_dir, "part").select("p_brand", F.filter(F.split("p_name", ""), lambda c: c != "").alias("s"))
    return aggregates.observed_alphabet(letters, ["p_brand"], "s").select("p_brand", F.array_join("alphabet", "").alias("alphabet"))


def most_common_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.most_common(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


def argmin_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.minima_by(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand"], "p_size")


def argmin_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.minima_by(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand"], "p_size", first="p_partkey")


def argmax_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.maxima_by(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand"], "p_size")


def functional_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_partkey").agg(aggregates.depends_on(items, "l_partkey", "l_linestatus").alias("invariant"))


def leaf_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.call_function("shiftleft", _long(1), (F.col("l_suppkey") % 60).cast("int")).alias("leaves"))
    return aggregates.leaf_union(rows, ["l_partkey"], "leaves")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heap graphs of 12 parts each; nodes 9 and 11 have a second parent where the part's size says so."""
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 12).alias("dag_id"), (F.col("p_partkey") % 12 + 1).alias("child"), "p_size")
    tree = parts.filter("child > 1").select("dag_id", F.floor(F.col("child") / 2).alias("parent"), "child")
    second = parts.filter("(child = 9 and p_size % 2 = 0) or (child = 11 and p_size % 3 = 0)")
    return tree.unionByName(second.select("dag_id", F.when(F.col("child") == 9, 5).otherwise(6).cast("long").alias("parent"), "child"))


def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.node_kinds(_edges(spark, sf_dir))


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.network_edges(_edges(spark, sf_dir))


def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the heap tree over all customers: the parent of node n is n div 2."""
    customers = table(spark, sf_dir, "customer")
    edges = customers.filter("c_custkey > 1").select(F.lit(0).alias("dag_id"), F.floor(F.col("c_custkey") / 2).alias("parent"), F.col("c_custkey").alias("child"))
    return graphs.ancestor_closure(edges).select("ancestor", "node")


def candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.candidate_network_edges(_edges(spark, sf_dir))


def insert_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree of the nations' customers, heap-numbered, gets a leaf on the edge into its last node."""
    edges = _nation_trees(spark, sf_dir)
    last = edges.groupBy("dag_id").agg(F.max("child").alias("child"))
    return graphs.insert_leaf(edges, last.select("dag_id", F.floor(F.col("child") / 2).alias("parent"), "child"))


def _nation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("dag_id")).agg(F.count("*").alias("n"))
    nodes = sizes.select("dag_id", F.explode(F.sequence(F.lit(2), F.greatest(F.col("n"), F.lit(2)).cast("long"))).alias("child"))
    return nodes.select("dag_id", F.floor(F.col("child") / 2).alias("parent"), "child")


def connect_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _nation_trees(spark, sf_dir)
    pairs = edges.select("dag_id").distinct().select("dag_id", _long(2).alias("src1"), _long(4).alias("tgt1"), _long(3).alias("src2"), _long(6).alias("tgt2"))
    present = edges.filter("child = 6").select("dag_id")
    return graphs.connect_edges(edges, pairs.join(present, "dag_id", "left_semi"))


def prune_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _nation_trees(spark, sf_dir)
    return graphs.prune_edges(edges, edges.filter("child % 3 = 0").select("dag_id", "parent", "child"))


def contract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _nation_trees(spark, sf_dir).filter("child % 3 <> 0")
    return graphs.contract_ids(edges)


def _resolutions(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") % 2 == side)
    leaves = F.call_function("shiftleft", _long(1), (F.col("l_suppkey") % 8).cast("int"))
    return items.groupBy(F.col("l_orderkey").alias("dag_id"), leaves.alias("leaves")).agg(F.min("l_quantity").alias("cost")).withColumn("resolution_id", F.col("leaves"))


def display_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as resolutions of two children: the pairs that share no leaf."""
    return graphs.disjoint_products(_resolutions(spark, sf_dir, 0), _resolutions(spark, sf_dir, 1), ["dag_id"])


def soft_wired_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.soft_wired(_resolutions(spark, sf_dir, 0), _resolutions(spark, sf_dir, 1), ["dag_id"], right_network=True)


def minimal_display_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are parts, display trees are suppliers: each block's cheapest, the first of equal ones."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("block_id"), F.col("l_suppkey").alias("display_id")).agg(F.sum("l_quantity").alias("cost"), F.lit(0.0).alias("root_cost"))
    return score.minimal_displays(items).select("block_id", "display_id", "cost")


def punitive_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs are suppliers, blocks are ship years, network edges are line numbers that a block's items have."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dag_id"), F.year("l_shipdate").alias("block_id"), F.col("l_linenumber").alias("e"), "l_quantity")
    minima = items.groupBy("dag_id", "block_id").agg(F.sum("l_quantity").alias("cost"), F.collect_set("e").alias("edges"))
    best = items.filter("e <= 2").groupBy("dag_id").agg(F.collect_set("e").alias("edges"))
    network = items.select("dag_id").distinct().withColumn("edges", F.sequence(F.lit(1), F.lit(7)))
    n = items.groupBy("dag_id").agg(F.countDistinct("block_id").alias("n"))
    return graphs.punitive_costs(minima, best, network, n).select("dag_id", "penalty", F.array_join("unused", ",").alias("unused"))


def pairwise_alignment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name aligned to the name of the part before it, at one step for each change, gap or insertion."""
    import pandas as pd

    parts = table(spark, sf_dir, "part")
    pairs = parts.alias("a").join(parts.alias("b"), F.col("a.p_partkey") == F.col("b.p_partkey") + 1).select("a.p_partkey", F.col("a.p_name").alias("x"), F.col("b.p_name").alias("y"))

    def each(batches):
        letters = {c: 1 << i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz ")}
        aligner = Aligner(tcms.default_tcm(len(letters) + 1))
        coded = lambda names: [[letters[c] for c in x] for x in names]
        for batch in batches:
            yield pd.DataFrame({"p_partkey": batch.p_partkey, "cost": aligner.costs(coded(batch.x), coded(batch.y))})

    return pairs.mapInPandas(each, "p_partkey long, cost long")


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names as unaligned sequences of 4 nucleotides: 16 parts in a row are the taxa of one character."""
    codes = F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.call_function("shiftleft", _long(1), (F.ascii(c) % 4).cast("int")))
    key, none = F.col("p_partkey"), F.lit(None)
    obs = table(spark, sf_dir, "part").select(F.lpad((key % 16).cast("string"), 2, "0").alias("taxon"), F.floor(key / 16).cast("int").alias("char_id"), none.cast("long").alias("mask"), none.cast("double").alias("lo"), none.cast("double").alias("hi"), codes.alias("seq"))
    alphabet = F.array(*[F.lit(c) for c in "ACGT-"])
    number = F.col("char_id")
    chars = obs.select("char_id").distinct().select("char_id", number.alias("block_id"), number.cast("string").alias("name"), F.lit("dynamic").alias("bin"), F.lit(1.0).alias("weight"), alphabet.alias("alphabet"), F.lit(0).alias("tcm_id"), F.lit("part").alias("source"))
    return obs, chars


def _comb(obs: DataFrame) -> Topology:
    taxa = [r.taxon for r in obs.select("taxon").distinct().orderBy("taxon").collect()]  # 16 at most
    comb = taxa[-1]
    for t in reversed(taxa[:-1]):
        comb = (t, comb)
    return Topology.nested(comb)


def implied_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of each character's implied alignment on the comb of the taxa, as masks joined by commas."""
    import pandas as pd

    obs, _ = _sequences(spark, sf_dir)
    tree, tcm = _comb(obs), tcms.default_tcm(5)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        aligned = search.implied_alignment(tree, {r.taxon: list(r.seq) for r in rows.itertuples()}, tcm)
        return pd.DataFrame([(int(rows.char_id.iloc[0]), t, len(m), ",".join(map(str, m))) for t, m in aligned.items()], columns=["char_id", "taxon", "columns", "sites"])

    return obs.select("char_id", "taxon", "seq").groupBy("char_id").applyInPandas(each, "char_id int, taxon string, columns int, sites string")


def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each character on the comb: its cost with the root on each edge, and the total over the edges of disambiguated ends."""
    import pandas as pd

    obs, _ = _sequences(spark, sf_dir)
    tree, tcm = _comb(obs), tcms.default_tcm(5)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        sequences = {r.taxon: list(r.seq) for r in rows.itertuples()}
        total = search.total_edge_cost(tree, sequences, tcm)
        return pd.DataFrame([(int(rows.char_id.iloc[0]), a, b, c, total) for (a, b), c in search.best_roots(tree, sequences, tcm)], columns=["char_id", "a", "b", "cost", "edge_total"])

    return obs.select("char_id", "taxon", "seq").groupBy("char_id").applyInPandas(each, "char_id int, a int, b int, cost long, edge_total long")


def dynamic_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct optimization of part names on a comb of the taxa, rooted where each character is cheapest."""
    obs, chars = _sequences(spark, sf_dir)
    tree = _comb(obs)
    return score.display_costs(obs, chars, tree, {0: tcms.default_tcm(5)}).select("char_id", "cost", "length")


def distance_matrix_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, chars = _sequences(spark, sf_dir)
    return distance.all_pairs(obs, chars, {0: tcms.default_tcm(5)})


def _small(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A matrix of 10 groups of nations and 40 of orders: the sum of a cell's prices, modulo 4, is its state, so every order enters."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn("taxon", F.concat(F.lit("N"), F.lpad((F.col("c_nationkey") % 10).cast("string"), 2, "0")))
    state = F.call_function("shiftleft", _long(1), (F.sum(F.col("o_totalprice").cast("long")) % 4).cast("int"))
    obs = joined.groupBy("taxon", (F.col("o_orderkey") % 40).cast("int").alias("char_id")).agg(state.alias("mask"))
    obs = obs.select("taxon", "char_id", "mask", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("array<bigint>").alias("seq"))
    alphabet = F.array(*[F.lit(str(i)) for i in range(4)])
    chars = obs.select("char_id").distinct().select("char_id", (F.col("char_id") % 2).alias("block_id"), F.col("char_id").cast("string").alias("name"), F.lit("nonAdditive").alias("bin"), F.lit(1.0).alias("weight"), alphabet.alias("alphabet"), F.lit(None).cast("int").alias("tcm_id"), F.lit("orders").alias("source"))
    return obs, chars


def wagner_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build(*_small(spark, sf_dir), trajectories=4, seed=1)


def network_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build(*_small(spark, sf_dir), trajectories=2, kind="network", seed=1, most_reticulations=1)


def cluster_upgma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, "upgma")


def cluster_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, "ward")


def _taxon_distances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    pairs = distance_matrix_discrete(spark, sf_dir)
    return pairs, [r.i for r in pairs.select("i").distinct().orderBy("i").collect()]  # 16 taxa at most


def _clusters(spark: SparkSession, sf_dir: str, linkage: str) -> DataFrame:
    from cladespark.operators import clustering

    pairs, taxa = _taxon_distances(spark, sf_dir)
    groups = clustering.into_groups(clustering.agglomerate(distance.as_matrix(pairs, taxa), linkage), 4)
    return spark.createDataFrame([(taxa[i], g) for g, members in enumerate(groups) for i in members], "taxon string, cluster int")


def cluster_single_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage cut at a height: taxa linked by steps of at most that distance."""
    from cladespark.operators import clustering

    pairs, taxa = _taxon_distances(spark, sf_dir)
    tree = clustering.agglomerate(distance.as_matrix(pairs, taxa), "single")
    groups = clustering.cut(tree, 0.9)
    return spark.createDataFrame([(taxa[i], min(taxa[j] for j in members)) for members in groups for i in members], "taxon string, cluster string")


def fasta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA texts made of the brands' part names, taken apart again."""
    from cladespark.sources.fasta import fasta_rows

    record = F.concat(F.lit(">P"), "p_partkey", F.lit("\n"), F.upper(F.regexp_replace("p_name", " ", "\n")), F.lit("\n"))
    texts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(record), "").alias("text"))
    return fasta_rows(texts, "text", ["p_brand"])


def newick_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comb of each brand's parts in Newick, read into edges; one row for each leaf with its depth."""
    import pandas as pd

    from cladespark.sources.newick import parse_newick

    labels = F.array_sort(F.collect_list("p_partkey"))
    text = F.aggregate("labels", F.lit(""), lambda acc, x: F.when(acc == "", x.cast("string")).otherwise(F.concat(F.lit("("), acc, F.lit(","), x.cast("string"), F.lit(")"))))
    trees = table(spark, sf_dir, "part").groupBy("p_brand").agg(labels.alias("labels")).select("p_brand", F.concat(text, F.lit(";")).alias("newick"))

    def each(batches):
        for batch in batches:
            for brand, newick in zip(batch.p_brand, batch.newick, strict=True):
                (tree,) = parse_newick(newick)
                depth = {}
                for n in reversed(tree.postorder()):
                    depth.setdefault(n, 0)
                    for c in tree.children.get(n, ()):
                        depth[c] = depth[n] + 1
                yield pd.DataFrame([(brand, tree.labels[n], depth[n]) for n in tree.leaves], columns=["p_brand", "taxon", "depth"])

    return trees.mapInPandas(each, "p_brand string, taxon string, depth long")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    fitch_length, fitch_states, fitch_final, fitch_final_strict, additive_length, additive_final, continuous_length, sankoff_length, sankoff_final, score_matrix, three_way_median, mask_round_trip,
    tcm_structure, tcm_factor, tcm_median, block_cost, static_cost, root_cost, dag_cost, taxon_outer_merge, missing_taxa, extra_taxa, duplicate_taxa, last_source_wins, pad_missing,
    distance_matrix_discrete, distance_matrix_interval, distance_matrix_dynamic, alphabet_histogram, observed_alphabet, most_common_state, argmin_with_ties, argmin_first, argmax_with_ties, functional_dependency, leaf_sets,
    node_kinds, network_edges, ancestor_closure, candidate_edges, insert_edge, connect_edge, prune_edges, contract_ids, display_products, soft_wired_resolutions, minimal_display_per_block, punitive_cost,
    pairwise_alignment_cost, dynamic_length, implied_alignment, edge_costs, wagner_build, network_build, cluster_single_cut, cluster_upgma, cluster_ward, fasta_parse, newick_parse,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in [*QUERIES, *file_queries.QUERIES]}
