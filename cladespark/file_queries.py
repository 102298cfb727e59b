"""Registered queries of parsers, writers and small operators, each over a whole table.

Parts are dealt to files of FILE keys in a row, so there are as many files as
the table needs and none grows with it; a file is one text, parsed in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.file_oracles import FILE
from cladespark.functions import masks
from cladespark.operators import aggregates, fold, graphs, kernels, score, unify
from cladespark.operators.tcm import Tcm
from cladespark.operators.topology import Topology
from cladespark.oracles import DNA_COSTS
from cladespark.sources import dispatch
from cladespark.sources.dot import parse_dot
from cladespark.sources.fasta import parse_fastc
from cladespark.sources.newick import parse_newick
from cladespark.sources.nexus import parse_nexus
from cladespark.sources.tcm_file import parse_tcm
from cladespark.sources.tnt import parse_tnt
from cladespark.sources.ver import parse_ver


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.withColumn("file", F.floor(F.col("p_partkey") / FILE)).withColumn("taxon", F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")))


def _files(parts: DataFrame, line: Column, head: Column | str = "", tail: Column | str = "", backwards: bool = False) -> DataFrame:
    """(file, text): a line for each part in the order of the keys, or against it."""
    lines = F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line"))), asc=not backwards)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return parts.groupBy("file").agg(F.concat(lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), ""), lit(tail)).alias("text"))


def _parsed(files: DataFrame, parse: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """file and what parse(text) gives of it."""
    names = ["file", *[x.split()[0] for x in schema.split(", ")]]

    def each(batches):
        for batch in batches:
            yield pd.DataFrame([(f, *row) for f, text in zip(batch.file, batch.text, strict=True) for row in parse(text)], columns=names)

    return files.mapInPandas(each, f"file long, {schema}")


def _sites(name: str = "p_name") -> Column:
    """Letters of a name as nucleotides."""
    return F.translate(name, "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACG")


def _edge_rows(tree: Topology) -> list[tuple]:
    return [(tree.labels[p], tree.labels[c]) for p, c in tree.edges]


def _heap_edges(parts: DataFrame) -> DataFrame:
    """The parts of a file as a heap tree: place k (from 1) is below place k div 2."""
    return parts.withColumn("place", F.col("p_partkey") % FILE + 1).withColumn("above", F.floor(F.col("place") / 2))


def fastc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the names as symbols, the last ones as an ambiguity group with the size."""
    line = F.concat(F.lit(">"), "taxon", F.lit("\n"), F.regexp_replace("p_name", r" (\S+)$", " [$1"), F.lit(" s"), F.col("p_size").cast("string"), F.lit("]\n"))
    parse = lambda text: [(t, i, "|".join(site)) for t, sites in parse_fastc(text).items() for i, site in enumerate(sites)]
    return _parsed(_files(_parts(spark, sf_dir), line), parse, "taxon string, site int, symbols string")


def gap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that are left of unaligned sequences in which every A is a gap; null where none is."""
    line = F.concat(F.lit(">"), "taxon", F.lit("\n"), F.translate(_sites(), "A", "-"), F.lit("\n"))

    def parse(text: str):
        (c,) = dispatch.without_gaps(dispatch.from_fasta(text, "x.fasta", "dna")).characters
        return [(t, None if v is None else "".join(s[0] for s in v)) for t, v in c.values.items()]

    return _parsed(_files(_parts(spark, sf_dir), line), parse, "taxon string, sequence string")


def prealigned_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sites of each name, each a character of its own."""
    line = F.concat(F.lit(">"), "taxon", F.lit("\n"), F.substring(_sites(), 1, 6), F.lit("\n"))

    def parse(text: str):
        source = dispatch.expand_aligned(dispatch.from_fasta(text, "x.fasta", "dna"))
        return [(t, i, "".join(v)) for i, c in enumerate(source.characters) for t, v in c.values.items()]

    return _parsed(_files(_parts(spark, sf_dir), line), parse, "taxon string, site int, state string")


def nexus_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, brand and type of a part as three states of a standard matrix; a size that 5 divides is missing."""
    rows = _parts(spark, sf_dir)
    size = F.when(F.col("p_size") % 5 == 0, "?").otherwise((F.col("p_size") % 5).cast("string"))
    line = F.concat(F.lit("  "), "taxon", F.lit(" "), size, (F.length("p_brand") % 4).cast("string"), (F.length("p_type") % 5).cast("string"), F.lit("\n"))
    head = F.concat(F.lit("#NEXUS\nbegin data;\n dimensions ntax="), F.count("*").cast("string"), F.lit(' nchar=3;\n format datatype=standard symbols="01234" missing=? gap=-;\n matrix\n'))

    def parse(text: str):
        return [(t, i, None if v is None else "".join(v)) for i, c in enumerate(parse_nexus(text, "x.nex").characters) for t, v in c.values.items()]

    return _parsed(_files(rows, line, head, "  ;\nend;\n"), parse, "taxon string, site int, state string")


def _tnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against the order of the names; the tree names the leaves by number."""
    rows = _parts(spark, sf_dir)
    line = F.concat("taxon", F.lit(" "), (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 7).cast("string"), F.lit("?\n"))
    head = F.concat(F.lit("xread\n'parts'\n3 "), F.count("*").cast("string"), F.lit("\n"))
    numbers = F.sequence(F.lit(1), F.count("*").cast("int") - 1)
    comb = F.when(F.count("*") > 1, F.aggregate(numbers, F.lit("0"), lambda acc, x: F.concat(F.lit("("), acc, F.lit(" "), x.cast("string"), F.lit(")")))).otherwise(F.lit("(0)"))
    return _files(rows, line, head, F.concat(F.lit(";\ncc - .;\ntread "), comb, F.lit(";\nproc /;\n")), backwards=True)


def tnt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = lambda text: [(t, i, None if v is None else "".join(v)) for i, c in enumerate(parse_tnt(text).characters) for t, v in c.values.items()]
    return _parsed(_tnt(spark, sf_dir), parse, "taxon string, site int, state string")


def tnt_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of nodes above each leaf of a comb whose leaf numbers count the sorted names."""

    def parse(text: str):
        (tree,) = parse_tnt(text).forests
        above = tree.ancestors() if callable(tree.ancestors) else tree.ancestors
        return [(tree.labels[n], len(set(above[n]) - {n})) for n in tree.leaves]

    return _parsed(_tnt(spark, sf_dir), parse, "taxon string, depth int")


def tnt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the second character of each file on its comb."""

    def parse(text: str):
        source = parse_tnt(text)
        (tree,), c = source.forests, source.characters[1]
        leaves = {n: pd.array([c.alphabet.encode(c.values[tree.labels[n]])]).to_numpy() for n in tree.leaves}
        cost = score.static_pass(tree, leaves, kernels.Fitch().merge)[1]
        return [(int(pd.Series(cost).iloc[0]) if len(leaves) > 1 else 0,)]

    return _parsed(_tnt(spark, sf_dir), parse, "cost long")


def ver_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _heap_edges(_parts(spark, sf_dir))
    places = F.sort_array(F.collect_list("place"))
    names = F.array_join(F.transform(places, lambda x: F.concat(F.lit("n"), x.cast("string"))), ", ")
    edges = F.array_join(F.transform(F.filter(places, lambda x: x > 1), lambda x: F.concat(F.lit("(n"), F.floor(x / 2).cast("string"), F.lit(", n"), x.cast("string"), F.lit("):0.5"))), ", ")
    files = rows.groupBy("file").agg(F.concat(F.lit("VertexSet = {"), names, F.lit("}\nEdgeSet = {"), edges, F.lit("}\nRootSet = {n1}\n")).alias("text"))
    return _parsed(files, lambda text: _edge_rows(parse_ver(text)), "parent string, child string")


def dot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _heap_edges(_parts(spark, sf_dir))
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    line = F.when(F.col("place") > 1, F.concat(F.lit("  "), name(F.col("above")), F.lit(" -> "), name(F.col("place")), F.lit(";\n"))).otherwise("")
    labels = F.concat(F.lit("  "), name(F.col("place")), F.lit(' [label="'), name(F.col("place")), F.lit('"];\n'))
    return _parsed(_files(rows, F.concat(labels, line), "digraph g {\n", "}\n"), lambda text: _edge_rows(parse_dot(text)), "parent string, child string")


def newick_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comb of each file's parts, built as a topology and written."""

    def parse(text: str):
        names = text.split()
        tree = names[-1]
        for name in reversed(names[:-1]):
            tree = (name, tree)
        written = Topology.nested(tree).newick()
        (again,) = parse_newick(written)
        return [(written, len(again.leaves))]

    return _parsed(_files(_parts(spark, sf_dir), F.concat("taxon", F.lit("\n"))), parse, "newick string, leaves int")


def unrooted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each file's heap tree without its root, the smaller place first."""

    def parse(text: str):
        places = [int(x) for x in text.split()]
        tree = Topology.of(((k // 2, k, None) for k in places if k > 1), {k: str(k) for k in places}, places if len(places) == 1 else ())
        return [(min(e), max(e)) for e in score.unrooted_edges(tree)]

    return _parsed(_files(_heap_edges(_parts(spark, sf_dir)), F.concat(F.col("place").cast("string"), F.lit("\n"))), parse, "a long, b long")


def tcm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost matrix of two symbols and the gap for each part, with quarters as costs: whole costs and their scale."""
    size = F.col("p_size")
    quarter = lambda x: (x / 4.0).cast("decimal(10,2)").cast("string")
    text = F.concat(F.lit("b a\n0 "), quarter(size), F.lit(" "), quarter(size + 1), F.lit("\n"), quarter(size), F.lit(" 0 2\n"), quarter(size + 1), F.lit(" 2 0\n"))
    files = _parts(spark, sf_dir).select(F.col("p_partkey").alias("file"), text.alias("text"))

    def parse(text: str):
        alphabet, tcm = parse_tcm(text)
        return [("".join(alphabet.symbols), a, b, tcm.cost[a][b], float(tcm.scale)) for a in range(3) for b in range(3)]

    return _parsed(files, parse, "symbols string, a int, b int, cost long, scale double")


def tcm_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor and the matrix without it, of a matrix of each part's size."""
    files = _parts(spark, sf_dir).select(F.col("p_partkey").alias("file"), F.col("p_size").cast("string").alias("text"))

    def parse(text: str):
        n = int(text)
        x, y = (2 * n, 3 * n) if n % 2 == 0 else (3 * n, 2 * n)
        structure, factor, rest = Tcm(((0, x, y), (x, 0, n), (y, n, 0))).diagnose()
        return [(structure, factor, rest.cost[0][1])]

    return _parsed(files, parse, "structure string, factor long, first long")


def full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions of an order's item pairs that hold the leaves of both halves of the suppliers."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    leaves = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("l_suppkey") % 2).cast("int"))
    sets = items.groupBy(F.col("l_orderkey").alias("dag_id"), F.col("l_returnflag").alias("resolution_id")).agg(F.bit_or(leaves).alias("leaves"), F.min("l_quantity").alias("cost"))
    return graphs.covering(sets, masks.full_mask(2))


def compatible_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order and the one after it can hold together: included are its R lines, excluded its A lines."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")))
    sets = items.groupBy("l_orderkey").agg(lines("R").alias("i"), lines("A").alias("x"))
    after = sets.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("i").alias("i2"), F.col("x").alias("x2"))
    return sets.join(after, "l_orderkey").select("l_orderkey", graphs.compatible(F.col("i"), F.col("x"), F.col("i2"), F.col("x2")).alias("together"))


def average_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of the names of a brand, from sums and counts by type."""
    sums = _parts(spark, sf_dir).groupBy("p_brand", "p_type").agg(F.sum(F.length("p_name")).alias("s"), F.count("*").alias("n"))
    return aggregates.average(sums, ["p_brand"], "s", "n")


def leaf_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaves with the number of their orders as character; null where there is none."""
    leaves = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("taxon"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("taxon")).agg(F.count("*").alias("orders"))
    return unify.attach(leaves, rows)


def graph_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.roots(_file_edges(spark, sf_dir))


def graph_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.leaves(_file_edges(spark, sf_dir))


def _file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heap_edges(_parts(spark, sf_dir)).filter("above > 0").select(F.col("file").alias("dag_id"), F.col("above").alias("parent"), F.col("place").alias("child"))


def sankoff_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the root's states of each part: costs above the least, and the least cost to come from each state."""
    from cladespark import queries

    nodes = fold.sankoff_nodes(queries.discrete(spark, sf_dir, len(DNA_COSTS)), queries.TREE, ["char_id"], DNA_COSTS)
    kernel = kernels.Sankoff(Tcm.of(DNA_COSTS))

    def each(batches):
        for batch in batches:
            if len(batch):
                above, leaving = kernel.extra(pd.DataFrame(batch["root"].tolist()).to_numpy("int64").T)
                for s in range(len(DNA_COSTS)):
                    yield pd.DataFrame({"char_id": batch.char_id, "state": s, "above": above[s], "leaving": leaving[s]})

    return nodes.select("char_id", F.element_at("nodes", -1).alias("root")).mapInPandas(each, "char_id long, state int, above long, leaving long")


def total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's cost over non-additive and additive characters in seven blocks of unequal weights."""
    from cladespark import queries

    obs, chars = queries.mixed_characters(spark, sf_dir)
    got = score.score(obs, chars.withColumn("weight", 1.0 + F.col("block_id")), queries.TREE)
    return spark.createDataFrame([(float(got["block_cost"]), float(got["root_cost"]), float(got["network_cost"]), float(got["total"]))], "block_cost double, root_cost double, network_cost double, total double")


QUERIES = [
    fastc_parse, gap_removal, prealigned_expansion, nexus_parse, tnt_parse, tnt_tree, tnt_score, ver_parse, dot_parse, newick_write, unrooted_edges, tcm_parse, tcm_diagnosis,
    full_coverage, compatible_topologies, average_length, leaf_characters, graph_roots, graph_leaves, sankoff_extra, total_cost,
]
