"""Generators of data sets, sequences and cost matrices, and small utilities over trees and FASTC."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.operators.tcm import Tcm
from cladespark.operators.topology import Topology

FAMILIES = ("discrete", "L1", "1-2", "2-1", "hamming", "levenshtein")


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def make_tcm(symbols: Sequence[str], family: str) -> Tcm:
    """Cost matrix of a family over symbols and the gap, which costs twice the largest other cost in the string families."""
    n = len(symbols)
    if family == "discrete":
        return Tcm.generate(n + 1, lambda i, j: int(i != j))
    if family == "L1":
        return Tcm.generate(n + 1, lambda i, j: abs(i - j))
    if family in ("1-2", "2-1"):
        change, gap = (1, 2) if family == "1-2" else (2, 1)
        return Tcm.generate(n + 1, lambda i, j: 0 if i == j else gap if n in (i, j) else change)
    if family not in FAMILIES:
        raise ValueError(f"no family {family}")
    metric = levenshtein if family == "levenshtein" else lambda a, b: sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
    table = [[metric(a, b) for b in symbols] for a in symbols]
    gap = 2 * max((x for row in table for x in row), default=1)
    return Tcm.of([[*row, gap] for row in table] + [[gap] * n + [0]])


def random_tree(n: int, seed: int = 0, label: str = "T") -> Topology:
    """A random binary tree of n leaves."""
    rng = random.Random(seed)
    tree = Topology.nested((f"{label}0", f"{label}1")) if n > 1 else Topology.nested(f"{label}0")
    for i in range(2, n):
        tree = tree.insert_leaf(rng.choice(tree.edges), f"{label}{i}")
    return tree


def random_sequences(spark: SparkSession, n: int, length: int, symbols: str = "ACGT", seed: int = 0) -> DataFrame:
    """(taxon, sequence): n random sequences, made where they are needed from the row's number."""
    alphabet = F.array(*[F.lit(c) for c in symbols])
    site = lambda i: F.element_at(alphabet, (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(symbols))) + 1).cast("int"))
    return spark.range(n).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("taxon"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), site), "").alias("sequence"))


def evolve(tree: Topology, length: int, symbols: str = "ACGT", change: float = 0.1, insert: float = 0.02, delete: float = 0.02, seed: int = 0) -> dict[str, str]:
    """Sequences of the leaves after substitutions, insertions and deletions along the edges of the tree."""
    rng = random.Random(seed)
    (root,) = tree.roots
    state = {root: "".join(rng.choice(symbols) for _ in range(length))}
    for n in reversed(tree.postorder()):
        for c in tree.children.get(n, ()):
            out = []
            for s in state[n]:
                if rng.random() < insert:
                    out.append(rng.choice(symbols))
                if rng.random() >= delete:
                    out.append(rng.choice(symbols) if rng.random() < change else s)
            state[c] = "".join(out) or rng.choice(symbols)
    return {tree.labels[n]: state[n] for n in tree.leaves}


def data_set(n: int, length: int, seed: int = 0) -> tuple[str, str, str]:
    """Newick, vertex-edge-root and FASTA texts of one random data set."""
    tree = random_tree(n, seed)
    name = {x: tree.labels.get(x, f"N{x}") for x in tree.nodes}
    ver = "{" + ", ".join(name.values()) + "}\n{" + ", ".join(f"({name[p]}, {name[c]})" for p, c in tree.edges) + "}\n{" + ", ".join(name[r] for r in tree.roots) + "}\n"
    fasta = "".join(f">{t}\n{s}\n" for t, s in sorted(evolve(tree, length, seed=seed).items()))
    return tree.newick() + "\n", ver, fasta


def resolutions(tree: Topology) -> Iterator[Topology]:
    """Every binary tree that resolves the nodes with more than two children."""
    wide = next((n for n, cs in tree.children.items() if len(cs) > 2), None)
    if wide is None:
        yield tree
        return
    below = tree.children[wide]
    free = max(tree.nodes) + 1
    for k in range(1, 1 << (len(below) - 1)):
        left = tuple(c for i, c in enumerate(below) if not (i and k >> (i - 1) & 1))
        right = tuple(c for i, c in enumerate(below) if i and k >> (i - 1) & 1)
        children, at, ends = dict(tree.children), free, []
        for part in (left, right):
            if len(part) == 1:
                ends.append(part[0])
            else:
                children[at] = part
                ends.append(at)
                at += 1
        children[wide] = tuple(ends)
        yield from resolutions(Topology(children, tree.labels))


def reduce_fastc(taxa: dict[str, list[tuple[str, ...]]], keep: int) -> dict[str, list[tuple[str, ...]]]:
    """Only the `keep` most frequent symbols stay; sites without any go."""
    seen = Counter(s for sites in taxa.values() for site in sites for s in site)
    kept = {s for s, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:keep]}
    return {t: [tuple(s for s in site if s in kept) for site in sites if kept & set(site)] for t, sites in taxa.items()}


def fasta_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (taxon, sequence) of either side that the other lacks or has differently."""
    a, b = left.withColumnRenamed("sequence", "left"), right.withColumnRenamed("sequence", "right")
    return a.join(b, "taxon", "full").filter(~F.col("left").eqNullSafe(F.col("right")))
