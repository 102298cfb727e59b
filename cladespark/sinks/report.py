"""Reports: data, DOT, XML, distances, implied alignments, metadata; and the ways to write a file."""

from __future__ import annotations

import csv
import io
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.errors import OutputError
from cladespark.functions import masks
from cladespark.functions.alphabets import Alphabet
from cladespark.operators import distance, search
from cladespark.operators.tcm import default_tcm
from cladespark.operators.topology import Topology


def ascii_tree(tree: Topology, width: int = 24) -> str:
    """The graph drawn with lines; a reticulation is drawn below each of its parents."""
    lines: list[str] = []

    def draw(node: int, lead: str, here: str) -> None:
        below = tree.children.get(node, ())
        name = tree.labels.get(node, "")
        lines.append(lead + here + (f' "{name}"' if name else "┐" if below else ""))
        inner = lead + ("│ " if here.startswith("├") else "  " if here else "")
        for k, child in enumerate(below):
            draw(child, inner, "└─" if k == len(below) - 1 else "├─")

    for root in tree.roots:
        draw(root, "", "")
    return "\n".join(lines)


def node_table(tree: Topology) -> str:
    """One line for each node: number, parents, children."""
    parents = tree.parents
    show = lambda xs: "{" + ",".join(map(str, sorted(xs))) + "}"
    rows = [(str(n), show(parents.get(n, ())), show(tree.children.get(n, ()))) for n in sorted(tree.nodes)]
    sizes = [max(len(r[k]) for r in rows) for k in range(3)] if rows else [0, 0, 0]
    return "\n".join([show(tree.roots), *("  " + " ".join(x.ljust(s) for x, s in zip(r, sizes, strict=True)).rstrip() for r in rows)])


# The headings of the report.
def data(graphs: list[Topology], costs: list[dict]) -> str:
    out = ["Solution:", "", "    Forest #0:"]
    for i, tree in enumerate(graphs):
        cost = costs[i] if i < len(costs) else None
        body = []
        if cost:
            body += [f"DAG total cost:           {cost['total']}", f"DAG network edge cost:    {cost['network_cost']}", f"DAG multi-rooting cost:   {cost['root_cost']}", f"DAG character block cost: {cost['block_cost']}", ""]
        body += [*node_table(tree).split("\n"), "", *ascii_tree(tree).split("\n"), "", tree.newick()]
        out += ["", f"        Component #{i}:", "", *("          " + x if x else "" for x in body)]
    return "\n".join(out) + "\n"


def dot(graphs: list[Topology]) -> str:
    """One digraph; leaves show their labels."""
    out, start = ["digraph {"], 0
    for tree in graphs:
        g = tree.renumbered(start)
        start += len(g.nodes)
        out += [f"    {n} [label={_quoted(g.labels[n])}];" for n in g.nodes if n in g.labels]
        out += [f"    {p} -> {c};" for p, c in g.edges]
    return "\n".join([*out, "}"]) + "\n"


def _quoted(label: str) -> str:
    return '"' + label.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot_rows(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(dag_id, dot) of any number of graphs, written by column expressions."""
    links = edges.groupBy("dag_id").agg(F.array_sort(F.collect_list(F.concat_ws(" -> ", F.col("parent").cast("string"), F.col("child").cast("string")))).alias("links"))
    names = labels.filter("label is not null").groupBy("dag_id").agg(F.array_sort(F.collect_list(F.format_string('%d [label="%s"]', "node_id", "label"))).alias("names"))
    both = links.join(names, "dag_id", "left")
    lines = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.col("links"))
    return both.select("dag_id", F.concat(F.lit("digraph {\n    "), F.array_join(lines, ";\n    "), F.lit(";\n}\n")).alias("dot"))


def xml(graphs: list[Topology], costs: list[dict]) -> str:
    out = ["<?xml version='1.0' ?>", "<Solution>", "  <Forest>"]
    for i, tree in enumerate(graphs):
        out.append(f"    <Component number={quoteattr(str(i))}>")
        if i < len(costs):
            out += [f"      <{k}>{costs[i][v]}</{k}>" for k, v in (("Total_cost", "total"), ("Network_edge_cost", "network_cost"), ("Rooting_cost", "root_cost"), ("Block_cost", "block_cost"))]
            out += [f"      <Block number={quoteattr(str(b))} display={quoteattr(str(d))}>{c}</Block>" for b, d, c in costs[i]["blocks"]]
        out += [f"      <Node number={quoteattr(str(n))} kind={quoteattr(tree.kind(n))}>{escape(tree.labels.get(n, ''))}</Node>" for n in tree.nodes]
        out += [f"      <Edge parent={quoteattr(str(p))} child={quoteattr(str(c))} />" for p, c in tree.edges]
        out.append("    </Component>")
    return "\n".join([*out, "  </Forest>", "</Solution>"]) + "\n"


def _table(rows: list[list]) -> str:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    return text.getvalue()


def distance_csv(obs: DataFrame, characters: DataFrame, tcms: dict, taxa: list[str]) -> str:
    """The labels as a header, then a row of numbers for each taxon, without labels."""
    matrix = distance.as_matrix(distance.all_pairs(obs, characters, tcms), taxa)
    return _table([taxa, *[[float(x) for x in row] for row in matrix]])


def distance_rows(pairs: DataFrame, taxa: list[str]) -> DataFrame:
    """The same as a DataFrame: a row for each taxon, a column for each taxon."""
    return pairs.groupBy("i").pivot("j", taxa).agg(F.sum("distance"))


def metadata_csv(rows: list[tuple]) -> str:
    return _table([["Character Name", "Source", "Type", "TCM Source"], *map(list, rows)])


def dynamic_table(obs: DataFrame, characters: DataFrame, tcms: dict, tree: Topology) -> str:
    """Costs of the dynamic characters with their best root edges."""
    out = [["Character", "Cost", "Root edge"]]
    for name, tcm, sequences in _dynamic(obs, characters, tcms):
        edge, cost = search.best_roots(tree, sequences, tcm)[0]
        out.append([name, cost, f"{edge[0]}-{edge[1]}"])
    return _table(out)


def _dynamic(obs: DataFrame, characters: DataFrame, tcms: dict):
    meta = characters.filter("bin = 'dynamic'").orderBy("char_id").collect()
    for c in meta:
        rows = obs.filter(F.col("char_id") == c.char_id).select("taxon", "seq").collect()
        yield c.name, tcms.get(c.tcm_id) or default_tcm(len(c.alphabet)), {r.taxon: masks.unpacked(r.seq, len(c.alphabet)) for r in rows}


def implied_alignments(obs: DataFrame, characters: DataFrame, tcms: dict, tree: Topology) -> dict[str, str]:
    """FASTA of the implied alignment of each dynamic character, by its name."""
    names = {c.name: c.alphabet for c in characters.filter("bin = 'dynamic'").collect()}
    out = {}
    for name, tcm, sequences in _dynamic(obs, characters, tcms):
        alphabet = Alphabet(tuple(names[name]))
        rows = search.implied_alignment(tree, sequences, tcm)
        show = lambda m: alphabet.decode(m)[0] if len(alphabet.decode(m)) == 1 else "[" + "".join(alphabet.decode(m)) + "]"
        out[name] = "".join(f">{t}\n{''.join(show(m) for m in sites)}\n" for t, sites in sorted(rows.items()))
    return out


def write(spark: SparkSession, path: str, text: str, mode: str = "move") -> str:
    """Write a text: over the file, to its end, or after moving an existing file to the next free number.

    Hadoop's file systems are used, so the path may be in any store that Spark knows.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        parent = where.getParent()
        if parent is not None and not system.exists(parent):
            raise OutputError(f"{path}: the folder does not exist")
        old = ""
        if system.exists(where):
            if mode == "append":
                rows = spark.read.text(path, wholetext=True).collect()
                old = rows[0].value if rows else ""
            elif mode == "move":
                taken = [s.getPath().getName() for s in system.listStatus(parent)]
                numbers = [int(n[len(where.getName()) + 1 :]) for n in taken if n.startswith(where.getName() + ".") and n[len(where.getName()) + 1 :].isdigit()]
                system.rename(where, jvm.org.apache.hadoop.fs.Path(f"{path}.{max(numbers, default=-1) + 1}"))
        stream = system.create(where, True)
        stream.write(bytearray((old + text).encode()))
        stream.close()
    except OutputError:
        raise
    except Exception as e:
        raise OutputError(f"{path}: cannot be written: {str(e).splitlines()[0]}") from None
    return path
