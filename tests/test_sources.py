"""Parsers, graphs, cost matrices, alphabets, alignment."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladespark.errors import ParseError
from cladespark.functions import alphabets
from cladespark.operators import clustering, kernels, search
from cladespark.operators.alignment import Aligner, encode
from cladespark.operators.score import dynamic_cost, punitive_cost
from cladespark.operators.tcm import Tcm, default_tcm
from cladespark.operators.topology import IllegalNetwork, Topology
from cladespark.sources import dispatch
from cladespark.sources.dot import parse_dot
from cladespark.sources.fasta import parse_fasta, parse_fastc
from cladespark.sources.newick import parse_newick
from cladespark.sources.nexus import parse_nexus
from cladespark.sources.tcm_file import parse_tcm
from cladespark.sources.tnt import parse_tnt
from cladespark.sources.ver import parse_ver
from cladespark.tools import generators


def test_newick_forms():
    (t,) = parse_newick("((A:1,'B b''s':2.5)x:0.5,(C,D)[a comment])root;")
    assert sorted(t.leaf_labels()) == ["A", "B b's", "C", "D"]
    assert sorted(t.lengths.values()) == [0.5, 1, 2.5]
    (net,) = parse_newick("((A,(B)n#H1),(n#H1,C));")
    assert len(net.reticulations) == 1 and len(list(net.display_trees())) == 2
    assert len(parse_newick("<(A,B);(C,D);>")) == 2
    (back,) = parse_newick(net.newick())
    assert len(back.edges) == len(net.edges) and len(back.reticulations) == 1


@pytest.mark.parametrize("text", ["", "(A,B)", "(A,,B);", "((A,B);", "(A,B));", "(a,(b,(a,(b,c))a)b)a;", "(A,B):x;"])
def test_newick_errors(text):
    with pytest.raises(ParseError):
        parse_newick(text)


def test_deep_newick_needs_no_recursion():
    text = "A0"
    for i in range(1, 5000):
        text = f"({text},A{i})"
    (t,) = parse_newick(text + ";")
    assert len(t.leaves) == 5000 and max(t.heights().values()) == 4999


def test_fasta_and_fastc():
    kind, taxa = parse_fasta(">A x\nACGT\nAC\n>B\nacN.#-?\n".replace("AC\n>B", "AC#A\n>B"))
    assert kind == "dna" and len(taxa["A x"]) == 2
    assert taxa["B"][0][2] == ("A", "C", "G", "T") and taxa["B"][0][0] == ("A", "-")
    assert parse_fasta(">A\nACGU\n")[0] == "rna" and parse_fasta(">A\nMKWUF\n")[0] == "amino_acid"
    for bad in (">A\nAC\n>A\nAC\n", "AC\n", ">A\nA1\n", ">A\nAC#A\n>B\nAC\n"):
        with pytest.raises(ParseError):
            parse_fasta(bad)
    assert parse_fastc(">A\na [b c] d\n") == {"A": [("a",), ("b", "c"), ("d",)]}


def test_ver_and_dot():
    t = parse_ver("V={a,b,c} E={(a,b):2,(a,c)} R={a}")
    assert t.roots == [0] and t.lengths == {(0, 1): 2.0}
    assert parse_ver("{a,b,c} {(a,b),(a,c)} {a}").leaves == [1, 2]
    for bad in ("V={a} E={(a,b)} R={a}", "V={a,b} E={(a,b)} R={b}", "V={a,b} E={(a,b),(b,a)} R={}", "{a}"):
        with pytest.raises(ParseError):
            parse_ver(bad)
    d = parse_dot('digraph g { /* c */ 0 -> 1; 0 -> 2 -> 3; 1 [label="Homo sapiens"]; 3 [shape=box, label=B] }')
    assert sorted(d.leaf_labels()) == ["B", "Homo sapiens"] and len(d.edges) == 3


def test_nexus():
    text = """#NEXUS
    begin taxa; dimensions ntax=3; taxlabels A B C; end;
    begin characters; dimensions nchar=4; format datatype=standard symbols="012" missing=? gap=- matchchar=. equate="x=(0 1)";
      charlabels p q r s; matrix
      A 01x?
      B .1{0 2}-
      C 2(12)0 1 ; end;
    begin trees; translate 1 A, 2 B, 3 C; tree t = ((1,2),3); end;
    begin assumptions; wtset w = 2: 1-2; typeset t = ord: 3; exset e = 4; end;"""
    s = parse_nexus(text)
    assert [c.name for c in s.characters] == ["p", "q", "r", "s"]
    assert s.characters[0].values == {"A": ("0",), "B": ("0",), "C": ("2",)}
    assert s.characters[2].values["A"] == ("0", "1") and s.characters[3].values["A"] is None
    assert [c.weight for c in s.characters] == [2, 2, 1, 1] and s.characters[2].ordered and s.characters[3].ignored
    assert sorted(s.forests[0].leaf_labels()) == ["A", "B", "C"]
    inter = parse_nexus("#NEXUS begin data; dimensions ntax=2 nchar=4; format datatype=dna interleave=yes; matrix\nA AC\nB AG\n\nA GT\nB GG\n; end;")
    assert [c.values["B"] for c in inter.characters] == [("A",), ("G",), ("G",), ("G",)]
    for bad in ("begin data; end;", "#NEXUS begin data; dimensions nchar=3; format datatype=dna; matrix\nA AC\nB ACG\n; end;", "#NEXUS begin data; format datatype=dna; matrix\nA A9\n; end;"):
        with pytest.raises(ParseError):
            parse_nexus(bad)


def test_tnt():
    s = parse_tnt("xread 'c' 4 3\nA 01[23]?\nB 1100\nC 0121\n; cc + 0.1; cc /3 2; cc ] 3; cn {0 head big small; ; costs 2 = 0>1 5 0/2 3; tread (A (1 C)) * (0 (B 2)); proc /;")
    assert [c.ordered for c in s.characters] == [True, True, False, False]
    assert [c.weight for c in s.characters] == [1, 1, 3, 1] and s.characters[3].ignored
    assert s.characters[0].name == "head" and s.characters[2].tcm.cost[0][1] == 5 and s.characters[2].tcm.cost[2][0] == 3
    assert len(s.forests) == 2 and sorted(s.forests[1].leaf_labels()) == ["A", "B", "C"]
    for bad in ("xread 2 2 A 01 B 0; proc /;", "xread 2 1\nA 01\n; cc + 5;", "xread 1 1\nA 0\n; tread (0 3);", "proc /;"):
        with pytest.raises(ParseError):
            parse_tnt(bad)


def test_dispatch_prefers_the_extension_then_tries_all():
    assert dispatch.parse(">A\nAC\n", "x.fasta").characters[0].kind == "dynamic"
    assert dispatch.parse("(A,B);", "x.unknown").forests
    assert dispatch.parse("(A,B);", "x.fasta").forests
    with pytest.raises(ParseError):
        dispatch.parse("\x00\x01", "x.fasta")


def test_tcm_file_sorts_and_scales():
    alphabet, tcm = parse_tcm("B A\n0 0.5 1\n0.5 0 1\n1 1 0\n")
    assert alphabet.symbols == ("A", "B", "-") and tcm.cost == ((0, 1, 2), (1, 0, 2), (2, 2, 0))
    for bad in ("A A\n0 1 1\n1 0 1\n1 1 0", "A B\n0 1\n1 0", "A\n0 -1\n1 0", "A B"):
        with pytest.raises(ParseError):
            parse_tcm(bad)


def test_alphabets():
    a = alphabets.Alphabet.of(["b", "a", "?", "-", "b"])
    assert a.symbols == ("a", "b", "-") and a.encode(["b", "-"]) == 6 and a.encode(None) == 7 and a.decode(5) == ("a", "-")
    assert alphabets.iupac("dna")["n"] == ("A", "C", "G", "T", "-") and alphabets.iupac("rna")["Y"] == ("C", "U")


@pytest.mark.parametrize(("family", "structure"), [("discrete", "NonAdditive"), ("L1", "Additive"), ("1-2", "Metric"), ("2-1", "Metric")])
def test_generated_matrices(family, structure):
    assert generators.make_tcm("ACGT", family).diagnose()[0] in (structure, "UltraMetric", "Symmetric")
    assert generators.make_tcm(["ab", "b", "abc"], "levenshtein").cost[0][1] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=12), st.lists(st.integers(1, 15), min_size=1, max_size=12))
def test_alignment_commutes_and_is_bounded(a, b):
    aligner = Aligner(Tcm.of([[0, 2, 1, 2, 4], [2, 0, 2, 1, 4], [1, 2, 0, 2, 4], [2, 1, 2, 0, 4], [4, 4, 4, 4, 0]]))
    (c1, x), (c2, y) = aligner.align(encode(a), encode(b)), aligner.align(encode(b), encode(a))
    assert c1 == c2 and [m for m, _, _ in x] == [m for m, _, _ in y]
    assert max(len(a), len(b)) <= len(x) <= len(a) + len(b)
    assert [e[1] for e in x if e[1]] == a and [e[2] for e in x if e[2]] == b


def test_alignment_is_the_edit_distance_at_unit_costs():
    rng = random.Random(3)
    aligner = Aligner(default_tcm(5))
    for _ in range(60):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30))) for _ in range(2))
        assert aligner.cost([1 << "ACGT".index(c) for c in a], [1 << "ACGT".index(c) for c in b]) == generators.levenshtein(a, b)


def test_alignment_of_missing_and_empty():
    aligner = Aligner(default_tcm(5))
    assert aligner.align(None, None) == (0, None) and aligner.align(encode([1]), None) == (0, [(1, 1, 1)])
    assert aligner.align(encode([16]), encode([1, 2]))[0] == 0
    large = Aligner(default_tcm(10))
    assert large.table is None and large.cost([1, 2, 4], [1, 4]) == 1


def test_display_trees_and_penalty():
    (net,) = parse_newick("((A,(B)n#H1),(n#H1,(C,D)));")
    trees = list(net.display_trees())
    assert all(sorted(t.leaf_labels()) == ["A", "B", "C", "D"] for t, _, _ in trees)
    edges = [next(iter(u)) for _, u, _ in trees]
    assert punitive_cost([(0, 5.0, frozenset([edges[0]]))], frozenset([edges[0]]), edges, 9)[0] == float("inf")
    both = [(0, 5.0, frozenset([edges[0]])), (1, 7.0, frozenset([edges[1]]))]
    assert punitive_cost(both, frozenset([edges[0]]), edges, 9) == (7.0 / 18, set())


def test_cycles_and_too_many_reticulations_are_errors():
    with pytest.raises(IllegalNetwork):
        Topology.of([(0, 1), (1, 2), (2, 1)]).postorder()


def test_rerooting_keeps_the_leaves_and_the_static_cost():
    rng = random.Random(5)
    tree = generators.random_tree(9, 4)
    states = {n: np.array([1 << rng.randrange(4) for _ in range(20)]) for n in tree.leaves}
    from cladespark.operators.score import static_pass, unrooted_edges

    cost = static_pass(tree, states, kernels.Fitch().merge)[1]
    for e in unrooted_edges(tree):
        other = search.rerooted(tree, e)
        assert sorted(other.leaf_labels()) == sorted(tree.leaf_labels())
        assert (static_pass(other, states, kernels.Fitch().merge)[1] == cost).all()


def test_best_root_is_what_scoring_each_rooting_gives():
    tree = generators.random_tree(6, 2)
    sequences = generators.evolve(tree, 12, seed=8)
    coded = {t: [1 << "ACGT".index(c) for c in s] for t, s in sequences.items()}
    aligner = Aligner(default_tcm(5))
    found = search.best_roots(tree, coded, default_tcm(5))
    for edge, cost in found:
        other = search.rerooted(tree, edge)
        assert dynamic_cost(other, {n: encode(coded[other.labels[n]]) for n in other.leaves}, aligner, reroot=False)[0] == cost


def test_implied_alignment_has_equal_rows_that_spell_the_sequences():
    tree = Topology.nested((("A", "B"), ("C", "D")))
    sequences = {"A": [1, 2, 4, 8], "B": [1, 2, 8], "C": [2, 4, 8], "D": [1, 4, 8]}
    rows = search.implied_alignment(tree, sequences, default_tcm(5))
    assert len({len(r) for r in rows.values()}) == 1
    assert search.total_edge_cost(tree, sequences, default_tcm(5)) >= 0


def test_wagner_finds_the_best_of_all_trees_for_few_taxa():
    import pandas as pd

    rng = random.Random(1)
    taxa = [f"t{i}" for i in range(5)]
    base = [1 << rng.randrange(4) for _ in range(30)]
    rows = [(t, c, "nonAdditive", 4, None, base[c] if rng.random() < 0.6 else 1 << rng.randrange(4), None, None, None, 1.0, 0) for t in taxa for c in range(30)]
    frame = pd.DataFrame(rows, columns=["taxon", "char_id", "bin", "symbols", "tcm_id", "mask", "lo", "hi", "seq", "weight", "block_id"])
    matrix = search.Matrix(frame)
    every = [Topology.nested(("t0", "t1"))]
    for t in taxa[2:]:
        every = [x.insert_leaf(e, t) for x in every for e in x.edges]
    best = min(matrix.cost(t) for t in every)
    assert best <= matrix.cost(search.wagner(matrix, taxa)) <= best * 1.1
    net, cost = search.greedy_network(matrix, search.wagner(matrix, taxa), most=1)
    assert cost <= matrix.cost(search.wagner(matrix, taxa))


def test_candidate_edges_agree_with_the_relational_form(spark):
    from cladespark.operators import graphs

    (net,) = parse_newick("((A,(B)n#H1),((n#H1,E),(C,D)));")
    edges = spark.createDataFrame([(0, p, c) for p, c in net.edges], "dag_id int, parent int, child int")
    got = {((r.src1, r.tgt1), (r.src2, r.tgt2)) for r in graphs.candidate_network_edges(edges).collect()}
    assert got == set(search.candidate_edges(net)) and got
    for a, b in got:
        net.connect(a, b).postorder()


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_clusters_keep_all_members(linkage):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(12, 3))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    tree = clustering.agglomerate(d, linkage)
    for groups in ([tree.members], clustering.into_groups(tree, 4), clustering.cut(tree, 0.7)):
        assert sorted(i for g in groups for i in g) == list(range(12))
    assert clustering.cut(tree, 1.0) == [tree.members]


def test_graph_edits():
    tree = Topology.heap(2, lambda i: "ABCD"[i])
    bigger = tree.insert_leaf((2, 4), "E")
    assert sorted(bigger.leaf_labels()) == list("ABCDE")
    net = tree.connect((2, 4), (3, 6))
    assert len(net.reticulations) == 1
    moved = tree.exchange((2, 4), (3, 6))
    assert sorted(moved.leaf_labels()) == list("ABCD") and len(moved.edges) == 6
    whole = tree.substitute({"A": Topology.nested(("x", "y"))})
    assert sorted(whole.leaf_labels()) == ["B", "C", "D", "x", "y"]
    wide = Topology.of([(0, 1), (0, 2), (0, 3)], {1: "a", 2: "b", 3: "c"})
    assert len({t.newick() for t in generators.resolutions(wide)}) == 3


def test_generated_data_sets(spark):
    newick, ver, fasta = generators.data_set(7, 30, seed=1)
    assert sorted(parse_newick(newick)[0].leaf_labels()) == sorted(parse_fasta(fasta)[1])
    assert len(parse_ver(ver).leaves) == 7
    rows = generators.random_sequences(spark, 5, 9, seed=2)
    assert {len(r.sequence) for r in rows.collect()} == {9} and rows.collect() == rows.collect()
    assert generators.fasta_difference(rows, rows).count() == 0
    assert generators.reduce_fastc({"a": [("x",), ("y",)], "b": [("x", "z")]}, 1) == {"a": [("x",)], "b": [("x",)]}


def brute_affine(aligner, a, b, opening):
    """All alignments of short sequences, one step at a time."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j, last):
        if i == len(a) and j == len(b):
            return 0
        found = []
        if i < len(a) and j < len(b):
            found.append(aligner.median(a[i], b[j])[1] + go(i + 1, j + 1, "m"))
        if j < len(b):
            found.append(aligner.median(aligner.gap, b[j])[1] + (last != "a") * opening + go(i, j + 1, "a"))
        if i < len(a):
            found.append(aligner.median(a[i], aligner.gap)[1] + (last != "b") * opening + go(i + 1, j, "b"))
        return min(found)

    return go(0, 0, "m")


def test_affine_gaps_and_three_way():
    from cladespark.operators.alignment import affine_cost, three_way

    rng = random.Random(4)
    aligner = Aligner(Tcm.of([[0, 2, 1, 2, 4], [2, 0, 2, 1, 4], [1, 2, 0, 2, 4], [2, 1, 2, 0, 4], [4, 4, 4, 4, 0]]))
    draw = lambda n: tuple(1 << rng.randrange(4) for _ in range(n))
    for _ in range(60):
        a, b = draw(rng.randint(1, 6)), draw(rng.randint(1, 6))
        for opening in (0, 1, 5):
            assert affine_cost(aligner, a, b, opening) == brute_affine(aligner, a, b, opening)
        assert affine_cost(aligner, a, b, 0) == aligner.cost(a, b)
    for _ in range(10):
        a, b = draw(5), draw(4)
        cost, columns = three_way(aligner, a, b, b)
        assert [x for _, x, _, _ in columns if x != 16] == list(a) and cost == sum(aligner.tcm.median(x, y, z)[1] for _, x, y, z in columns)
        assert three_way(aligner, a, a, a)[0] == 0


def test_wide_alphabets_keep_every_bit(spark):
    """Masks beyond 53 bits stay exact beside missing ones."""
    from cladespark.operators.score import CHARACTERS, OBS, score

    symbols = [str(i) for i in range(60)]
    high = [1 << 59, (1 << 59) | 1, 1 << 58, None]
    obs = spark.createDataFrame([(f"t{i}", 0, m, None, None, None) for i, m in enumerate(high)], OBS)
    chars = spark.createDataFrame([(0, 0, "c", "nonAdditive", 1.0, symbols, None, "x")], CHARACTERS)
    (tree,) = parse_newick("((t0,t1),(t2,t3));")
    assert score(obs, chars, tree)["total"] == 1


def test_pairs_together_cost_what_they_cost_alone():
    import random

    from cladespark.operators.alignment import Aligner
    from cladespark.operators.tcm import Tcm, default_tcm

    rng = random.Random(3)
    general = Tcm.of([[0 if i == j else 1 + (i + 2 * j) % 4 for j in range(5)] for i in range(5)])
    for tcm in (default_tcm(5), general, Tcm.generate(12, lambda i, j: abs(i - j)), default_tcm(70)):
        aligner = Aligner(tcm)
        some = lambda: [rng.randrange(1, 1 << min(tcm.n, 6)) if rng.random() < 0.8 else aligner.gap for _ in range(rng.randrange(9))]  # noqa: B023, E731
        left, right = [some() for _ in range(60)], [some() for _ in range(60)]
        assert aligner.costs(left, right).tolist() == [aligner.cost(x, y) for x, y in zip(left, right, strict=True)]
