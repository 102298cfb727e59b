"""Known exact costs of small data sets, through the script language."""

import pytest

from cladespark.plans.session import Session

G2T2 = "A C G T\n0 2 1 2 4\n2 0 2 1 4\n1 2 0 2 4\n2 1 2 0 4\n4 4 4 4 0\n"
G4T4 = "A C G T\n0 4 1 4 16\n4 0 4 1 16\n1 4 0 4 16\n4 1 4 0 16\n16 16 16 16 0\n"
NAMES = ["Alpha", "Bravo", "Charlie", "Delta", "Echo", "Foxtrot", "Golf", "Hotel", "India"]


def tnt(rows, tree, code="cc + .;", head=""):
    n = len(rows[0][1].split()) if "." in rows[0][1] else len(rows[0][1])
    body = "\n".join(f"{t} {v}" for t, v in rows)
    return f"{head}xread\n'x'\n{n} {len(rows)}\n{body}\n;\n{code}\ntread ({tree});\nproc /;\n"


def non_additive_missing():
    rows = [("Alpha", "0" * 8)] + [(NAMES[k], "1" * k + "?" * (8 - k)) for k in range(1, 8)] + [("India", "1" * 8)]
    return tnt(rows, "0 (((1 2) (3 4)) ((5 6) (7 8)))", "cc - .;")


def additive_missing():
    rows = [("Alpha", "7" * 8)] + [(NAMES[k], str(8 - k) * k + "?" * (8 - k)) for k in range(1, 8)] + [("India", "0" * 8)]
    return tnt(rows, "0 (1 (2 (3 (4 (5 (6 (7 8)))))))")


def continuous_missing():
    rows = []
    for k in range(8):
        values = ["1.000"] * 8 if k == 7 else ["0.125"] * k + ["0.000"] + ["?"] * (7 - k)
        rows.append((NAMES[k], "  ".join(values)))
    body = "\n".join(f"{t} {v}" for t, v in rows)
    return f"nstates cont ;\nxread\n'x'\n8 8\n&[continuous]\n{body}\n;\ntread (((0 1) (2 3)) ((4 5) (6 7)));\nproc /;\n"


CASES = {
    "additive 1": (tnt([("A", "0"), ("B", "1"), ("C", "1")], "0 (1 2)"), 1),
    "additive 2a": (tnt([("A", "0"), ("B", "1"), ("C", "2"), ("D", "3")], "(0 1) (2 3)"), 3),
    "additive 2b": (tnt([("A", "4"), ("B", "4"), ("C", "4"), ("D", "2"), ("E", "3"), ("F", "1")], "0 (1 ((2 3) (4 5)))"), 5),
    "additive 3": (tnt([("A", "3"), ("B", "0"), ("C", "1"), ("D", "2"), ("E", "3")], "0 ((1 2) (3 4))"), 4),
    "non-additive missing": (non_additive_missing(), 8),
    "additive missing": (additive_missing(), 56),
    "continuous missing": (continuous_missing(), 7),
}


@pytest.mark.parametrize("name", CASES)
def test_known_cost(spark, tmp_path, name):
    text, cost = CASES[name]
    (tmp_path / "data.tnt").write_text(text)
    state = Session(spark).run(f'read("{tmp_path}/data.tnt")')
    assert state.costs[0]["total"] == pytest.approx(cost)


TREE = "(Alpha,(Bravo,(Charlie,(Delta,Epsilon))));"
ONE = "".join(f">{t}\n{('ACGTA'[:i] + '?' + 'ACGTA'[i + 1 :])}\n" for i, t in enumerate(["Alpha", "Bravo", "Charlie", "Delta", "Epsilon"]))


def test_sankoff_distances_follow_the_matrix(spark, tmp_path):
    """Two taxa that differ by a transition and a transversion."""
    (tmp_path / "m.tcm").write_text(G2T2)
    (tmp_path / "d.fasta").write_text(">A\nAC\n>B\nGA\n>C\nGA\n")
    (tmp_path / "t.tree").write_text("(A,(B,C));")
    state = Session(spark).run(f'read(set_tcm:(tcm:"{tmp_path}/m.tcm", prealigned:nucleotide:"{tmp_path}/d.fasta"), "{tmp_path}/t.tree")')
    assert [r.bin for r in state.characters.collect()] == ["metric", "metric"]
    assert state.costs[0]["total"] == 3


def test_two_blocks_with_missing_taxa(spark, tmp_path):
    """Each file lacks a taxon of the other; both are scored with what is there."""
    (tmp_path / "g2.tcm").write_text(G2T2)
    (tmp_path / "g4.tcm").write_text(G4T4)
    (tmp_path / "a.fasta").write_text(">Alpha\nA\n>Bravo\nA\n>Charlie\nG\n>Delta\nG\n")
    (tmp_path / "b.fasta").write_text(">Alpha\nC\n>Bravo\nC\n>Charlie\nA\n>Epsilon\nA\n")
    (tmp_path / "t.tree").write_text(TREE)
    state = Session(spark).run(f'read(set_tcm:(tcm:"{tmp_path}/g2.tcm", prealigned:nucleotide:"{tmp_path}/a.fasta"), set_tcm:(tcm:"{tmp_path}/g4.tcm", prealigned:nucleotide:"{tmp_path}/b.fasta"), "{tmp_path}/t.tree")')
    assert [b[2] for b in state.costs[0]["blocks"]] == [1, 4]


def test_dynamic_is_rooted_where_it_is_cheapest(spark, tmp_path):
    (tmp_path / "d.fasta").write_text(">A\nACGT\n>B\nACGT\n>C\nACT\n>D\nACT\n")
    (tmp_path / "t.tree").write_text("((A,C),(B,D));")
    state = Session(spark).run(f'read("{tmp_path}/d.fasta", "{tmp_path}/t.tree")')
    assert state.costs[0]["total"] == 2


def test_round_trip_and_reports(spark, tmp_path):
    (tmp_path / "d.fasta").write_text(">A\nACGT\n>B\nACGT\n>C\nACT\n>D\nAT\n")
    said = []
    session = Session(spark, said.append)
    code = session.main(f"""read("{tmp_path}/d.fasta") build(2, tree) save("{tmp_path}/kept")
        report(data, ("{tmp_path}/x.data", overwrite)) report(dot) report(xml) report(distance) report(metadata) report(implied-alignment) report(data, "{tmp_path}/x.data") echo("done")""")
    assert code == 0, said
    before = [c["total"] for c in session.state.costs]
    assert session.main(f'load("{tmp_path}/kept")') == 0
    assert [c["total"] for c in session.state.costs] == before
    assert sorted(p.name for p in tmp_path.glob("x.data*")) == ["x.data", "x.data.0"]
    assert said[-1] == "done" and said[2].startswith("A,B,C,D\n0.0,0.0,1.0,2.0\n")
    assert said[4].count(">") == 4 and len({len(x) for x in said[4].split("\n")[1::2] if x}) == 1


@pytest.mark.parametrize(
    ("files", "script", "code"),
    [
        ({"a.fasta": ""}, 'read("{d}/a.fasta")', 4),
        ({}, 'read("{d}/none.fasta")', 4),
        ({"a.fasta": ">A\nACGT\n>B\nAC[[\n"}, 'read("{d}/a.fasta")', 8),
        ({"a.fasta": ">A\nACGT\n>B\nACG\n"}, 'read(prealigned:nucleotide:"{d}/a.fasta")', 8),
        ({"a.fasta": "", "b.fasta": ">A\nAC[[\n"}, 'read("{d}/a.fasta", "{d}/b.fasta")', 4),
        ({"a.fasta": ">A\nAC\n>B\nAC\n", "t.tree": "(A,C);"}, 'read("{d}/a.fasta", "{d}/t.tree")', 12),
        ({"a.fasta": ">A\nAC\n>B\nAC\n", "t.dot": "digraph { r -> A; r -> B; r -> s; s -> x; x [label=A]; s -> y; y [label=B]; A [label=A]; B [label=B] }"}, 'read("{d}/a.fasta", "{d}/t.dot")', 12),
        ({"a.fasta": ">A\nAC\n>B\nAC\n"}, 'read("{d}/a.fasta") build(forest)', 16),
        ({"a.fasta": ">A\nAC\n>B\nAC\n"}, 'read("{d}/a.fasta") report(data, "{d}/no/such/file")', 32),
        ({}, "build(1)", 16),
        ({}, "frobnicate(1)", 8),
        ({"a.fasta": ">A\nAC\n>B\nAC\n"}, 'read(genome:"{d}/a.fasta")', 8),
    ],
)
def test_exit_codes(spark, tmp_path, files, script, code):
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    assert Session(spark, lambda _: None).main(script.replace("{d}", str(tmp_path))) == code


def test_tree_numbers_count_the_sorted_names(spark, tmp_path):
    """Rows out of order: number 0 is the first name, not the first row."""
    rows = [("Delta", "3"), ("Alpha", "0"), ("Charlie", "2"), ("Bravo", "1")]
    (tmp_path / "data.tnt").write_text(tnt(rows, "(0 1) (2 3)"))
    state = Session(spark).run(f'read("{tmp_path}/data.tnt")')
    assert state.costs[0]["total"] == 3 and state.taxa == ["Alpha", "Bravo", "Charlie", "Delta"]
    (tmp_path / "other.tnt").write_text(tnt(rows, "(0 3) (1 2)"))
    assert Session(spark).run(f'read("{tmp_path}/other.tnt")').costs[0]["total"] == 4


WIDE = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
TAXA = ["Alpha", "Bravo", "Charlie", "Delta", "Echo"]


def wide_files(folder, symbols, cost, sequences):
    """A cost matrix whose last symbol is the gap, and sequences of space-separated symbols."""
    n = len(symbols)
    table = "\n".join(" ".join(str(cost(i, j)) for j in range(n + 1)) for i in range(n + 1))
    (folder / "m.tcm").write_text(" ".join(symbols) + "\n" + table + "\n")
    (folder / "d.fastc").write_text("".join(f">{t}\n{' '.join(s)}\n" for t, s in zip(TAXA, sequences, strict=True)))
    (folder / "t.tree").write_text("((Alpha,Bravo),(Charlie,(Delta,Echo)));")


def steps(i, j):
    return 0 if i == j else 1 + (abs(i - j) % 3)


@pytest.mark.parametrize("cost", [lambda i, j: int(i != j), lambda i, j: abs(i - j), steps], ids=["discrete", "linear", "general"])
@pytest.mark.parametrize("aligned", ["prealigned:", ""])
def test_wide_alphabets_cost_what_narrow_ones_do(spark, tmp_path, cost, aligned):
    """100 symbols of which four and the gap's neighbour occur, against the same four alone."""
    import random

    rng = random.Random(len(aligned))
    used = [0, 1, 2, 3]
    picks = [[rng.choice(used) for _ in range(12)] for _ in TAXA]
    totals = []
    for symbols in (WIDE, WIDE[:4]):
        folder = tmp_path / str(len(symbols))
        folder.mkdir()
        gap = len(symbols)
        # The gap costs the same in both, whatever its place.
        priced = lambda i, j, gap=gap: cost(i, j) if max(i, j) < gap or i == j else 7
        wide_files(folder, symbols, priced, [[symbols[k] for k in p] for p in picks])
        state = Session(spark).run(f'read({aligned}custom_alphabet:(tcm:"{folder}/m.tcm", "{folder}/d.fastc"), "{folder}/t.tree")')
        totals.append(state.costs[0]["total"])
    assert totals[0] == totals[1] > 0


def test_wide_alphabets_in_builds_distances_and_reports(spark, tmp_path):
    wide_files(tmp_path, WIDE, lambda i, j: int(i != j), [[WIDE[(7 * t + k) % 100] if k != t else WIDE[99] for k in range(6)] for t in range(5)])
    said = []
    code = Session(spark, said.append).main(f'read(custom_alphabet:(tcm:"{tmp_path}/m.tcm", "{tmp_path}/d.fastc")) build(1) report(distance) report(implied-alignment)')
    assert code == 0, said
    assert said[0].splitlines()[0] == "Alpha,Bravo,Charlie,Delta,Echo" and said[1].count(">") == 5


def test_networks_grow_from_trees_that_were_read(spark, tmp_path):
    (tmp_path / "d.fasta").write_text(">A\nAAAA\n>B\nAACC\n>C\nCCAA\n>D\nCCCC\n")
    (tmp_path / "t.tree").write_text("((A,D),(B,C));")
    state = Session(spark).run(f'read(prealigned:nucleotide:"{tmp_path}/d.fasta", "{tmp_path}/t.tree")')
    before = state.costs[0]["total"]
    session = Session(spark)
    session.run(f'read(prealigned:nucleotide:"{tmp_path}/d.fasta", "{tmp_path}/t.tree") build(5, network)')
    assert len(session.state.graphs) == 1 and session.state.costs[0]["total"] <= before
