"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from cladespark import oracles, queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same_rows(spark, duck, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same_rows(spark, duck, queries.queries()[name], oracles.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    rows = queries.queries()[name](spark, DATA).collect()
    assert rows and all(v is not None for r in rows for v in r)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["char_id", "cost"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_executors_agree(spark):
    """The fold in the JVM and the numpy walk give the same lengths and the same final states."""
    import numpy as np
    from pyspark.sql import functions as F

    from cladespark.operators import fold, kernels
    from cladespark.operators.score import static_pass

    obs = queries.discrete(spark, DATA)
    rows = {}
    for r in obs.collect():
        rows.setdefault(r.char_id, {})[r.taxon] = r.mask
    chars = sorted(rows)
    tree = queries.TREE
    leaves = {n: np.array([rows[c].get(tree.labels[n], 31) for c in chars]) for n in tree.leaves}
    states, cost = static_pass(tree, leaves, kernels.Fitch().merge)
    got = {r.char_id: r.cost for r in queries.fitch_length(spark, DATA).collect()}
    assert [got[c] for c in chars] == cost.tolist()
    kernel, final = kernels.Fitch(strict=True), {1: states[1]}
    for n in range(2, 16):
        final[n] = kernel.finalize(final[n // 2], states[n], states[2 * n], states[2 * n + 1])
    nodes = fold.fitch_finals(fold.fitch_nodes(obs, tree, ["char_id"], F.lit(31).cast("long")), tree, ["char_id"], strict=True)
    found = {(r.char_id, r.node_id): r.final for r in nodes.filter("node_id < 16").collect()}
    assert all(found[c, n] == final[n][i] for i, c in enumerate(chars) for n in range(1, 16))


def test_tcm_structure_joins_nothing(spark):
    """A join of cells with cells is broadcast through the driver where their number is guessed too low."""
    plan = queries.tcm_structure(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert plan.count("Exchange") == 1


def test_tcm_structure_of_odd_parts(spark, tmp_path):
    """Keys that come twice, with other sizes or none, keys below 0, keys and sizes that are null."""
    con = duckdb.connect()
    con.execute("""create table part as select case when k % 53 = 0 then null else k // (1 + abs(k) % 3) end::bigint as p_partkey, case when k % 7 = 0 then null else abs(k) * 31 % 61 end::int as p_size from range(-200, 2000) as t(k)""")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    df = queries.tcm_structure(spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("tcm_id", "structure", "bin").collect())
    assert got == sorted(con.sql(f"select tcm_id, structure, bin from ({oracles.ORACLES['tcm_structure']})").fetchall())
    assert len({r[1] for r in got}) == 6


def test_tcm_structure_of_wider_matrices(spark):
    """Structures of cells are those of the matrices, whatever the symbols are called; without mirrored cells there is none."""
    import random

    from cladespark.operators import tcm

    rng = random.Random(5)
    distances = [lambda i, j: int(i != j), lambda i, j: abs(i - j), lambda i, j: 2 * abs(i - j), lambda i, j: (i ^ j).bit_length(), lambda i, j: rng.choice([3, 4, 5]), lambda i, j: rng.choice([1, 3])]
    want, rows = {}, []
    for key in range(120):
        n, f, skew = 2 + key % 7, distances[key % len(distances)], key % 5 == 0
        half = {(i, j): f(i, j) * (i != j) for i in range(n) for j in range(i, n)}
        m = tcm.Tcm.generate(n, lambda i, j: half[min(i, j), max(i, j)] + (skew and i > 0 == j))  # noqa: B023
        want[key] = m.structure()
        rows += [(key, i, j, x) for i, row in enumerate(m.cost) for j, x in enumerate(row)]
    rng.shuffle(rows)
    cells = spark.createDataFrame([*rows, (999, 0, 1, 1), (999, 1, 2, 1)], "tcm_id long, i int, j int, cost long")
    assert {r.tcm_id: r.structure for r in tcm.structure_frame(cells).collect()} == want
    assert len(set(want.values())) == 6
    renamed = cells.selectExpr("tcm_id", "10 * i - 7 as i", "10 * j - 7 as j", "cost")
    other = {k: "NonAdditive" if k % 7 == 0 else "UltraMetric" for k, v in want.items() if v == "Additive"}
    assert {r.tcm_id: r.structure for r in tcm.structure_frame(renamed).collect()} == want | other
