"""The pipeline and its stages against plain versions, the queries with SQL against DuckDB, and the entry without this subpackage."""

import glob
import os
import re
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from cladespark.llm import oracles, personal_data, queries, quality_rules, staging

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def survivors(rows):
    """Of each component of pairs with a Jaccard similarity of 0.8 or more, the smallest id."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {d: d for d in sets}
    ids = sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def test_unlike_texts_with_one_id_are_no_near_copies(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(7, one, "en", "s", 1), (7, two, "en", "s", 1), (3, one, "en", "s", 1), (7, two, "en", "s", 1), (9, two, "en", "s", 1), (None, two, "en", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, frame, DATA).collect()]
    assert sorted(got) == [(3, one), (7, two)]


def test_stages_do_what_they_say(spark):
    docs = staging.documents(spark, DATA)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staging.stage(stage(spark, docs, DATA), f"test-{name}")
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == COLUMNS
    judged = {r.doc_id: r.kept for r in quality_rules.op7_quality_rules(spark, DATA).collect()}
    assert {r.doc_id for r in out["quality_rules"]} == {d for d, kept in judged.items() if kept}
    assert {r.doc_id for r in out["ngram_jaccard_join"]} == survivors(out["quality_rules"])
    before = {r.doc_id: r for r in out["ngram_jaccard_join"]}
    for r in out["personal_data"]:
        spans = [{"kind": k, "start": s, "end": e} for k, s, e in personal_data.base_spans(before[r.doc_id].text)]
        assert r.text == personal_data.redacted(before[r.doc_id].text, spans) and r.n_chars == len(r.text)
    copies = Counter(r.doc_id for r in out["mix_sources"])
    clean = {r.doc_id: r for r in out["personal_data"]}
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    assert all(tuple(r) == tuple(clean[r.doc_id]) for r in out["mix_sources"])
    words = sum(len(WORD.findall(r.text)) for r in out["mix_sources"])
    assert abs(words / (1.5 * sum(len(WORD.findall(r.text)) for r in out["personal_data"])) - 1) < 0.05
    tokens = Counter()
    for r in out["packing"]:
        tokens[r.doc_id] += r.length
    whole = {r.doc_id: r.doc_tokens for r in out["packing"]}
    assert tokens == {d: whole[d] * n for d, n in copies.items()}


def odd(spark, rows):
    names = "doc_id long, text string, lang string, source string, n_chars long, __extra string, size int, spans string"
    return spark.createDataFrame(rows, names)


def test_stages_stand_odd_tables(spark):
    text = " ".join(f"word{i}" for i in range(80))
    many = [(1, text, "en", "a", 1, "x", 1, "s"), (1, text, "en", "a", 1, "x", 1, "s"), (None, text, None, None, None, None, None, None), (2, None, None, None, None, None, None, None), (3, "", "", "", 0, "", 0, ""), (4, text + " a@b.example.com", "en", None, 5, "y", 2, "t")]
    for rows in (many, []):
        docs = odd(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = staging.stage(stage(spark, docs, DATA), f"odd-{name}")
            assert name == "packing" or docs.columns == columns
        assert rows or docs.count() == 0


def test_run_is_the_stages(spark):
    a = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect())
    b = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect())
    assert sum(a.values()) and sum(n for _, _, n, _ in a.elements()) == sum(n for _, _, n, _ in b.elements())


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(oracles.ORACLES[name])
    tidy = lambda v: round(v, 3) if isinstance(v, float) else v
    order = [want.columns.index(c) for c in columns]
    assert Counter(tuple(tidy(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(tidy(r[i]) for i in order) for r in want.fetchall())


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports, and its queries are there, when this subpackage and the pipeline are deleted."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/cladespark", f"{tmp_path}/cladespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fitch_length' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0
