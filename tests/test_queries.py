"""Every query of the catalogue against its SQL, and the shape of the driver's contract."""

import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quarry.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    found = oracle.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())


def _titles(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return [(r.title, r.bytes) for r in QUERIES["s10_text_blocks"](spark, str(folder)).orderBy("doc_id").collect()]


def test_titles_of_odd_texts(spark, tmp_path):
    texts = [None, "", " \n", "ab \x85", "ab \u2028", "ab \u2029", "ab \r\n\x85", "ab \x85\nline", " \t\r\n\f a \t\n b", "a" * 99, "\U0001f600" * 100, "ab\xa0"]
    con = duckdb.connect()
    got = _titles(spark, tmp_path, texts)
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == con.sql(f"SELECT title, bytes FROM ({ORACLE_SQL['s10_text_blocks']}) ORDER BY doc_id").fetchall()


def test_titles_keep_their_letters(spark, tmp_path):
    assert _titles(spark, tmp_path, ["vieau lev\nb", "\x0bab\x0b"]) == [("vieau lev", 11), ("ab", 4)]


def test_titles_of_long_blanks(spark, tmp_path):
    """A pattern would need quadratic time: minutes for this text."""
    assert _titles(spark, tmp_path, ["a" + " " * 200_000 + "b", " " * 200_000 + "a\nb"]) == [(None, 200_002), ("a", 200_003)]


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_stands_without_corpus_operators():
    """The rest imports and lists its queries where the corpus operators are missing."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['quarry', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)


def test_plans_push_down(spark, sf):
    plan = QUERIES["f03_date_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan or "GreaterThanOrEqual(ts" in plan
    assert "props" not in plan
    plan = QUERIES["r05_hybrid_search"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
