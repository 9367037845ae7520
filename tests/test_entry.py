"""The registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomspark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    show = lambda v: repr(round(v, 8)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, wanted = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_normalized_lines_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    got = catalogue.QUERIES["normalized_document_lines"](spark, SF).select("doc_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted((i, p) for i, t in texts.items() for p in range(t.count("\n") + 1)) and len(got) > len(texts)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ngram", "freq"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{top}/loomspark", tmp_path / "loomspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'ngram_2' in e.queries() and not any(q.startswith('op1') for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
