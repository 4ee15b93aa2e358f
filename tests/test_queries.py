"""Every query of the project against its DuckDB statement, on the smallest tables; the entry points with and without the llm folders."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry  # registers all queries
from tracewell import queries as Q

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in Q.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(tmp_path):
    shutil.copytree(f"{ROOT}/tracewell", tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    # The tests that are left run there, too: here the fast ones, and every one is collected.
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for args in (["--collect-only"], ["-k", "validation_details or renderer or schema_files or stand_in"]):
        subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", *args], cwd=tmp_path, check=True, env=env, stdout=subprocess.DEVNULL)


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(f"{ROOT}/tracewell"):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                assert "tracewell.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()


ODD_TEXTS = [
    None, "", " ", "\t\n", "Undefined", "Not documented", "No description for this column", "Pending further documentation", "the value", "The ID", "one", "one two", "one two three", "THIS IS A test of it", "THİS İS A test of it",
    "\u3000one", "\u00a0 one two", "one two \u2003", "one \u00a0 two", " \u3000 \u202f ", "one two three\u205f", "\u1680one two three ", "\n one\ttwo\r\nthree\f", "ΟΔΟΣ ΣΑΣ", "a\x0bb c\x1c", "x\x00y z w", "\u200bone two", "\ufeffone two",
]


@pytest.mark.parametrize("name", ["doc_quality_flags", "desc_normalize"])
def test_texts_of_any_kind(spark, tmp_path, name):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": range(len(ODD_TEXTS)), "text": ODD_TEXTS}), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = c.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == sorted(want.fetchall())
