"""The registered queries against SQL on the smallest tables, and the entry point without the optional folders."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from archivolt import queries as library

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return v if v is None or isinstance(v, (bool, int)) else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(library.ORACLE))
def test_oracle(spark, duck, name):
    df = library.QUERIES[name](spark, DATA)
    cur = duck.execute(library.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLE)))
def test_rows(spark, duck, name):
    assert library.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0


def test_without_optional_folders(tmp_path):
    """What the driver does: the optional folders and the pipeline go, the rest still imports."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "spark-warehouse"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(library.QUERIES)), str(len(library.ORACLE))]
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_library.py", "-k", "normalize or pieces or versions"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
