from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest
from annoweave import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([tidy(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    sql = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert plain(df.collect(), df.columns) == plain(sql.fetchall(), sql.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(tmp_path):
    """With the corpus folders and the pipeline gone, the rest still imports."""
    for p in ("annoweave", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "annoweave/llm")], check=True)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert e.oracle_sql(); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": ":".join(p for p in sys.path if "repo" not in p and p)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(queries.QUERIES)
