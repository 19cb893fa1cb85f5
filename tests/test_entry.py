"""Every registered query runs; a few are held against DuckDB here, all of them by the driver."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from rollbook.plans.oracle import SQL
from rollbook.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = duck.execute(SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)


def test_every_query_has_its_sql():
    """All but what a model gives, which is tested against plain versions and by held-out accuracy in test_entities.py."""
    assert set(QUERIES) - set(SQL) == {"x11_entities"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("gone", ["folders", "folders and pipeline", "a dependency"])
def test_imports_without_the_text_operators(tmp_path, gone):
    """A copy of the repository without the folders of the text operators, or where one of their libraries is missing, still registers and runs the rest."""
    root = Path(__file__).resolve().parents[1]
    for name in ("rollbook", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    if gone == "a dependency":
        (tmp_path / "xxhash.py").write_text("raise ImportError('missing')")
    else:
        shutil.rmtree(tmp_path / "rollbook/llm", ignore_errors=True)
    if gone == "folders and pipeline":
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'c08_council_summary' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode == 0 and int(out.stdout) == len(QUERIES), out.stderr


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
