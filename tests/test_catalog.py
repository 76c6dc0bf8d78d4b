"""Every registered sketch query against its DuckDB SQL, and the registry without the corpus operators."""

import os
import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from stridemark import catalog

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    texts = ["".join(r.choice("acgtACGT ,nx") for _ in range(n)) for n in (0, 5, 14, 40, 90, 150, 600)] + ["acgt" * 30, "A" * 80, None]
    at = tmp_path_factory.mktemp("documents")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalog.ENTRIES))
def test_query_equals_its_sql(spark, folder, duck, name):
    got = catalog.queries()[name](spark, folder)
    expected = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = Counter(tuple(r) for r in got.select(columns).collect())
    assert rows == Counter(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert rows


def test_works_without_the_corpus_operators(tmp_path):
    """With the corpus folders and the pipeline gone the rest imports, and its other tests can be collected."""
    for x in ("__spark_entry__.py", "corpus_pipeline.py", "stridemark", "tests"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    for gone in ("stridemark/llm", "tests/llm"):
        shutil.rmtree(tmp_path / gone, ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(q) == set(e.oracle_sql())"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode == 0
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_kernel.py"], cwd=tmp_path, env=env, capture_output=True)
    assert run.returncode == 0, run.stdout
    assert subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path, env=env, capture_output=True).returncode == 0
