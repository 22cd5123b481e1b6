"""The contract, and a sample of registered queries against their SQL at the smallest scale.

Set CATALOGUE=all to check every query that has SQL.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entrypoint
from catalogue.verify import TABLES, _rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["windowed_features_partial", "column_features", "quality_issues", "recipe_replay", "roc_curve", "box_statistics", "packet_samples", "knn_classify"]
NAMES = sorted(entrypoint.oracle_sql()) if os.environ.get("CATALOGUE") == "all" else SAMPLE


def test_entry(spark):
    df = entrypoint.entry(spark)
    assert "window_number" in df.columns and df.count() > 0


def test_every_counterpart_has_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entrypoint.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    rel = con.sql(entrypoint.oracle_sql()[name])
    assert got == _rows(rel.columns, rel.fetchall())


def test_entry_imports_without_llm(tmp_path):
    """The rest of the library registers its queries when the training-data folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
