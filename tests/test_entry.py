import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_optional_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "lodestrata"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lodestrata" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.parametrize("name", sorted(k for k in e.oracle_sql() if k[0] in "qf"))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(e.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = e.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)
