"""Every registered query that has SQL, against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from keelson.plans import catalogue, stored  # noqa: F401

SF = os.environ.get("KEELSON_TEST_SF", "/root/testdata/sf0.001")


def normal(rows):
    return sorted(tuple((v is None, int(v) if isinstance(v, float) and v.is_integer() else v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert normal(map(tuple, got.select(columns).collect())) == normal(want)


def test_registry_survives_a_missing_library():
    """Without a library that only the operators for training data need, every other query is still registered."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); print('live_set' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == ["True", "False", "True"]
