"""Driver contract guards: the entry module imports without a Spark session,
and every oracle SQL text binds in DuckDB."""
import os
import subprocess
import sys

import duckdb

import __spark_entry__ as E
from giftrisk.sources.tables import TABLES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_spark_session():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "assert len(E.queries()) >= len(E.oracle_sql()) > 0" % REPO)
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]


def test_every_oracle_sql_binds_in_duckdb():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    bad = []
    for name, sql in E.oracle_sql().items():
        try:
            con.execute("EXPLAIN " + sql)
        except Exception as exc:  # collect all failures
            bad.append((name, str(exc)[:200]))
    assert not bad, bad
