"""A few registered queries against their DuckDB oracle on the sf0.001 tables
(the full comparison is tools/oracle_check.py at sf0.01)."""
import duckdb
import pytest

import __spark_entry__ as E
from giftrisk.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["donations_reshaped", "rule_labels", "triage_queue", "ip_velocity_24h", "sanctions_fuzzy_hits",
         "roc_auc_ap_fbeta", "donor_running_history"]


def _rows(pdf):
    cols = sorted(pdf.columns)
    def norm(v):
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return "∅" if v is None else str(v)
    return cols, sorted("|".join(norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = _rows(E.queries()[name](spark, SF).toPandas())
    want = _rows(con.execute(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
