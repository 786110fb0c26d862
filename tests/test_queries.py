"""Every query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
from siftpage.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})")
    want = sorted((tuple(map(value, r)) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(map(value, r)) for r in df.select(*names).collect()), key=repr)
    assert got == want and got
