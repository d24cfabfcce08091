"""Every catalogue query beside its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from chronoloom.plans import catalogue


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, tables, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    found = tables.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert comparable(got.columns, [tuple(r) for r in got.collect()]) == comparable(columns, found.fetchall())
