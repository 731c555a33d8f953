import duckdb
import pytest

import __spark_entry__ as entry_module
from veilstream import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "supplier"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalog.oracle_sql()[name])
    rows = [dict(zip(found.columns, r)) for r in found.fetchall()]
    assert sorted(found.columns) == columns
    assert plain([r.asDict() for r in df.collect()], columns) == plain(rows, columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert catalog.queries()["grammar_rules"](spark, SF).count() > 40
