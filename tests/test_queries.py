"""Every core query with SQL gives DuckDB's rows; the contract of the entry module holds."""

import pytest
from helpers import connect, rows_of, sql_rows

from foldsearch.plans import general, reference, stores

CASES = [(m, n) for m in (general, reference, stores) for n in m.QUERIES]


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_same_rows(spark, con, small_dir, module, name):
    df = module.QUERIES[name](spark, small_dir)
    if name not in module.SQL:
        assert df.columns and df.count() >= 0
        return
    names, expected = sql_rows(con, module.SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    for n in (1, 3, 5, 6):
        assert f"p{n}_found" in e.queries()


def test_sorted_ids_of_all_rows(spark, con, small_dir):
    import __spark_entry__ as e

    n = con.execute("select count(*) from (select distinct country_code, geoname_id from cities where geoname_id is not null)").fetchone()[0]
    assert e.queries()["sorted_ids_all"](spark, small_dir).count() == n
