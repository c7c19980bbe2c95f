"""Every registered query against its SQL on DuckDB, at the smallest scale; several run at a time."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from compare import connect, diff

from listtide.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    con = connect(SF)

    def run(name):
        df = QUERIES[name](spark, SF)
        if name in ORACLES:
            problems = diff(df, con.cursor().sql(ORACLES[name]))
            return [p for p in problems if p != "no rows"]
        return [] if df.count() else ["no rows"]

    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(run, n) for n in QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, name):
    assert results[name].result() == []


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
