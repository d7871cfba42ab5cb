"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from fleetloom import plans
from tests import oracle

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES
# A handful of rows are too few for some thresholds; the larger tables cover them.
MAY_BE_EMPTY = {"resolve_scope_exclude"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    difference = oracle.compare(spark, con, QUERIES[name], ORACLES[name], SMALL)
    assert difference is None or (difference == "both empty" and name in MAY_BE_EMPTY)


def test_backup_files_of_customers_beyond_a_day_of_seconds(spark, con, tmp_path):
    """Seconds by customer number carry the time shown, but not the day asked for, past midnight."""
    rows = "(1, 86399, '1995-02-16'), (2, 86400, '1995-02-16'), (3, 86400, '1995-02-15'), (4, 900000, '1995-02-16'), (5, 900000, '1995-02-06')"
    orders = f"select k::bigint as o_orderkey, c::bigint as o_custkey, d::timestamp as o_orderdate from (values {rows}) t(k, c, d)"
    own = oracle.duckdb.connect()
    own.execute(f"copy ({orders}) to '{tmp_path}/orders.parquet'")
    own.execute(f"copy (select * from '{SMALL}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    for name in ("orders", "lineitem"):
        own.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    assert oracle.compare(spark, own, QUERIES["backup_files"], ORACLES["backup_files"], str(tmp_path)) is None
