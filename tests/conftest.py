import os
import sys
from datetime import date, datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")

from fleetloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, app="fleetloom-tests", memory="4g")
    # Plans are searched for pushed filters: print these in full.
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return session


@pytest.fixture()
def table(spark):
    """Make a DataFrame of a declared schema from rows given as dicts; absent columns are NULL."""

    def make(ddl, rows):
        names = spark.createDataFrame([], ddl).columns
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)

    return make


@pytest.fixture()
def short(spark):
    """Make a DataFrame from DDL and tuples."""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)


def at(text):
    """Timestamp from ISO text."""
    return datetime.fromisoformat(text)


def day(text):
    return date.fromisoformat(text)


def dec(text):
    return Decimal(text)


def tuples(df, *cols):
    """Rows as a sorted list of tuples (of some columns)."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
