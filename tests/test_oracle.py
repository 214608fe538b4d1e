"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

import os

import pytest

from checks import all_checks
from checks.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# Thresholds chosen for the larger tables leave these empty at this size, which is fine:
# both sides must still agree.
CHECKS = all_checks()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if c.sql])
def test_matches_sql(spark, con, name):
    check = CHECKS[name]
    assert difference(check.run(spark, FOLDER), con, check.sql) is None


@pytest.mark.parametrize(
    "name", [n for n, c in CHECKS.items() if not c.sql and "cluster" not in n]
)
def test_runs_without_sql(spark, name):
    df = CHECKS[name].run(spark, FOLDER)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
