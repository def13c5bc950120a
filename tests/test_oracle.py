"""Every registered query against its oracle SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duck
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_only_the_approximate_search_has_no_oracle():
    assert set(QUERIES) - set(ORACLE) == {"similar_issues_lsh"}
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["intent", "prec", "rec", "f1", "support"] and df.count() > 0
