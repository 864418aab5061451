"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import connect, difference
from wardflow.plans import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    rows, found = difference(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name])
    assert not found
    assert rows > 0


def test_only_models_lack_an_oracle():
    without = set(queries.queries()) - set(oracles.oracles())
    assert without == {f"{m}_{k}" for m in ("risk", "followup", "vitals")
                       for k in ("scores", "metrics")}
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 153
