"""Every registered query against its SQL on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables aren't here")

from tidewheel.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def tables():
    import compare

    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tables, name):
    import compare

    got, want = QUERIES[name](spark, SF).toPandas(), tables.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canonical(got) == compare.canonical(want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["event_id", "x"]
