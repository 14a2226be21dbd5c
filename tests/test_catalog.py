"""The registered queries against their SQL; all of them with FULL_CATALOG=1, else the quick ones."""

import os

import pytest
from oracle import compare, connect

from tracewright.catalog import registry

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
QUICK = ("A02", "A07", "A24", "J06", "J12", "J18", "J25_j", "F04", "F27", "P03", "P11", "S08", "T03", "T07_stratified_q", "U03", "W04", "W10")
NAMES = [n for n in registry() if os.environ.get("FULL_CATALOG") or n.startswith(QUICK)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    entry = registry()[name]
    df = entry.run(spark, SF)
    if entry.sql is None:
        assert not df.isEmpty()
    else:
        assert compare(df, con, entry.sql) is None
