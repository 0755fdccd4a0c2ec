"""Every query of the engine: rows equal to its SQL in DuckDB, or at least some rows."""

import oracle
import pytest

from tessella.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        oracle.compare(spark, con, SF, QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0
