import os

import pytest
from compare import connect, differences

from orelake import catalog, more  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert differences(spark, connect(SF), catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_suite_has_38_results_and_gate_names_failures(spark):
    from orelake.operators import quality

    r = catalog.QUERIES["dq_suite"](spark, SF)
    assert r.count() == 38
    failed = {x.check_name for x in r.where("status = 'FAIL'").collect()}
    if failed:
        with pytest.raises(quality.DataQualityError):
            quality.gate(r)
