"""The llm queries against their SQL on the smallest tables."""

import pytest
from compare import differences

from rankloom.llm import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_agrees_with_sql(spark, name):
    assert differences(spark, FOLDER, plans.QUERIES[name], plans.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
