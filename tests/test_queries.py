"""Every query outside the llm package against its SQL on the smallest tables."""

import pytest
from compare import differences

import rankloom.plans.general as general
import rankloom.plans.ranking as ranking

FOLDER = "/root/testdata/sf0.001"
ALL = {**general.QUERIES, **ranking.QUERIES}
SQL = {**general.SQL, **ranking.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert differences(spark, FOLDER, ALL[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["impression_id", "article_id", "version_no"]
    assert set(e.oracle_sql()) <= set(e.queries())
