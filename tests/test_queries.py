import pytest
from oracle import both

from folioflow.plans import core, indexes, streams  # noqa: F401  indexes adds its queries to core's

QUERIES, ORACLE = core.QUERIES | streams.QUERIES, core.ORACLE_SQL | streams.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in ORACLE:
        rows, expected = both(spark, small, QUERIES[name], ORACLE[name])
        assert rows == expected
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "title", "platform"]
    assert set(core.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_search_plan_prunes_and_semi_joins(spark, small):
    plan = core.QUERIES["filter_by_platform"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src6)]" in plan and "lang" not in plan
    assert "LeftSemi" in core.QUERIES["filter_by_tag"](spark, small)._jdf.queryExecution().executedPlan().toString()
