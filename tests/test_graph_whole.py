"""The graph queries without id filters cover the whole graph."""

import pytest
from test_graph import duck, test_equals_sql as equals_sql  # noqa: F401


@pytest.mark.parametrize("name", ["p_two_wildcards_all", "p_node_cross_all", "edge_hyperkey_all"])
def test_whole_graph_equals_sql(spark, duck, name):  # noqa: F811
    equals_sql(spark, duck, name)


@pytest.mark.parametrize("name", ["edge_members_not_in", "attr_mod", "attr_regex", "status_in_where"])
def test_conditions_equal_sql(spark, duck, name):  # noqa: F811
    equals_sql(spark, duck, name)
