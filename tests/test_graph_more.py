"""Lists, single gets, creation, cascades, variable relations, kinds and the stream of activity."""

import pytest
from pyspark.sql import functions as F
from test_graph import SF, duck, ids, stooges  # noqa: F401

from loomgraph.functions.conditions import condition
from loomgraph.operators import changes, patterns, select
from loomgraph.plans import catalogue
from loomgraph.sources import files
from loomgraph.sources.star import Graph
from loomgraph.streaming import activity

NEW = "p_var_relation p_id_reference p_semi_bound p_distinct_rows p_filter_matches_in attr_type edge_one_member edge_by_name node_batch graph_catalog edges_newest edges_newest_total create_edges delete_graph stream_activity".split()


@pytest.mark.parametrize("name", NEW + ["p_edge_anchor_expand", "p_two_wildcards", "p_join_shared_var", "p_two_hop", "p_optional"])
def test_equals_sql(spark, duck, name):  # noqa: F811
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    assert want and sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want


def test_kinds_and_elements(spark):
    rows = [("a", '{"v": 1, "l": [{"x": 1, "y": 2}, {"x": 3, "y": 4}], "n": [2, 9]}'), ("b", '{"v": "1", "l": [{"x": 1, "y": 4}], "n": [5]}'), ("c", '{"v": [true, 1.5], "n": 5}'), ("d", '{"v": null}'), ("e", '{"v": 5000000000}')]
    d = spark.createDataFrame(rows, "id string, attributes string").withColumn("attributes", F.parse_json("attributes"))
    at = lambda doc: ids(d.where(condition(doc, d.columns)))
    assert at({"v": {"$type": "int"}}) == ["a"] and at({"v": {"$type": "long"}}) == ["e"]
    assert at({"v": {"$type": "number"}}) == ["a", "c", "e"] and at({"v": {"$type": ["string", "bool"]}}) == ["b", "c"]
    assert at({"v": {"$type": "array"}}) == ["c"] and at({"v": {"$type": "null"}}) == ["d"]
    assert at({"l": {"$elemMatch": {"x": 1, "y": {"$gt": 3}}}}) == ["b"]
    assert at({"n": {"$elemMatch": {"$gt": 3, "$lt": 8}}}) == ["b"]
    with pytest.raises(ValueError):
        condition({"v": {"$type": "decimal128"}})


def test_one_member_meets_all(stooges):  # noqa: F811
    e = stooges.edges
    assert ids(select.matched(e, where={"members": {"$elemMatch": {"node_id": "moe", "seq": 0}}})) == ["siblings"]
    assert ids(select.matched(e, where={"members": {"node_id": "moe", "seq": 0}})) == ["original", "shemp", "siblings"]


def test_lists_and_gets(spark, stooges):  # noqa: F811
    e = changes.created(stooges.edges, "2024-01-01 00:00:00")
    later = e.withColumn("system_created", F.when(F.col("id") == "shemp", F.lit("2025-01-01").cast("timestamp")).when(F.col("id") != "gone", F.col("system_created")))
    total, page = select.newest(later, 0, 3)
    assert total.first()[0] == 4 and [r.id for r in page.collect()] == ["shemp", "original", "siblings"]
    key = e.where("id = 'gone'").first().hyperkey
    assert ids(select.edge_by(e, key)) == ids(select.edge_by(stooges.edges, key)) == ["gone"]
    assert ids(select.by_ids(e, spark.createDataFrame([("gone",), ("none",)], "id string"))) == ["gone"]
    assert select.pruned(e.withColumn("skos_broader", F.lit(1))).columns == e.columns
    assert select.newest(later.limit(0))[0].first()[0] == 0


def test_created_updated_and_imported(spark, stooges, tmp_path):  # noqa: F811
    new = changes.created(stooges.edges.withColumn("id", F.when(F.col("id") != "gone", F.col("id"))), "2024-01-01 00:00:00")
    rows = {r.id: r for r in new.collect()}
    assert all(r.version == 1 and str(r.system_created) == str(r.system_updated) for r in rows.values())
    assert [r.id for r in rows.values() if r.id == r.hyperkey and r.relation == "sibling"]
    twice = spark.createDataFrame([("shemp", "cast"), ("shemp", None), ("shemp", "band")], "id string, relation string")
    up = changes.updated(new, twice, ["id"], at="2024-02-02 00:00:00").where("id = 'shemp'").collect()
    assert len(up) == 1 and (up[0].relation, up[0].version) == ("cast", 2)
    assert up[0].hyperkey != rows["shemp"].hyperkey and up[0].system_updated > up[0].system_created
    graph = Graph(stooges.nodes, new)
    files.export(graph, "g", str(tmp_path))
    back, counts = files.load(spark, "h", str(tmp_path), graph, at="2025-05-05 00:00:00")
    got = {r.id: r for r in back.edges.collect()}
    assert counts.first().errors == 0 and set(got) == set(rows)
    assert all(got[k].hypergraph_id == "h" and got[k].hyperkey != rows[k].hyperkey and got[k].system_created.year == 2025 for k in rows)


def test_relations_of_variables(spark, stooges):  # noqa: F811
    told = spark.createDataFrame([("sibling",)], "r string")
    assert ids(patterns.edge_pattern(stooges, told, "e", ["shemp"], relation="?r"), "e") == ["siblings"]
    assert ids(patterns.edge_pattern(stooges, None, "e", ["shemp"], relation="?r"), "r") == ["has-member", "sibling"]
    kinds = stooges.nodes.limit(1).withColumns({"id": F.lit("has-member"), "type": F.lit("RelationType"), "attributes": F.parse_json(F.lit('{"inverse": "member-of"}'))})
    found = changes.inverse_edges(stooges.edges, changes.inverses(stooges.nodes.unionByName(kinds)))
    assert ids(found) == ["original_inv", "shemp_inv"]
    assert ids(patterns.is_type(stooges.edges, "type", "Person")) == [] and len(ids(patterns.is_type(stooges.nodes, "type", "Person"))) == 4


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    fields = "event_id long, event_type string, ts timestamp, value double"
    put = lambda n, *rows: spark.createDataFrame(rows, "event_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: activity.keep(activity.windowed(spark.readStream.schema(fields).parquet(f"{tmp_path}/in/*")), f"{tmp_path}/out").awaitTermination()
    put(1, (1, "a", "2024-01-01 01:00:00", 1.0), (2, "a", "2024-01-01 05:00:00", 2.0), (3, "b", None, 1.0))
    run()
    put(2, (4, "a", "2024-01-01 09:00:00", None), (5, "b", "2024-01-02 00:00:00", 1.0))
    run()
    run()
    assert sorted((r.event_type, r.n, r.total) for r in activity.state(spark, f"{tmp_path}/out").collect()) == [("a", 3, 3.0), ("b", 1, 1.0)]
