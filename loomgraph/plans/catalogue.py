"""Every registered graph query with the SQL over the base tables that it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import hyperkey
from ..operators import changes as ch
from ..operators import patterns as pt
from ..operators import select as se
from ..sources import star
from ..sources.star import Graph
from ..streaming import activity

_QUERIES: dict[str, Callable[[Graph], DataFrame]] = {}
_SQL: dict[str, str] = {}
CATALOG = {"world": ["geo", "parties", "goods"], "goods": ["sales"]}
c = F.col


def _query(sql: str):
    def keep(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(star.load(spark, sf_dir))) for k, f in _QUERIES.items()} | {"stream_activity": stream_activity}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _nodes(g: Graph, graphs="parties", **match) -> DataFrame:
    return se.matched(se.scoped(g.nodes, graphs, CATALOG), **match)


def _edges(g: Graph, graphs="sales", **match) -> DataFrame:
    return se.matched(se.scoped(g.edges, graphs, CATALOG), **match)


_CUSTOMER = "'customer:' || c_custkey"
_ORDER = "'order:' || o_orderkey"


@_query(f"SELECT {_CUSTOMER} AS id, c_name AS label, c_acctbal AS attributes_acctbal FROM customer WHERE c_acctbal > 5000")
def attr_gt(g):
    return _nodes(g, type="Customer", where={"attributes.acctbal": {"$gt": 5000}}).select("id", "label", se.attribute("acctbal", "double").alias("attributes_acctbal"))


@_query("SELECT 'part:' || p_partkey AS id FROM part")
def status_in_where(g):
    return _nodes(g, "sales", where={"status": {"$nin": ["draft", "archived"]}, "type": "Part"}).select("id")


@_query("SELECT 'part:' || p_partkey AS id, 'Part' AS type FROM part")
def node_scan_type(g):
    return _nodes(g, "sales", type="Part").select("id", "type")


@_query("SELECT 'nation:' || n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey = 7")
def node_by_id(g):
    return _nodes(g, "geo", id="nation:7").select("id", "label")


@_query("SELECT 'geo' AS hypergraph_id, count(*) AS n FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM region) UNION ALL SELECT 'parties', count(*) FROM (SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier)")
def nodes_multi_graph(g):
    return _nodes(g, ["geo", "parties"]).groupBy("hypergraph_id").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n")
def nodes_logical_graph(g):
    return _nodes(g, "world").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT {_CUSTOMER} AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def attr_eq(g):
    return _nodes(g, where={"attributes.mktsegment": "BUILDING"}).select("id")


@_query("SELECT 'part:' || p_partkey AS id, p_size AS size FROM part WHERE p_size >= 10 AND p_size < 20")
def attr_range(g):
    return _nodes(g, "sales", where={"size": {"$gte": 10, "$lt": 20}}).select("id", se.attribute("size", "int").alias("size"))


@_query(f"SELECT {_CUSTOMER} AS id FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier")
def attr_ne_missing(g):
    return _nodes(g, where={"mktsegment": {"$ne": "BUILDING"}}).select("id")


@_query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size % 7 = 3")
def attr_mod(g):
    return _nodes(g, "sales", where={"size": {"$mod": [7, 3]}}).select("id")


@_query("SELECT 'part:' || p_partkey AS id FROM part WHERE regexp_matches(p_brand, '[13]$')")
def attr_regex(g):
    return _nodes(g, "sales", where={"brand": {"$regex": "[13]$"}, "size": {"$not": {"$regex": "^1"}}}).select("id")


@_query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size IN (1, 5, 9)")
def attr_in(g):
    return _nodes(g, "sales", where={"size": {"$in": [1, 5, 9]}}).select("id")


@_query(f"SELECT {_CUSTOMER} AS id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier")
def attr_nin(g):
    return _nodes(g, where={"mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}).select("id")


@_query("SELECT 'part:' || p_partkey AS id FROM part WHERE regexp_matches(p_brand, '(?i)^brand#1')")
def attr_regex_i(g):
    return _nodes(g, "sales", where={"brand": {"$regex": "^brand#1", "$options": "i"}}).select("id")


@_query(f"SELECT {_CUSTOMER} AS id FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")
def bool_or(g):
    return _nodes(g, type="Customer", where={"$or": [{"acctbal": {"$lt": 0}}, {"mktsegment": "MACHINERY"}]}).select("id")


@_query(f"SELECT {_CUSTOMER} AS id FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AND NOT c_acctbal > 9000")
def bool_nor_not(g):
    return _nodes(g, type="Customer", where={"$nor": [{"acctbal": {"$lt": 0}}, {"mktsegment": "MACHINERY"}], "acctbal": {"$not": {"$gt": 9000}}}).select("id")


@_query("SELECT 'supplier:' || s_suppkey AS id FROM supplier")
def attr_exists(g):
    return _nodes(g, where={"mktsegment": {"$exists": False}}).select("id")


@_query("SELECT 0 AS n")
def attr_kind_bracket(g):
    """A number is never equal to, or above, a text."""
    return _nodes(g, where={"$or": [{"acctbal": {"$gt": "0"}}, {"mktsegment": {"$lt": 10**9}}]}).agg(F.count(F.lit(1)).cast("int").alias("n"))


@_query(f"SELECT {_CUSTOMER} AS id FROM customer WHERE lower(c_mktsegment) = 'building'")
def tags_all(g):
    return _nodes(g, tags=["building"]).select("id")


@_query("SELECT event_type AS relation, count(*) AS n FROM events GROUP BY 1")
def edge_relations(g):
    return se.grouped_counts(_edges(g, "activity"), c("relation")).withColumnRenamed("value", "relation")


@_query("SELECT flavor, count(*) AS n FROM (SELECT 'hub' AS flavor FROM orders UNION ALL SELECT 'direct' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY 1")
def edge_flavors(g):
    return _edges(g).groupBy("flavor").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT 'order:' || l_orderkey AS id FROM lineitem WHERE l_partkey = 1")
def edge_members_all(g):
    return _edges(g, relation="placed", nodes="part:1").select("id")


@_query("SELECT DISTINCT 'order:' || l_orderkey AS id FROM lineitem WHERE l_partkey IN (1, 2, 3)")
def edge_members_any(g):
    return _edges(g, relation="placed", where={"members.node_id": {"$in": ["part:1", "part:2", "part:3"]}}).select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2))")
def edge_members_not_in(g):
    return _edges(g, relation="placed", where={"members.node_id": {"$nin": ["part:1", "part:2"]}}).select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders WHERE o_custkey = 1")
def edge_member_fields(g):
    """Each member field may be met by another member."""
    return _edges(g, relation="placed", where={"members": {"node_id": "customer:1", "seq": 0}}).select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1996-06-01')")
def pit_orders_at(g):
    return _edges(g, relation="placed", at="1996-06-01 00:00:00").select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'")
def edge_valid_from(g):
    return _edges(g, relation="placed", where={"valid_from": {"$gte": "1997-01-01 00:00:00"}, "attributes.status": "F"}).select("id")


@_query("SELECT 'hypernode' AS entity_type, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'hyperedge', count(*) FROM nation")
def any_union(g):
    both = se.entities(_nodes(g, "geo"), _edges(g, "geo"))
    return both.groupBy(c("_entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT p_brand AS brand, min('part:' || p_partkey) AS id FROM part GROUP BY 1")
def distinct_first(g):
    p = _nodes(g, "sales").select("id", se.attribute("brand", "string").alias("brand"))
    return se.distinct_first(p, ["brand"], ["id"])


@_query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'None', count(*) FROM supplier")
def agg_group_by(g):
    return se.grouped_counts(_nodes(g), se.attribute("mktsegment", "string"))


@_query(f"SELECT {_CUSTOMER} AS id FROM customer ORDER BY id LIMIT 20 OFFSET 10")
def skip_limit(g):
    return se.page(_nodes(g, type="Customer"), ["id"], 10, 20).select("id")


@_query("""SELECT 'geo' AS hypergraph_id, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS node_count, (SELECT count(*) FROM nation) AS edge_count, 'Nation,Region' AS types, 'in-region' AS relations
UNION ALL SELECT 'parties', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), 'Customer,Supplier', 'located-in'""")
def graph_stats(g):
    return se.stats(se.scoped(g.nodes, ["geo", "parties"]), se.scoped(g.edges, ["geo", "parties"]))


@_query("SELECT 'geo' AS hypergraph_id, 'Nation' AS type UNION ALL SELECT 'geo', 'Region' UNION ALL SELECT 'parties', 'Customer' UNION ALL SELECT 'parties', 'Supplier' UNION ALL SELECT 'sales', 'Part'")
def distinct_types(g):
    return g.nodes.select("hypergraph_id", "type").distinct()


@_query("SELECT 'region:' || r_regionkey AS r, 'nation:' || n_nationkey AS n FROM region, nation WHERE n_nationkey < 3")
def p_node_cross(g):
    r = pt.node_pattern(g, None, "r", type="Region")
    return pt.node_pattern(g, r, "n", type="Nation", where={"key": {"$lt": 3}})


@_query("SELECT 'region:' || r_regionkey AS r, 'nation:' || n_nationkey AS n FROM region, nation")
def p_node_cross_all(g):
    return pt.node_pattern(g, pt.node_pattern(g, None, "r", type="Region"), "n", type="Nation")


@_query("SELECT 'part:' || l_partkey AS p, 'order:' || o_orderkey AS e FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_custkey = 1")
def p_edge_anchor_expand(g):
    return pt.edge_pattern(g, None, "e", ["customer:1", "?p"], relation="placed")


@_query("SELECT 'customer:' || c_custkey AS cust, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def p_two_hop(g):
    b = pt.node_pattern(g, None, "cust", type="Customer", where={"acctbal": {"$gt": 9000}})
    b = pt.edge_pattern(g, b, "e1", [{"node": "?cust", "seq": 0}, {"node": "?n", "seq": 1}], relation="located-in")
    b = pt.edge_pattern(g, b, "e2", [{"node": "?n", "seq": 0}, {"node": "?r", "seq": 1}], relation="in-region")
    b = pt.documents(g, pt.documents(g, b, "n", nation=c("label")), "r", region=c("label"))
    return b.select("cust", "nation", "region")


@_query("""WITH d AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_orderkey BETWEEN 1 AND 50)
SELECT 'order:' || a.o AS e, 'part:' || a.p AS x, 'part:' || b.p AS y FROM d a JOIN d b ON a.o = b.o AND a.p <> b.p JOIN orders ON o_orderkey = a.o
UNION ALL SELECT 'order:' || o, 'customer:' || o_custkey, 'part:' || p FROM d JOIN orders ON o_orderkey = o
UNION ALL SELECT 'order:' || o, 'part:' || p, 'customer:' || o_custkey FROM d JOIN orders ON o_orderkey = o""")
def p_two_wildcards(g):
    ids = [f"order:{k}" for k in range(1, 51)]
    return pt.edge_pattern(g, None, "e", ["?x", "?y"], relation="placed", where={"id": {"$in": ids}})


@_query("""WITH d AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT 'order:' || a.o AS e, 'part:' || a.p AS x, 'part:' || b.p AS y FROM d a JOIN d b ON a.o = b.o AND a.p <> b.p JOIN orders ON o_orderkey = a.o
UNION ALL SELECT 'order:' || o, 'customer:' || o_custkey, 'part:' || p FROM d JOIN orders ON o_orderkey = o
UNION ALL SELECT 'order:' || o, 'part:' || p, 'customer:' || o_custkey FROM d JOIN orders ON o_orderkey = o""")
def p_two_wildcards_all(g):
    return pt.edge_pattern(g, None, "e", ["?x", "?y"], relation="placed")


@_query("SELECT DISTINCT 'supplier:' || l_suppkey AS s, 'nation:' || s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = 5")
def p_join_shared_var(g):
    b = pt.edge_pattern(g, None, "e", [{"node": "?s", "seq": 0}, "part:5"], relation="supplies")
    return pt.edge_pattern(g, b, "f", [{"node": "?s", "seq": 0}, {"node": "?n", "seq": 1}], relation="located-in").select("s", "n")


@_query("SELECT 'customer:' || c_custkey AS cust, o_orderkey IS NOT NULL AS has_order, CASE WHEN o_orderkey IS NOT NULL THEN 'order:' || o_orderkey END AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey WHERE c_acctbal > 8000")
def p_optional(g):
    b = pt.node_pattern(g, None, "cust", type="Customer", where={"acctbal": {"$gt": 8000}})
    big = {"relation": "placed", "where": {"totalprice": {"$gt": 300000}}}
    o = pt.optional(b, lambda x: pt.edge_pattern(g, x, "o", [{"node": "?cust", "seq": 0}], **big))
    return o.select("cust", c("o").isNotNull().alias("has_order"), "o")


@_query("SELECT 'customer:' || c_custkey AS x FROM customer WHERE c_acctbal > 9500 OR c_mktsegment = 'FURNITURE'")
def p_union(g):
    return pt.union(pt.node_pattern(g, None, "x", type="Customer", where={"acctbal": {"$gt": 9500}}), pt.node_pattern(g, None, "x", type="Customer", where={"mktsegment": "FURNITURE"}))


@_query("SELECT 'supplier:' || s_suppkey AS x, s_name AS label FROM supplier WHERE contains(lower(s_name), '9') AND starts_with(lower(s_name), 'supp') AND NOT ends_with(s_name, '0') AND s_acctbal BETWEEN 0 AND 5000")
def p_filter_text(g):
    b = pt.documents(g, pt.node_pattern(g, None, "x", type="Supplier"), "x", label=c("label"), acctbal=se.attribute("acctbal", "double"))
    low = F.lower("label")
    return b.where(low.contains("9") & low.startswith("supp") & ~c("label").endswith("0") & c("acctbal").between(0, 5000)).select("x", "label")


@_query("SELECT 'nation:' || n_nationkey AS n, n_name AS label FROM nation ORDER BY n_name, n LIMIT 5 OFFSET 3")
def p_order_limit_offset(g):
    b = pt.documents(g, pt.node_pattern(g, None, "n", type="Nation"), "n", label=c("label"))
    return se.page(b, [c("label").asc_nulls_first(), "n"], 3, 5)


@_query("""SELECT 'located-in:customer:' || c_custkey AS id, substr(sha256('{"graph":"parties","members":["customer:' || c_custkey || '","nation:' || c_nationkey || '"],"relation":"located-in"}'), 1, 32) AS hyperkey FROM customer""")
def edge_hyperkey(g):
    e = _edges(g, "parties").where(c("id").startswith("located-in:customer"))
    return e.select("id", hyperkey(c("hypergraph_id"), c("relation"), c("members.node_id")).alias("hyperkey"))


@_query("""WITH e AS (SELECT 'customer:' || c_custkey AS a, c_nationkey AS n FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier)
SELECT 'located-in:' || a AS id, substr(sha256('{"graph":"parties","members":["' || least(a, 'nation:' || n) || '","' || greatest(a, 'nation:' || n) || '"],"relation":"located-in"}'), 1, 32) AS hyperkey FROM e""")
def edge_hyperkey_all(g):
    return _edges(g, "parties").select("id", hyperkey(c("hypergraph_id"), c("relation"), c("members.node_id")).alias("hyperkey"))


@_query("SELECT 'in-region:' || n_nationkey || '_inv' AS id, 'contains' AS relation, 'region:' || n_regionkey || ',nation:' || n_nationkey AS members, 'in-region:' || n_nationkey AS source_edge FROM nation")
def inverse_edges(g):
    e = se.scoped(g.edges, "geo")
    inverses = e.sparkSession.createDataFrame([("in-region", "contains")], "relation string, inverse string")
    out = ch.inverse_edges(e, inverses)
    return out.select("id", "relation", F.array_join("members.node_id", ",").alias("members"), c("_source_edge").alias("source_edge"))


@_query("""SELECT 'nation:1' AS node_id, 0 AS depth UNION ALL SELECT 'region:' || n_regionkey, 1 FROM nation WHERE n_nationkey = 1
UNION ALL SELECT 'nation:' || n_nationkey, 2 FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) AND n_nationkey <> 1""")
def reachability(g):
    return ch.reachable(Graph(g.nodes, _edges(g, "geo", relation="in-region")).membership, "nation:1")


@_query("SELECT 'customers' AS _mesh_server_id, 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'suppliers', 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal > 9000")
def federated_union(g):
    rich = {"acctbal": {"$gt": 9000}}
    return se.federated({"customers": _nodes(g, type="Customer", where=rich).select("id"), "suppliers": _nodes(g, type="Supplier", where=rich).select("id")})


@_query("SELECT 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region")
def access_filter(g):
    allowed = g.nodes.sparkSession.createDataFrame([("geo",)], "hypergraph_id string")
    return se.visible(g.nodes, allowed).select("id")


@_query("SELECT 'region:' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS label, CASE WHEN r_regionkey IN (1, 2) THEN 2 ELSE 1 END AS version FROM region WHERE r_regionkey <> 4")
def update_and_delete(g):
    spark = g.nodes.sparkSession
    n = _nodes(g, "geo", type="Region").withColumn("version", F.lit(1)).select("id", "label", "version")
    changes = spark.createDataFrame([("region:1", "renamed"), ("region:2", None)], "id string, label string")
    return ch.deleted(ch.updated(n, changes, ["id"]), spark.createDataFrame([("region:4",)], "id string"), ["id"])


@_query("SELECT 'located-in:supplier:' || s_suppkey AS e, 'located-in' AS r FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT DISTINCT 'supplies:' || l_suppkey || ':' || l_partkey, 'supplies' FROM lineitem WHERE l_suppkey = 1")
def p_var_relation(g):
    return pt.edge_pattern(g, None, "e", ["supplier:1"], relation="?r").select("e", "r")


@_query("SELECT 'nation:' || n_nationkey AS n, 'region:' || n_regionkey AS x FROM nation")
def p_id_reference(g):
    b = pt.edge_pattern(g, None, "e", [{"node": "?n", "seq": 0}, {"node": "?r", "seq": 1}], relation="in-region")
    return pt.node_pattern(g, b, "x", id="?r", type="Region").select("n", "x")


@_query("SELECT 'customer:' || c_custkey AS x, 'nation:' || c_nationkey AS n FROM customer WHERE c_acctbal > 9000")
def p_semi_bound(g):
    b = pt.edge_pattern(g, None, "e", [{"node": "?x", "seq": 0}, {"node": "?n", "seq": 1}], relation="located-in")
    return pt.node_pattern(g, b, "x", type="Customer", where={"acctbal": {"$gt": 9000}}).select("x", "n")


@_query("SELECT DISTINCT 'nation:' || c_nationkey AS n FROM customer")
def p_distinct_rows(g):
    b = pt.edge_pattern(g, None, "e", [{"node": "?x", "seq": 0}, {"node": "?n", "seq": 1}], relation="located-in")
    return pt.node_pattern(g, b, "x", type="Customer").select("n").distinct()


@_query("SELECT 'supplier:' || s_suppkey AS x FROM supplier WHERE regexp_matches(s_name, '[13579]$') AND right(s_name, 1) IN ('1', '3')")
def p_filter_matches_in(g):
    b = pt.documents(g, pt.node_pattern(g, None, "x", type="Supplier"), "x", label=c("label"))
    return b.where(c("label").rlike("[13579]$") & F.right("label", F.lit(1)).isin("1", "3")).select("x")


@_query(f"SELECT {_CUSTOMER} AS id FROM customer WHERE c_mktsegment IS NOT NULL")
def attr_type(g):
    return _nodes(g, where={"mktsegment": {"$type": "string"}, "key": {"$type": ["int", "long"]}}).select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders WHERE o_custkey = 1")
def edge_one_member(g):
    return _edges(g, relation="placed", where={"members": {"$elemMatch": {"node_id": "customer:1", "seq": 0}}}).select("id")


@_query("SELECT 'in-region:' || n_nationkey AS id FROM nation WHERE n_nationkey = 3")
def edge_by_name(g):
    return se.edge_by(se.scoped(g.edges, "geo"), "in-region:3").select("id")


@_query("SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT 'part:' || p_partkey FROM part WHERE p_partkey = 2")
def node_batch(g):
    wanted = g.nodes.sparkSession.createDataFrame([("nation:1",), ("nation:2",), ("part:2",), ("nobody",)], "id string")
    return se.by_ids(g.nodes, wanted).select("id")


@_query("SELECT unnest(['geo', 'parties', 'sales', 'activity', 'world', 'goods']) AS hypergraph_id, unnest(['', '', '', '', 'geo,parties,goods', 'sales']) AS composition")
def graph_catalog(g):
    return se.catalog(g.nodes, g.edges, CATALOG).select("hypergraph_id", F.array_join("composition", ",").alias("composition"))


@_query(f"SELECT {_ORDER} AS id FROM orders ORDER BY o_orderdate DESC NULLS LAST, id LIMIT 20 OFFSET 5")
def edges_newest(g):
    return se.newest(_edges(g, relation="placed"), 5, 20, created="valid_from")[1].select("id")


@_query("SELECT count(*) AS total FROM orders")
def edges_newest_total(g):
    return se.newest(_edges(g, relation="placed"), 5, 20, created="valid_from")[0]


@_query("""SELECT substr(sha256('{"graph":"geo","members":["nation:' || n_nationkey || '","region:' || n_regionkey || '"],"relation":"in-region"}'), 1, 32) AS id, 1 AS version FROM nation""")
def create_edges(g):
    new = _edges(g, "geo").drop("id")
    return ch.created(new, "2024-01-01 00:00:00").select("id", "version")


@_query("SELECT 'parties' AS hypergraph_id, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n_nodes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n_edges")
def delete_graph(g):
    some = Graph(se.scoped(g.nodes, ["geo", "parties"]), se.scoped(g.edges, ["geo", "parties"]))
    rest = ch.without_graphs(some, g.nodes.sparkSession.createDataFrame([("geo",)], "hypergraph_id string"))
    n, e = (df.groupBy("hypergraph_id").agg(F.count(F.lit(1)).alias(k)) for df, k in ((rest.nodes, "n_nodes"), (rest.edges, "n_edges")))
    return n.join(e, "hypergraph_id", "full")


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by day and type by a stream that reads all files there are."""
    path = f"{ch.shared_path(spark)}/activity-{uuid.uuid4().hex}"
    files = f"{sf_dir}/events.parquet"
    # a stream takes a single file only by a pattern
    stream = spark.readStream.schema(spark.read.parquet(files).schema).parquet(f"{files}*")
    activity.keep(activity.windowed(stream), path).awaitTermination()
    return activity.state(spark, path).select(c("start").cast("string").alias("start"), "event_type", "n")


_SQL["stream_activity"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL"
