"""The star schema as hypergraphs: frames of nodes and edges, evaluated lazily.

Nodes: hypergraph_id, id, label, type, status, tags, attributes (VARIANT), valid_from, valid_to. Edges: hypergraph_id, id,
relation, flavor, status, tags, attributes, members (array of node_id, seq), valid_from, valid_to. A graph's frames are
independent branches of a union, so a filter on hypergraph_id leaves the other branches' files unread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @property
    def membership(self) -> DataFrame:
        """One row per member: hypergraph_id, edge_id, pos, node_id, seq."""
        return self.edges.select("hypergraph_id", F.col("id").alias("edge_id"), F.posexplode("members").alias("pos", "m")).select("hypergraph_id", "edge_id", "pos", "m.node_id", "m.seq")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def attributes(**fields: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])))


def _node(df: DataFrame, graph: str, prefix: str, column: str, label: str, kind: str, tags: Column | None = None, **attrs: Column) -> DataFrame:
    never = F.lit(None).cast("timestamp")
    tags = F.array().cast("array<string>") if tags is None else tags
    return df.select(F.lit(graph).alias("hypergraph_id"), key(prefix, column).alias("id"), F.col(label).cast("string").alias("label"), F.lit(kind).alias("type"), F.lit("active").alias("status"), tags.alias("tags"), attributes(key=F.col(column), **attrs).alias("attributes"), never.alias("valid_from"), never.alias("valid_to"))


def _edge(df: DataFrame, graph: str, edge_id: Column, relation: Column, flavor: str, members: Column, start: Column | None = None, stop: Column | None = None, **attrs: Column) -> DataFrame:
    never = F.lit(None).cast("timestamp")
    return df.select(F.lit(graph).alias("hypergraph_id"), edge_id.alias("id"), relation.alias("relation"), F.lit(flavor).alias("flavor"), F.lit("active").alias("status"), F.array().cast("array<string>").alias("tags"), attributes(**(attrs or {"none": F.lit(None).cast("string")})).alias("attributes"), members.alias("members"), (never if start is None else start).alias("valid_from"), (never if stop is None else stop).alias("valid_to"))


def _pair(a: Column, b: Column) -> Column:
    return F.array(F.struct(a.alias("node_id"), F.lit(0).alias("seq")), F.struct(b.alias("node_id"), F.lit(1).alias("seq")))


def load(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = F.col
    orders, items = t("orders"), t("lineitem")
    nodes = [
        _node(t("region"), "geo", "region", "r_regionkey", "r_name", "Region"),
        _node(t("nation"), "geo", "nation", "n_nationkey", "n_name", "Nation"),
        _node(t("customer"), "parties", "customer", "c_custkey", "c_name", "Customer", F.array(F.lower("c_mktsegment")), acctbal=c("c_acctbal"), mktsegment=c("c_mktsegment")),
        _node(t("supplier"), "parties", "supplier", "s_suppkey", "s_name", "Supplier", acctbal=c("s_acctbal")),
        _node(t("part"), "sales", "part", "p_partkey", "p_name", "Part", brand=c("p_brand"), type=c("p_type"), size=c("p_size"), retailprice=c("p_retailprice")),
    ]
    # an order's members: the customer, then its distinct parts by key
    parts = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    bought = F.transform(F.coalesce("parts", F.array().cast("array<bigint>")), lambda p, i: F.struct(F.concat(F.lit("part:"), p.cast("string")).alias("node_id"), (i + 1).alias("seq")))
    placed = orders.join(parts, orders.o_orderkey == parts.l_orderkey, "left")
    supplies = items.select("l_suppkey", "l_partkey").distinct()
    to = lambda name: F.lit(name)
    edges = [
        _edge(t("nation"), "geo", key("in-region", "n_nationkey"), to("in-region"), "direct", _pair(key("nation", "n_nationkey"), key("region", "n_regionkey"))),
        _edge(t("customer"), "parties", key("located-in:customer", "c_custkey"), to("located-in"), "direct", _pair(key("customer", "c_custkey"), key("nation", "c_nationkey"))),
        _edge(t("supplier"), "parties", key("located-in:supplier", "s_suppkey"), to("located-in"), "direct", _pair(key("supplier", "s_suppkey"), key("nation", "s_nationkey"))),
        _edge(placed, "sales", key("order", "o_orderkey"), to("placed"), "hub", F.concat(F.array(F.struct(key("customer", "o_custkey").alias("node_id"), F.lit(0).alias("seq"))), bought), c("o_orderdate").cast("timestamp"), F.when(c("o_orderstatus") != "O", c("o_orderdate").cast("timestamp") + F.expr("interval 90 days")), status=c("o_orderstatus"), totalprice=c("o_totalprice"), priority=c("o_orderpriority")),
        _edge(supplies, "sales", F.concat(key("supplies", "l_suppkey"), F.lit(":"), c("l_partkey").cast("string")), to("supplies"), "direct", _pair(key("supplier", "l_suppkey"), key("part", "l_partkey"))),
        _edge(t("events"), "activity", key("event", "event_id"), c("event_type"), "hub", F.array(F.struct(key("user", "user_id").alias("node_id"), F.lit(0).alias("seq"))), c("ts").cast("timestamp"), value=c("value")),
    ]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Graph(union(nodes), union(edges))
