"""Filters, projections, paging and counts over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import condition, has_members, has_tags, hyperkey, valid_at


def scoped(df: DataFrame, graphs: str | list[str], catalog: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of the named graphs; a logical graph stands for the graphs it is composed of, at any depth."""
    names, open_ = set(), [graphs] if isinstance(graphs, str) else list(graphs)
    seen = set()
    while open_:
        g = open_.pop()
        if g in seen:
            continue
        seen.add(g)
        if catalog and g in catalog:
            open_ += catalog[g]
        else:
            names.add(g)
    return df.where(F.col("hypergraph_id").isin(sorted(names)))


def matched(df: DataFrame, *, where: dict | None = None, tags=None, nodes=None, status: str | None = "active", at=None, **equal) -> DataFrame:
    """Rows that meet everything given; ``equal`` names columns (type, relation, flavor, id). Status is active unless given here or in ``where``."""
    tests: list[Column] = [F.col(k) == v for k, v in equal.items()]
    if status and not (status == "active" and where and "status" in where):
        tests.append(F.col("status") == status)
    if tags:
        tests.append(has_tags(tags))
    if nodes:
        tests.append(has_members(nodes))
    if at is not None:
        tests.append(valid_at(at))
    if where:
        tests.append(condition(where, df.columns))
    for t in tests:
        df = df.where(t)
    return df


def attribute(path: str, kind: str) -> Column:
    return F.try_variant_get("attributes", "$" + "".join(f'["{p}"]' for p in path.split(".")), kind)


def entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one bag, with ``_entity_type``."""
    n, e = nodes.withColumn("_entity_type", F.lit("hypernode")), edges.withColumn("_entity_type", F.lit("hyperedge"))
    return n.unionByName(e, allowMissingColumns=True)


def distinct_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def newest(df: DataFrame, skip: int = 0, limit: int = 50, created: str = "system_created") -> tuple[DataFrame, DataFrame]:
    """One row with the total, and a page of the rows, newest first; rows of one time by graph and id, those without a time last."""
    order = [F.col(created).desc_nulls_last(), "hypergraph_id", "id"]
    return df.agg(F.count(F.lit(1)).alias("total")), page(df, order, skip, limit)


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of any status and time whose id is in ``ids`` (id)."""
    return df.join(ids.select("id"), "id", "left_semi")


def edge_by(edges: DataFrame, name: str) -> DataFrame:
    """Edges by id or hyperkey; the key is computed where the frame holds none."""
    key = F.col("hyperkey") if "hyperkey" in edges.columns else hyperkey(F.col("hypergraph_id"), F.col("relation"), F.col("members.node_id"))
    return edges.where((F.col("id") == name) | (key == name))


def catalog(nodes: DataFrame, edges: DataFrame, logical: dict[str, list[str]] | None = None) -> DataFrame:
    """hypergraph_id, kind (physical, logical), composition of every graph: those that rows name, and the logical ones."""
    named = nodes.select("hypergraph_id").unionByName(edges.select("hypergraph_id")).distinct()
    out = named.select("hypergraph_id", F.lit("physical").alias("kind"), F.array().cast("array<string>").alias("composition"))
    rows = [(k, "logical", v) for k, v in (logical or {}).items()]
    return out.unionByName(nodes.sparkSession.createDataFrame(rows, out.schema)) if rows else out


def pruned(df: DataFrame) -> DataFrame:
    """Without the ``skos_`` columns, which results don't show."""
    return df.drop(*[c for c in df.columns if c.startswith("skos_")])


def grouped_counts(df: DataFrame, field: Column) -> DataFrame:
    return df.groupBy(F.coalesce(field.cast("string"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: active nodes and edges, and the sorted distinct types and relations of any status."""
    n = nodes.groupBy("hypergraph_id").agg(F.count_if(F.col("status") == "active").alias("node_count"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    e = edges.groupBy("hypergraph_id").agg(F.count_if(F.col("status") == "active").alias("edge_count"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))
    return n.join(e, "hypergraph_id", "full").fillna(0, ["node_count", "edge_count"]).fillna("", ["types", "relations"])


def visible(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of the graphs in ``allowed`` (hypergraph_id)."""
    return df.join(allowed, "hypergraph_id", "left_semi")


def federated(parts: dict[str, DataFrame], limit: int | None = None, order: list | None = None) -> DataFrame:
    """Each server's rows, limited per server, with ``_mesh_server_id``."""
    out = None
    for server, df in parts.items():
        own = (df if limit is None else df.orderBy(*order or df.columns).limit(limit)).withColumn("_mesh_server_id", F.lit(server))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
