"""Inference and changes: inverse edges, reachability, updates and deletes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..functions.conditions import hyperkey
from ..sources.star import Graph


def shared_path(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local session without it gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_path(spark))


def inverse_edges(edges: DataFrame, inverses: DataFrame) -> DataFrame:
    """A reversed copy of each edge whose relation has an inverse; ``inverses`` has relation and inverse."""
    out = edges.join(inverses, "relation")
    return out.select("hypergraph_id", F.concat("id", F.lit("_inv")).alias("id"), F.col("inverse").alias("relation"), F.reverse("members").alias("members"), F.lit(True).alias("_inferred"), F.col("id").alias("_source_edge"))


def reachable(membership: DataFrame, start: str, max_depth: int = 10) -> DataFrame:
    """node_id, depth of every node within ``max_depth`` hops; members of one edge are a hop apart.

    Each hop joins the frontier to its edges and their members and drops what was reached before; the reached nodes are
    checkpointed each hop, so plans stay short. Hops end when a frontier is empty.
    """
    spark = membership.sparkSession
    shared_folder(spark)
    m = membership.select("hypergraph_id", "edge_id", "node_id").distinct().checkpoint()
    seen = spark.createDataFrame([(start, 0)], "node_id string, depth int")
    frontier = seen
    for depth in range(1, max_depth + 1):
        edges = m.join(frontier.select("node_id"), "node_id", "left_semi").select("hypergraph_id", "edge_id").distinct()
        nxt = m.join(edges, ["hypergraph_id", "edge_id"], "left_semi").select("node_id").distinct()
        frontier = nxt.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _keyed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("hyperkey", hyperkey(F.col("hypergraph_id"), F.col("relation"), F.col("members.node_id")))


def created(df: DataFrame, at) -> DataFrame:
    """New nodes or edges: both stamps are ``at``, the version is 1; edges get their hyperkey, which is the id of those without one."""
    out = df.withColumns({"system_created": F.lit(at).cast("timestamp"), "system_updated": F.lit(at).cast("timestamp"), "version": F.lit(1)})
    if "members" not in df.columns:
        return out
    out = _keyed(out)
    return out.withColumn("id", F.coalesce("id", "hyperkey") if "id" in df.columns else F.col("hyperkey"))


def without_graphs(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without those in ``gone`` (hypergraph_id): their nodes and edges go with them."""
    return Graph(*[df.join(gone, "hypergraph_id", "left_anti") for df in (graph.nodes, graph.edges)])


def inverses(nodes: DataFrame) -> DataFrame:
    """relation, inverse as the nodes of type RelationType tell, for ``inverse_edges``; of several, the smallest inverse."""
    told = nodes.where(F.col("type") == "RelationType").select(F.col("id").alias("relation"), F.try_variant_get("attributes", "$.inverse", "string").alias("inverse"))
    return told.where("inverse is not null").groupBy("relation").agg(F.min("inverse").alias("inverse"))


def updated(df: DataFrame, changes: DataFrame, keys: list[str], at=None) -> DataFrame:
    """Rows with the changes' non-null fields set and the version one higher where anything is given.

    Of changes that repeat a key, each field's largest value counts (VARIANT and maps: any that is not null), once. Edges
    with a hyperkey get it anew; changed rows with system_updated get ``at``, if given.
    """
    one = [F.any_value(f"`{f.name}`", F.lit(True)) if isinstance(f.dataType, VariantType | MapType) else F.max(f"`{f.name}`") for f in changes.schema.fields if f.name not in keys]
    others = [c for c in changes.columns if c not in keys]
    changes = changes.groupBy(*keys).agg(*[v.alias(c) for v, c in zip(one, others, strict=True)]) if others else changes.distinct()
    new = {c: f"_new_{c}" for c in changes.columns if c not in keys}
    j = df.join(changes.withColumnsRenamed(new).withColumn("_hit", F.lit(True)), keys, "left")
    j = j.withColumns({c: F.coalesce(n, c) for c, n in new.items()})
    if at is not None and "system_updated" in df.columns:
        j = j.withColumn("system_updated", F.when(F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col("system_updated")))
    if "hyperkey" in df.columns:
        j = _keyed(j)
    return j.withColumn("version", F.col("version") + F.coalesce("_hit", F.lit(False)).cast("int")).select(*df.columns)


def deleted(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone, keys, "left_anti")
