"""Graph files: one JSON object per line for nodes and edges; bad lines are counted, not dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import hyperkey
from .star import Graph

#: Columns that an import makes anew.
STAMPS = ("hypergraph_id", "hyperkey", "system_created", "system_updated", "version")


def export(graph: Graph, name: str, path: str) -> None:
    """Write one graph's nodes and edges, all of them, whatever their status."""
    for kind, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        one = df.where(F.col("hypergraph_id") == name).withColumn("attributes", F.to_json("attributes"))
        one.write.mode("overwrite").json(f"{path}/{kind}")


def _anew(df: DataFrame, name: str, at) -> DataFrame:
    """Rows under the graph's new name, with those of STAMPS that the frame has."""
    df = df.withColumn("hypergraph_id", F.lit(name))
    fresh = {"system_created": F.lit(at).cast("timestamp"), "system_updated": F.lit(at).cast("timestamp"), "version": F.lit(1)}
    if "members" in df.columns:
        fresh["hyperkey"] = hyperkey(F.col("hypergraph_id"), F.col("relation"), F.col("members.node_id"))
    return df.withColumns({c: v for c, v in fresh.items() if c in STAMPS and c in df.columns})


def load(spark: SparkSession, name: str, path: str, like: Graph, at=None) -> tuple[Graph, DataFrame]:
    """The graph under its new name, and one row with the numbers of nodes, edges and errors.

    Stamps are ``at`` (null if not given), versions 1 and hyperkeys computed anew, where ``like`` has such columns.
    """
    frames, errors = [], []
    for kind, df in (("nodes", like.nodes), ("edges", like.edges)):
        fields = ", ".join(f"`{f.name}` {'string' if f.name == 'attributes' else f.dataType.simpleString()}" for f in df.schema.fields)
        raw = spark.read.schema(f"{fields}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/{kind}")
        ok = F.col("_bad").isNull() & F.col("id").isNotNull()
        good = raw.where(ok).withColumn("attributes", F.parse_json("attributes"))
        frames.append(_anew(good.drop("_bad"), name, at))
        # the reader wants more than the bad column alone to be asked for
        errors.append(raw.select(F.lit(kind).alias("kind"), ok.alias("ok"), "_bad", "id"))
    counts = errors[0].unionByName(errors[1]).agg(F.count_if(F.col("ok") & (F.col("kind") == "nodes")).alias("nodes"), F.count_if(F.col("ok") & (F.col("kind") == "edges")).alias("edges"), F.count_if(~F.col("ok")).alias("errors"))
    return Graph(*frames), counts
