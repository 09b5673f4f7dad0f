"""Pattern matching as joins: bindings are frames with one id column per variable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.star import Graph
from .select import matched


def node_pattern(graph: Graph, bindings: DataFrame | None, var: str, **match) -> DataFrame:
    """Bind ``var`` to matching nodes: a semi join if it is bound already, else a cross product with the bindings so far.

    ``id="?x"`` means the node that x is bound to. A product of two unlinked patterns is what such a query asks for; link
    them by an edge pattern first to avoid it.
    """
    same = match.get("id")
    if isinstance(same, str) and same.startswith("?"):
        match.pop("id")
        if bindings is None or same[1:] not in bindings.columns:
            raise ValueError(f"{same} is not bound")
        return node_pattern(graph, bindings.withColumn(var, F.col(same[1:])), var, **match)
    found = matched(graph.nodes, **match).select(F.col("id").alias(var))
    if bindings is None:
        return found
    return bindings.join(found, var, "left_semi") if var in bindings.columns else bindings.crossJoin(found)


def _holds(m: dict) -> Column:
    """Whether an edge has the literal member."""
    return F.exists("members", lambda x: (x["node_id"] == m["node"]) & (x["seq"] == m["seq"] if "seq" in m else F.lit(True)))


def edge_pattern(graph: Graph, bindings: DataFrame | None, var: str, members: list[str | dict], **match) -> DataFrame:
    """Bind ``var`` to matching edges and each member variable to one of the edge's members, no member twice.

    A member is ``"?v"``, a literal id, or a dictionary of ``node`` (either) and ``seq``. Variables bound before must agree.
    ``relation="?r"`` takes the relation from a variable, and binds it where it is not bound yet. Literals come first: they
    narrow the edges before the others spread over them. Members come from the matched edges' own lists, so nothing is joined
    but the bindings.
    """
    relation = match.get("relation")
    relation = match.pop("relation")[1:] if isinstance(relation, str) and relation.startswith("?") else None
    asked = sorted(({"node": m} if isinstance(m, str) else m for m in members), key=lambda m: m["node"].startswith("?"))
    out = matched(graph.edges, **match)
    for m in asked:
        if not m["node"].startswith("?"):
            out = out.where(_holds(m))
    out = out.select(F.col("id").alias(var), F.col("members").alias("_members"), *([F.col("relation").alias(relation)] if relation else []))
    before: list[str] = []
    for k, m in enumerate(asked):
        node, pos = m["node"], f"_pos{k}"
        out = out.select("*", F.posexplode("_members").alias(pos, "_m"))
        if "seq" in m:
            out = out.where(F.col("_m.seq") == m["seq"])
        if not node.startswith("?"):
            out = out.where(F.col("_m.node_id") == node)
        for other in before:
            out = out.where(F.col(pos) != F.col(other))
        before.append(pos)
        name = node[1:]
        if node.startswith("?"):
            out = out.where(F.col(name) == F.col("_m.node_id")) if name in out.columns else out.withColumn(name, F.col("_m.node_id"))
        out = out.drop("_m")
    out = out.drop("_members", *before)
    if bindings is None:
        return out
    shared = [c for c in out.columns if c in bindings.columns]
    return bindings.join(out, shared) if shared else bindings.crossJoin(out)


def optional(bindings: DataFrame, extend: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Left outer: bindings that ``extend`` cannot extend stay, with nulls."""
    keys = bindings.columns
    more = extend(bindings.distinct()).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return bindings.join(more, same, "left").drop(*[f"_of_{k}" for k in keys])


def union(*branches: DataFrame) -> DataFrame:
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out.dropDuplicates()


def documents(graph: Graph, bindings: DataFrame, var: str, **fields) -> DataFrame:
    """Fields of the node or edge bound to ``var``, joined last: ``name=Column`` over its document."""
    rows = graph.nodes.select(F.col("id").alias(var), *[c.alias(k) for k, c in fields.items()])
    return bindings.join(rows, var, "left")


def edge_documents(graph: Graph, bindings: DataFrame, var: str, **fields) -> DataFrame:
    rows = graph.edges.select(F.col("id").alias(var), *[c.alias(k) for k, c in fields.items()])
    return bindings.join(rows, var, "left")


def is_type(bindings: DataFrame, column: str, kind: str) -> DataFrame:
    """Bindings whose documents are of the type; where there is no such column, as for edges, none."""
    return bindings.where(F.coalesce(F.col(column) == kind, F.lit(False)) if column in bindings.columns else F.lit(False))
