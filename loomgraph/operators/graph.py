"""Neighbourhoods and traversal over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.session import cut_lineage


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows with the node of their ``id``; ids without a node give no row."""
    return wanted.join(nodes, "id")


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints exist, with the endpoints' names.

    Two equi-joins on the node id. A hub only makes the edge side of a join
    lopsided, which adaptive execution splits; the node side is unique.
    """
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id"))
    ends = nodes.select("id", label.alias("label"))
    source = ends.select(F.col("id").alias("from_id"), F.col("label").alias("source"))
    target = ends.select(F.col("id").alias("to_id"), F.col("label").alias("target"))
    return (
        edges.select("from_id", "to_id", F.col("relationship_name").alias("relationship"))
        .join(source, "from_id")
        .join(target, "to_id")
    )


def neighbours_of(edges: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges touching each wanted ``node_id`` from either end; a self-loop appears once."""
    touching = (
        edges.join(wanted, edges.from_id == wanted.node_id).select(edges["*"], "node_id")
    ).unionByName(
        edges.filter("from_id <> to_id")
        .join(wanted, F.col("to_id") == F.col("node_id"))
        .select(edges["*"], "node_id")
    )
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id"))
    ends = nodes.select("id", label.alias("label"))
    return (
        touching.select("node_id", "from_id", "to_id", "relationship_name")
        .join(ends.select(F.col("id").alias("from_id"), F.col("label").alias("source")), "from_id")
        .join(ends.select(F.col("id").alias("to_id"), F.col("label").alias("target")), "to_id")
        .select("node_id", "source", F.col("relationship_name").alias("relationship"), "target")
    )


def neighbourhoods(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One-hop neighbourhood of every node: each edge once per distinct endpoint."""
    return named_edges(edges, nodes).select(
        F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node_id"),
        "source",
        "relationship",
        "target",
    )


def degrees(edges: DataFrame) -> DataFrame:
    """In-plus-out degree per node; counts combine map-side."""
    ends = edges.select(
        F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node_id")
    )
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def reachable(
    edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False
) -> DataFrame:
    """Nodes within ``depth`` hops of each start, with the smallest hop count.

    Each round joins only the newest frontier and drops what is already known,
    so a cycle ends the walk. Every frontier is written to the shared checkpoint
    folder once: later rounds and the result read it, none is computed twice.
    """
    here, there = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    step = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()
    known = starts.select(
        F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(0).alias("depth")
    ).distinct()
    frontier = known
    if depth > 1:
        step, known = cut_lineage(step), cut_lineage(known)
        frontier = known
    for hop in range(1, depth + 1):
        found = (
            frontier.join(step, "node")
            .select("start", F.col("next").alias("node"))
            .distinct()
            .join(known.select("start", "node"), ["start", "node"], "left_anti")
            .withColumn("depth", F.lit(hop))
        )
        if hop < depth:
            found = cut_lineage(found)
            if found.isEmpty():
                break
        known = known.unionByName(found)
        frontier = found
    return known
