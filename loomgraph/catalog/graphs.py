"""Graph queries over the typed property graph of the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomgraph.catalog.registry import query
from loomgraph.operators import graph
from loomgraph.operators.results import flatten_properties
from loomgraph.operators.upsert import merge_latest
from loomgraph.sources.tables import table

NODES_SQL = """
    nodes as (
        select 'order:' || o_orderkey as id, 'order' as type, o_orderstatus as name from orders
        union all select 'customer:' || c_custkey, 'customer', c_name from customer
        union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier
        union all select 'part:' || p_partkey, 'part', p_name from part
        union all select 'nation:' || n_nationkey, 'nation', n_name from nation
        union all select 'region:' || r_regionkey, 'region', r_name from region)"""

EDGES_SQL = """
    raw as (
        select 'order:' || l_orderkey as from_id, 'part:' || l_partkey as to_id, 'contains' as relationship_name from lineitem
        union all select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by' from lineitem
        union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' from orders
        union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in' from customer
        union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in' from supplier
        union all select 'nation:' || n_nationkey, 'region:' || n_regionkey, 'located_in' from nation
        union all select 'nation:' || n_nationkey, 'nation:' || n_regionkey, 'borders' from nation),
    edges as (select distinct * from raw)"""


def _id(kind: str, key: str):
    return F.concat(F.lit(kind + ":"), key)


def trade_nodes(spark, folder) -> DataFrame:
    parts = [
        ("orders", "order", "o_orderkey", "o_orderstatus"),
        ("customer", "customer", "c_custkey", "c_name"),
        ("supplier", "supplier", "s_suppkey", "s_name"),
        ("part", "part", "p_partkey", "p_name"),
        ("nation", "nation", "n_nationkey", "n_name"),
        ("region", "region", "r_regionkey", "r_name"),
    ]
    selects = [
        table(spark, folder, source).select(
            _id(kind, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name")
        )
        for source, kind, key, name in parts
    ]
    return reduce(DataFrame.unionByName, selects)


def trade_edges(spark, folder) -> DataFrame:
    """Union of labelled selects; duplicates removed by one map-side combined distinct."""
    parts = [
        ("lineitem", "order", "l_orderkey", "part", "l_partkey", "contains"),
        ("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "supplied_by"),
        ("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
        ("customer", "customer", "c_custkey", "nation", "c_nationkey", "located_in"),
        ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "located_in"),
        ("nation", "nation", "n_nationkey", "region", "n_regionkey", "located_in"),
        ("nation", "nation", "n_nationkey", "nation", "n_regionkey", "borders"),
    ]
    selects = [
        table(spark, folder, source).select(
            _id(a, ka).alias("from_id"), _id(b, kb).alias("to_id"), F.lit(rel).alias("relationship_name")
        )
        for source, a, ka, b, kb, rel in parts
    ]
    return reduce(DataFrame.unionByName, selects).distinct()


@query("edges_typed_union", f"with {EDGES_SQL} select * from edges")
def edges_typed_union(spark, folder):
    return trade_edges(spark, folder)


@query(
    "neighbors_1hop",
    f"""with {NODES_SQL}, {EDGES_SQL},
    e as (select unnest(list_distinct([from_id, to_id])) as node_id, * from edges)
    select e.node_id, a.name as source, e.relationship_name as relationship, b.name as target
    from e join nodes a on a.id = e.from_id join nodes b on b.id = e.to_id""",
)
def neighbors_1hop(spark, folder):
    """One-hop neighbourhood, both directions, of every node of the graph."""
    return graph.neighbourhoods(trade_edges(spark, folder), trade_nodes(spark, folder))


@query(
    "neighbors_of_suppliers",
    f"""with {NODES_SQL}, {EDGES_SQL},
    e as (select unnest(list_distinct([from_id, to_id])) as node_id, * from edges)
    select e.node_id, a.name as source, e.relationship_name as relationship, b.name as target
    from e join nodes a on a.id = e.from_id join nodes b on b.id = e.to_id
    where e.node_id in (select 'supplier:' || s_suppkey from supplier)""",
)
def neighbors_of_suppliers(spark, folder):
    """The lookup form: edges of a table of wanted nodes (all suppliers)."""
    wanted = table(spark, folder, "supplier").select(_id("supplier", "s_suppkey").alias("node_id"))
    return graph.neighbours_of(trade_edges(spark, folder), trade_nodes(spark, folder), wanted)


@query(
    "node_degree",
    f"""with {EDGES_SQL},
    e as (select unnest(list_distinct([from_id, to_id])) as node_id from edges)
    select node_id, count(*) as degree from e group by all""",
)
def node_degree(spark, folder):
    return graph.degrees(trade_edges(spark, folder))


@query(
    "node_lookup",
    f"with {NODES_SQL} select o_orderkey, n.type, n.name from orders join nodes n on n.id = 'customer:' || o_custkey",
)
def node_lookup(spark, folder):
    """Point lookup of nodes by id in batch form: the customer node of every order."""
    wanted = table(spark, folder, "orders").select("o_orderkey", _id("customer", "o_custkey").alias("id"))
    return graph.lookup(trade_nodes(spark, folder), wanted).select("o_orderkey", "type", "name")


def _khop_sql(start: str, depth: int, here: str, there: str) -> str:
    return f"""
    with recursive {EDGES_SQL},
    walk as (
        select id as start, id as node, 0 as depth from ({start})
        union
        select w.start, e.{there}, w.depth + 1 from walk w join edges e on e.{here} = w.node
        where w.depth < {depth})
    select start, node, min(depth)::int as depth from walk group by start, node"""


@query(
    "khop_dependencies",
    _khop_sql("select 'customer:' || c_custkey as id from customer", 5, "from_id", "to_id"),
)
def khop_dependencies(spark, folder):
    """All nodes each customer leads to; the nation edges contain cycles."""
    starts = table(spark, folder, "customer").select(_id("customer", "c_custkey").alias("node_id"))
    return graph.reachable(trade_edges(spark, folder), starts, 5)


@query(
    "khop_dependents",
    _khop_sql("select 'region:' || r_regionkey as id from region", 3, "to_id", "from_id"),
)
def khop_dependents(spark, folder):
    """All nodes that lead to each region within three hops."""
    starts = table(spark, folder, "region").select(_id("region", "r_regionkey").alias("node_id"))
    return graph.reachable(trade_edges(spark, folder), starts, 3, reverse=True)


@query(
    "node_upsert",
    """
    select user_id as id, arg_max(event_type, {t: ts, e: event_id}) as name,
        arg_max(props, {t: ts, e: event_id}) as properties,
        min(ts) as created_at, max(ts) as updated_at
    from events group by user_id
    """,
)
def node_upsert(spark, folder):
    """Events as versions of user nodes: newest values, first creation time."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("name"),
        F.col("props").alias("properties"), F.col("ts").alias("_at"), "event_id",
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    return merge_latest(rows, ["id"], ["_at", "event_id"], "created_at", "updated_at")


@query(
    "edge_upsert",
    """
    select l_partkey as from_id, l_suppkey as to_id, l_returnflag as relationship_name,
        arg_max(l_quantity, {a: l_shipdate, b: l_orderkey, c: l_linenumber, d: l_quantity}) as weight,
        min(l_shipdate) as created_at, max(l_shipdate) as updated_at
    from lineitem group by all
    """,
)
def edge_upsert(spark, folder):
    """Line items as versions of part-supplier edges."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"),
        F.col("l_returnflag").alias("relationship_name"), F.col("l_quantity").alias("weight"),
        F.col("l_shipdate").alias("_at"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("_w"), F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"),
    )
    return merge_latest(
        rows, ["from_id", "to_id", "relationship_name"],
        ["_at", "l_orderkey", "l_linenumber", "_w"], "created_at", "updated_at",
    )


@query(
    "node_properties",
    "select event_id, event_type, (props->>'$.k')::bigint as k, props->>'$.missing' as missing from events",
)
def node_properties(spark, folder):
    """JSON properties of nodes as columns; absent keys are null."""
    rows = table(spark, folder, "events").select("event_id", "event_type", "props")
    return flatten_properties(rows, "props", {"k": "bigint", "missing": "string"})
