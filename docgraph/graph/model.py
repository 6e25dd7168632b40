"""Property graphs projected from collections: mappings, building, snapshots.

A graph is two DataFrames. ``nodes(id string, type string, implicit boolean, props string)``: one row for each id, ids
are shared by all types and the first mapping wins; an endpoint without a mapped node is an implicit node without a
type. ``edges(src string, dst string, type string, directed boolean, props string)``: unique by source, target and
type; an undirected edge is one row, whichever way round it was stored. props is JSON or null.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docgraph.functions.predicate import Fields, json_path, type_at, typed_field, where
from docgraph.plans.durable import cut

NODE_SCHEMA = "id string, type string, implicit boolean, props string"
EDGE_SCHEMA = "src string, dst string, type string, directed boolean, props string"
#: Nodes with more edges than this are reported as heavy.
HEAVY = 1024


@dataclass
class NodeMapping:
    """A node of ``type`` for each document of ``collection`` that matches ``where``; the id is the value at ``key``."""

    type: str
    collection: str
    key: str = "_id"
    properties: list[str] = field(default_factory=list)
    where: object = None


@dataclass
class EdgeMapping:
    """An edge of ``type`` from each document: from an edge collection, an embedded key, or one per element of ``unwind``.

    With ``unwind`` the source or target path may be the name ``alias`` of the element.
    """

    type: str
    collection: str
    source: str
    target: str
    source_type: str | None = None
    target_type: str | None = None
    unwind: str | None = None
    alias: str | None = None
    directed: bool | None = None
    properties: list[str] = field(default_factory=list)


@dataclass
class GraphDefinition:
    name: str
    mode: str = "live"
    directed: bool = True
    heterogeneous: bool = False
    where: object = None
    nodes: list[NodeMapping] = field(default_factory=list)
    edges: list[EdgeMapping] = field(default_factory=list)


@dataclass
class Graph:
    """Nodes and edges, and how many documents made them."""

    nodes: DataFrame
    edges: DataFrame
    nodes_built: int = 0
    edges_built: int = 0
    version: int = 1
    #: Nodes without the implicit ones, where the graph was built from mappings.
    mapped: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def typed(self, edge_type: str | None = None) -> DataFrame:
        """Edges of a type, or all."""
        return self.edges.filter(F.col("type") == edge_type) if edge_type else self.edges

    def out(self, edge_type: str | None = None) -> DataFrame:
        """Distinct (src, dst) steps along edges; undirected edges lead both ways."""
        edges = self.typed(edge_type)
        back = edges.filter(~F.col("directed")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return edges.select("src", "dst").union(back).distinct()

    def both(self, edge_type: str | None = None) -> DataFrame:
        """Distinct (src, dst) steps either way, without loops."""
        edges = self.typed(edge_type).filter("src <> dst").select("src", "dst")
        return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def steps(self, direction: str, edge_type: str | None = None) -> DataFrame:
        """(src, dst) steps for out, in or both."""
        if direction == "out":
            return self.out(edge_type)
        if direction == "in":
            return self.out(edge_type).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if direction == "both":
            return self.both(edge_type)
        raise ValueError("direction must be out, in or both")

    def degrees(self) -> DataFrame:
        """(id, type, in, out, total): edges count in the direction in which they are stored, zero included."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select(F.col("dst"), F.lit(0), F.lit(1)))
        sums = ends.groupBy("id").agg(F.sum("i").alias("in"), F.sum("o").alias("out"))
        held = self.nodes.select("id", "type").join(sums, "id", "left").fillna(0, ["in", "out"])
        return held.withColumn("total", F.col("in") + F.col("out"))

    def persist(self) -> Graph:
        self.nodes.persist()
        self.edges.persist()
        return self

    def stored(self) -> Graph:
        """The graph written once to the shared folder; edges are not made again for the implicit nodes."""
        edges = cut(self.edges)
        return replace(self, nodes=cut(self.nodes if self.mapped is None else with_implicit(self.mapped, edges)), edges=edges, mapped=None)

    def write(self, path: str) -> None:
        """Parquet below ``path``; :func:`read` gives the graph back."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def _text(df: DataFrame, path: str) -> Column:
    fields = Fields(df.schema)
    if fields.schemaless and path != "_id":
        return F.try_variant_get("doc", json_path(path), "string")
    return typed_field(path).cast("string") if type_at(df.schema, path) is not None else F.lit(None).cast("string")


def _properties(df: DataFrame, paths: list[str]) -> Column:
    fields = Fields(df.schema)
    named = [fields.value(p).alias(p) for p in paths if fields.kind(p) is not None]
    return F.to_json(F.struct(*named)) if named else F.lit(None).cast("string")


def mapped_nodes(df: DataFrame, mapping: NodeMapping) -> DataFrame:
    """(id, type, props): one row for each document with a key."""
    held = where(df, mapping.where)
    return held.select(_text(held, mapping.key).alias("id"), F.lit(mapping.type).alias("type"), _properties(held, mapping.properties).alias("props")).filter("id is not null and id <> ''")


def _elements(df: DataFrame, path: str) -> Column:
    fields = Fields(df.schema)
    if fields.schemaless and path != "_id":
        return F.try_variant_get("doc", json_path(path), "array<string>")
    kind = type_at(df.schema, path)
    return typed_field(path).cast("array<string>") if isinstance(kind, T.ArrayType) else F.lit(None).cast("array<string>")


def mapped_edges(df: DataFrame, mapping: EdgeMapping, directed: bool = True) -> DataFrame:
    """(src, dst, type, directed, props, doc): one row for each edge; ``doc`` tells documents apart. Empty ends make no edge."""
    held = df.withColumn("__row", F.monotonically_increasing_id())
    props = _properties(df, mapping.properties)
    if mapping.unwind:
        if mapping.alias not in (mapping.source, mapping.target):
            raise ValueError(f"UNWIND alias '{mapping.alias}' must be the source or the target")
        ends = {end: F.col("__item") if path == mapping.alias else _text(df, path) for end, path in (("src", mapping.source), ("dst", mapping.target))}
        held = held.withColumn("__item", F.explode(_elements(df, mapping.unwind)))
    else:
        ends = {"src": _text(df, mapping.source), "dst": _text(df, mapping.target)}
    is_directed = directed if mapping.directed is None else mapping.directed
    rows = held.select(ends["src"].alias("src"), ends["dst"].alias("dst"), F.lit(mapping.type).alias("type"), F.lit(is_directed).alias("directed"), props.alias("props"), F.col("__row").alias("doc"))
    return rows.filter("src is not null and dst is not null and src <> '' and dst <> ''")


def unique_nodes(rows: DataFrame) -> DataFrame:
    """One row for each id of (order, id, type, props): the first mapping wins."""
    return rows.groupBy("id").agg(F.min(F.struct("order", "type", "props")).alias("n")).select("id", "n.type", F.lit(False).alias("implicit"), "n.props")


def unique_edges(rows: DataFrame) -> DataFrame:
    """One row for each (src, dst, type); of an undirected pair stored both ways, the smaller."""
    low, high = (F.when(F.col("directed"), a).otherwise(b) for a, b in ((F.col("src"), F.least("src", "dst")), (F.col("dst"), F.greatest("src", "dst"))))
    keyed = rows.groupBy(low.alias("low"), high.alias("high"), "type").agg(F.min(F.struct("src", "dst", "directed", "props")).alias("e"))
    return keyed.select("e.src", "e.dst", "type", "e.directed", "e.props")


def with_implicit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds endpoints that no mapping made."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    missing = ends.join(nodes, "id", "left_anti").select("id", F.lit(None).cast("string").alias("type"), F.lit(True).alias("implicit"), F.lit(None).cast("string").alias("props"))
    return nodes.unionByName(missing)


def build(definition: GraphDefinition, collections: dict[str, DataFrame], spark: SparkSession, what: str = "all", count: bool = True) -> Graph:
    """Compiles the mappings; ``what`` is all, nodes or edges. Lazy but for the counts of documents."""
    node_rows = edge_rows = None
    for order, mapping in enumerate(definition.nodes if what != "edges" else []):
        part = mapped_nodes(where(collections[mapping.collection], definition.where), mapping).withColumn("order", F.lit(order))
        node_rows = part if node_rows is None else node_rows.unionByName(part)
    for order, mapping in enumerate(definition.edges if what != "nodes" else []):
        part = mapped_edges(collections[mapping.collection], mapping, definition.directed).withColumn("mapping", F.lit(order))
        edge_rows = part if edge_rows is None else edge_rows.unionByName(part)
    nodes = unique_nodes(node_rows) if node_rows is not None else spark.createDataFrame([], NODE_SCHEMA)
    edges = unique_edges(edge_rows) if edge_rows is not None else spark.createDataFrame([], EDGE_SCHEMA)
    graph = Graph(with_implicit(nodes, edges), edges, mapped=nodes)
    if count:
        graph.nodes_built = node_rows.count() if node_rows is not None else 0
        graph.edges_built = edge_rows.select("mapping", "doc").distinct().count() if edge_rows is not None else 0
    return graph


def subgraph(graph: Graph, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> Graph:
    """Nodes and edges of given types; an edge needs both ends."""
    nodes = graph.nodes.filter(F.col("type").isin(node_types)) if node_types else graph.nodes
    edges = graph.edges.filter(F.col("type").isin(edge_types)) if edge_types else graph.edges
    if node_types:
        edges = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "directed", "props")
    return Graph(nodes, edges, version=graph.version)


def stats(graph: Graph) -> DataFrame:
    """One row: active_nodes, active_edges, heavy_nodes."""
    nodes = graph.degrees().agg(F.count("*").alias("active_nodes"), F.coalesce(F.sum((F.col("total") > HEAVY).cast("long")), F.lit(0)).alias("heavy_nodes"))
    return nodes.join(graph.edges.agg(F.count("*").alias("active_edges"))).select("active_nodes", "active_edges", "heavy_nodes")
