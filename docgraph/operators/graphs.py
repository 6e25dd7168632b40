"""Reading a graph: neighbours, traversal, paths, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docgraph.graph.model import Graph
from docgraph.plans.durable import cut

#: The longest path that ShortestPath and AreConnected look for.
DEEPEST = 12


def has_node(graph: Graph, node: str) -> DataFrame:
    return graph.nodes.filter(F.col("id") == node).limit(1).agg((F.count("*") > 0).alias("exists"))


def edge_exists(graph: Graph, source: str, target: str, edge_type: str | None = None) -> DataFrame:
    """One row: whether there is a step from source to target; undirected edges lead both ways."""
    return graph.out(edge_type).filter((F.col("src") == source) & (F.col("dst") == target)).limit(1).agg((F.count("*") > 0).alias("exists"))


def get_node(graph: Graph, node: str, node_type: str | None = None) -> DataFrame:
    found = graph.nodes.filter(F.col("id") == node)
    return found.filter(F.col("type") == node_type) if node_type else found


def neighbors(graph: Graph, node: str, direction: str = "out", edge_type: str | None = None, limit: int = 0) -> DataFrame:
    """(id), sorted."""
    ids = graph.steps(direction, edge_type).filter(F.col("src") == node).select(F.col("dst").alias("id")).orderBy("id")
    return ids.limit(limit) if limit else ids


def spread(steps: DataFrame, start: DataFrame, most: int | None) -> DataFrame:
    """(source, id, distance): breadth-first from every row of ``start(source, id)`` along ``steps(src, dst)``.

    One job a level; each level and what it has seen are written once, so that plans stay short. The starts have
    distance 0. Stops when a level is empty or after ``most`` levels.
    """
    steps = steps.select(F.col("src").alias("id"), "dst")
    steps = steps if most == 1 else cut(steps)
    seen = cut(start.select("source", "id", F.lit(0).alias("distance")).distinct())
    front, level = seen, 0
    while most is None or level < most:
        level += 1
        reached = front.join(steps, "id").select("source", F.col("dst").alias("id")).distinct()
        front = cut(reached.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("distance", F.lit(level)))
        if not front.take(1):
            break
        seen = seen.union(front)
    return seen


def from_source(graph: Graph, node: str) -> DataFrame:
    return graph.nodes.filter(F.col("id") == node).select(F.col("id").alias("source"), "id")


def traverse(graph: Graph, node: str, direction: str = "out", edge_type: str | None = None, depth: int = 1, limit: int = 100) -> DataFrame:
    """(id, distance) of what is reached within ``depth`` steps, nearest first, without the start; ``limit`` 0 is unlimited."""
    start = graph.spark.createDataFrame([(node, node)], "source string, id string")
    reached = spread(graph.steps(direction, edge_type), start, depth).filter("distance > 0").select("id", "distance").orderBy("distance", "id")
    return reached.limit(limit) if limit else reached


def shortest_path(graph: Graph, source: str, target: str, edge_type: str | None = None, most: int = DEEPEST) -> DataFrame:
    """One row (found, hops, path): the lexicographically least of the shortest paths, either way along edges.

    Not found: hops -1 and an empty path. Every level keeps the least path to each node it reaches for the first time.
    """
    spark = graph.spark
    steps = cut(graph.both(edge_type).select(F.col("src").alias("id"), "dst"))
    front = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    known = graph.nodes.filter(F.col("id").isin(source, target)).select("id").distinct().count()
    if known < len({source, target}):
        return spark.createDataFrame([(False, -1, [])], "found boolean, hops int, path array<string>")
    if source == target:
        return spark.createDataFrame([(True, 0, [source])], "found boolean, hops int, path array<string>")
    seen = front.select("id")
    for level in range(1, most + 1):
        grown = front.join(steps, "id").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(grown.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        hit = front.filter(F.col("id") == target).select("path").take(1)
        if hit:
            return spark.createDataFrame([(True, level, list(hit[0].path))], "found boolean, hops int, path array<string>")
        if not front.take(1):
            break
        seen = seen.union(front.select("id"))
    return spark.createDataFrame([(False, -1, [])], "found boolean, hops int, path array<string>")


def are_connected(graph: Graph, one: str, two: str, edge_type: str | None = None, most: int = DEEPEST) -> DataFrame:
    """One row (connected, hops): distance either way along edges up to ``most``, else false and -1.

    Two searches meet: the smaller frontier grows, so that about the square root of the nodes is visited.
    """
    spark = graph.spark
    answer = lambda hops: spark.createDataFrame([(hops >= 0, hops)], "connected boolean, hops int")
    known = graph.nodes.filter(F.col("id").isin(one, two)).select("id").distinct().count()
    if known < len({one, two}):
        return answer(-1)
    if one == two:
        return answer(0)
    steps = cut(graph.both(edge_type).select(F.col("src").alias("id"), "dst"))
    sides = [{"front": spark.createDataFrame([(n,)], "id string"), "size": 1, "seen": spark.createDataFrame([(n,)], "id string")} for n in (one, two)]
    for hops in range(1, most + 1):
        here, there = sorted(sides, key=lambda s: s["size"])
        front = cut(here["front"].join(steps, "id").select(F.col("dst").alias("id")).distinct().join(here["seen"], "id", "left_anti"))
        if front.join(there["front"], "id", "left_semi").take(1):
            return answer(hops)
        here["front"], here["size"] = front, front.count()
        if not here["size"]:
            break
        here["seen"] = here["seen"].union(front)
    return answer(-1)


def export_coo(graph: Graph, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(ids, coo): ids(idx, id) numbers the nodes from 0 in id order; coo(src_idx, dst_idx, edge_type, edge_type_id).

    Ranges are numbered within partitions and shifted by the sizes of those before, so no single task sorts all ids.
    """
    from docgraph.graph.model import subgraph

    part = subgraph(graph, node_types, edge_types)
    ids = numbered(part.nodes.select("id"), "id")
    kinds = part.edges.select(F.col("type").alias("edge_type")).distinct()
    kinds = kinds.withColumn("edge_type_id", F.row_number().over(Window.orderBy("edge_type")) - 1)
    ends = part.edges.select("src", "dst", F.col("type").alias("edge_type"))
    coo = ends.join(ids.select(F.col("id").alias("src"), F.col("idx").alias("src_idx")), "src").join(ids.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx")), "dst").join(F.broadcast(kinds) if kinds.count() < 100_000 else kinds, "edge_type")
    return ids, coo.select("src_idx", "dst_idx", "edge_type", "edge_type_id")


def running(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``key`` (unique values).

    Range partitions are summed, the sums of those before shift each; so no single task sees all rows.
    """
    spread_out = cut(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    # One sum for each partition.
    sums = sorted((r[0], r[1]) for r in spread_out.groupBy("__part").agg(F.sum(value)).collect())
    bases, total = [], 0
    for part, amount in sums:
        bases.append((part, total))
        total += amount or 0
    first = df.sparkSession.createDataFrame(bases or [(0, 0)], "__part int, __base long")
    before = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread_out.withColumn(name, before).join(F.broadcast(first), "__part").withColumn(name, (F.col(name) + F.col("__base")).cast("long")).select(*df.columns, name)


def numbered(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of ``key`` (unique values)."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), key, "__one", name).select(name, *df.columns)


def export_csr(graph: Graph, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, columns): rows(idx, start, degree) is the row pointer, columns(position, src_idx, dst_idx, edge_type_id) the sorted edges.

    Each edge type id stays with its edge; a node without edges starts where the next one does.
    """
    ids, coo = export_coo(graph, node_types, edge_types)
    columns = numbered(coo.select(F.struct("src_idx", "dst_idx", "edge_type_id").alias("e")), "e", "position").select("position", "e.src_idx", "e.dst_idx", "e.edge_type_id")
    degrees = coo.groupBy(F.col("src_idx").alias("idx")).agg(F.count("*").alias("degree"))
    held = ids.select("idx").join(degrees, "idx", "left").fillna(0, ["degree"])
    return running(held, "idx", "degree", "start").select("idx", "start", "degree"), columns
