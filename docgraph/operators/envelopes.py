"""What a session returns for each algorithm: JSON-like values made from the whole DataFrames."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, functions as F

from docgraph.graph.model import HEAVY, Graph
from docgraph.operators import algorithms
from docgraph.plans.durable import cut

#: Components that are listed, and members of each; the DataFrames hold all.
LISTED, MEMBERS = 50, 10

# Parameters of each algorithm in the order of their positions.
ORDER = {
    "MutualFriends": ("user1", "user2", "edge_type"),
    "AreConnected": ("user1", "user2", "edge_type"),
    "ShortestPath": ("from", "to", "edge_type"),
    "FriendSuggestion": ("user", "limit", "edge_type"),
    "MostConnected": ("limit", "metric", "node_type"),
    "NetworkStats": ("mode",),
    "GetFriends": ("user", "limit", "edge_type"),
    "Neighborhood": ("node", "depth", "limit"),
    "ConnectedComponents": ("node_type",),
    "AllDistances": ("source", "all", "max_hops", "node_type"),
    "CommunityDetection": ("max_iterations", "min_community_size", "members", "node_type"),
    "PageRank": ("iterations", "damping", "top"),
    "BetweennessCentrality": ("top",),
    "InfluenceMaximization": ("k", "simulations", "probability"),
}


def parameters(name: str, given: dict, limit: int | None = None, top: int | None = None) -> dict:
    """Named parameters, with LIMIT and TOP in their places; unknown ones and empty strings raise or count as absent."""
    out = {k: v for k, v in given.items() if v not in ("", None)}
    if limit is not None:
        out.setdefault("limit", limit)
    if top is not None:
        out.setdefault("top", top)
    if unknown := [k for k in out if k not in ORDER[name]]:
        raise ValueError(f"{name} has no parameter {', '.join(unknown)}")
    return {{"from": "source", "to": "target"}.get(k, k): v for k, v in out.items()}


def plain(value: Any) -> Any:
    return [r.asDict(recursive=True) for r in value.collect()] if isinstance(value, DataFrame) else value


def _ids(df: DataFrame) -> list[str]:
    return [r.id for r in df.select("id").collect()]


def mutual_friends(graph: Graph, user1: str, user2: str, edge_type: str | None = None) -> dict:
    found = _ids(algorithms.mutual_friends(graph, user1, user2, edge_type))
    return {"user1": user1, "user2": user2, "count": len(found), "mutual_friends": found}


def are_connected(graph: Graph, user1: str, user2: str, edge_type: str | None = None) -> dict:
    row = algorithms.are_connected(graph, user1, user2, edge_type).first()
    return {"user1": user1, "user2": user2, "connected": row.connected, "hops": row.hops}


def shortest_path(graph: Graph, source: str, target: str, edge_type: str | None = None) -> dict:
    row = algorithms.shortest_path(graph, source, target, edge_type).first()
    return {"from": source, "to": target, "found": row.found, "hops": row.hops, "path": list(row.path)}


def friend_suggestion(graph: Graph, user: str, limit: int = 10, edge_type: str | None = None) -> dict:
    found = [{"user_id": r.id, "mutual_friends": r.mutual_friends} for r in algorithms.friend_suggestions(graph, user, limit, edge_type).collect()]
    return {"user_id": user, "suggestion_count": len(found), "suggestions": found}


def most_connected(graph: Graph, limit: int = 10, metric: str = "in", node_type: str | None = None) -> dict:
    metric = metric if metric in ("in", "out", "total") else "in"
    found = [r.asDict() for r in algorithms.most_connected(graph, limit, metric, node_type).collect()]
    scanned = graph.nodes.filter(F.col("type") == node_type) if node_type else graph.nodes
    return {"metric": metric, "total_scanned": scanned.count(), "results": found}


def network_stats(graph: Graph, mode: str = "full") -> dict:
    mode = mode if mode in ("basic", "degree", "types", "full") else "full"
    out: dict = {"mode": mode}
    row = algorithms.network_stats(graph).first() if mode != "types" else None
    if mode in ("basic", "full"):
        heavy = graph.degrees().filter(F.col("total") > HEAVY).count()
        out["basic"] = {"active_nodes": row.active_nodes, "active_edges": row.active_edges, "deleted_nodes": 0, "deleted_edges": 0, "heavy_nodes": heavy, "version": graph.version}
        out["density"] = row.density
    if mode in ("degree", "full"):
        # Each side counts one direction of an edge.
        out["degree"] = {"min_degree": row.min_degree, "max_degree": row.max_out, "avg_degree": row.avg_out, "median_degree": row.median_degree, "max_total_degree": row.max_degree, "avg_total_degree": row.avg_degree, "isolated_nodes": row.isolated_nodes}
    if mode in ("types", "full"):
        counts = algorithms.type_counts(graph).collect()
        out |= {f"{kind}_types": {r.type: r["count"] for r in counts if r.kind == kind} for kind in ("node", "edge")}
    return out


def get_friends(graph: Graph, user: str, limit: int = 10_000, edge_type: str | None = None) -> dict:
    total = algorithms.friends(graph, user, 10_000, edge_type).count()
    found = _ids(algorithms.friends(graph, user, limit, edge_type))
    return {"user_id": user, "friend_count": len(found), "friends": found, "limit_applied": len(found) < total}


def neighborhood(graph: Graph, node: str, depth: int = 1, limit: int = 100) -> dict:
    found = [r.asDict() for r in algorithms.neighborhood(graph, node, depth, limit).collect()]
    return {"node": node, "depth": depth, "count": len(found), "nodes": found}


def connected_components(graph: Graph, node_type: str | None = None) -> dict:
    found = cut(algorithms.components(graph, node_type))
    # Members beyond those listed are counted, not gathered.
    sizes = cut(found.groupBy("component").agg(F.count("*").alias("size")))
    total = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.min("size"), F.lit(0)).alias("smallest")).first()
    shown = sizes.orderBy(F.desc("size"), "component").limit(LISTED).collect()
    out = []
    for r in shown:
        members = [x.id for x in found.filter(F.col("component") == r.component).orderBy("id").limit(MEMBERS).select("id").collect()]
        out.append({"component_id": len(out), "size": r["size"], "members": members} | ({"more": r["size"] - len(members)} if r["size"] > len(members) else {}))
    return {"total_components": total.n, "total_nodes": total.nodes, "largest_component_size": total.largest, "smallest_component_size": total.smallest, "avg_component_size": total.nodes / total.n if total.n else 0.0, "components": out}


def _truth(value: Any, word: str) -> bool:
    return value in (True, 1, "true", word)


def all_distances(graph: Graph, source: str | None = None, all: Any = False, max_hops: Any = None, node_type: str | None = None) -> dict:
    everything = _truth(all, "all")
    if max_hops is not None and not (isinstance(max_hops, int) or str(max_hops).lstrip("-").isdigit()):
        max_hops = 0
    hops = None if max_hops is None else int(max_hops) if int(max_hops) > 0 else 6
    rows = algorithms.all_distances(graph, source, everything, hops, node_type)
    total = graph.nodes.count()
    if not everything:
        found = [{"id": r.id, "distance": r.distance} for r in rows.orderBy("distance", "id").collect()]
        return {"mode": "sssp", "source": source, "max_hops": -1 if hops is None else hops, "distances": found, "reached": len(found), "unreachable": total - len(found) - 1, "max_distance": max((f["distance"] for f in found), default=0)}
    per: dict[str, list] = {n: [] for n in _ids(graph.nodes.filter(F.col("type") == node_type) if node_type and graph.nodes.filter(F.col("type") == node_type).take(1) else graph.nodes)}
    for r in rows.orderBy("source", "distance", "id").collect():
        per[r.source].append({"id": r.id, "distance": r.distance})
    sources = [{"source": s, "distances": d} for s, d in sorted(per.items())]
    own = next((d for s, d in per.items() if s == source), None)
    return {"mode": "all_pairs", "max_hops": -1 if hops is None else hops, "node_count": total, "sources": sources} | ({"distances": own} if own is not None else {})


def community_detection(graph: Graph, max_iterations: int = 10, min_community_size: int = 2, members: Any = False, node_type: str | None = None) -> dict:
    found = cut(algorithms.communities(graph, max_iterations, node_type))
    sizes = found.groupBy("community").agg(F.count("*").alias("size"))
    kept = sizes.filter(F.col("size") >= min_community_size)
    total = found.count()
    rows = kept.orderBy(F.desc("size"), "community").collect()
    held: dict[str, list] = {}
    if _truth(members, "members"):
        for r in found.join(kept, "community", "left_semi").orderBy("id").collect():
            held.setdefault(r.community, []).append(r.id)
    out = [{"community_id": f"c_{i}", "size": r["size"]} | ({"members": held[r.community]} if held else {}) for i, r in enumerate(rows)]
    assigned = sum(r["size"] for r in rows)
    return {"algorithm": "label_propagation", "total_communities": len(out), "total_nodes_assigned": assigned, "isolated_nodes": total - assigned, "communities": out}


def page_rank(graph: Graph, iterations: int = 20, damping: float = 0.85, top: int = 0) -> dict:
    rows = algorithms.pagerank(graph, iterations, damping, top).collect()
    return {"iterations": iterations, "damping": damping, "total_nodes": graph.nodes.count(), "showing": len(rows), "nodes": [{"rank": i, "user_id": r.id, "score": r["rank"]} for i, r in enumerate(rows, 1)]}


def betweenness_centrality(graph: Graph, top: int = 0) -> dict:
    rows = algorithms.betweenness(graph, top).orderBy("rank").collect()
    return {"total_nodes": graph.nodes.count(), "showing": len(rows), "nodes": [{"rank": r["rank"], "user_id": r.id, "betweenness": round(r.betweenness, 6)} for r in rows]}


def influence_maximization(graph: Graph, k: int = 5, simulations: int = 20, probability: float = 0.1) -> dict:
    rows = algorithms.influence(graph, k, simulations, float(probability)).orderBy("selection_order").collect()
    total, reach = graph.nodes.count(), rows[-1].reach if rows else 0.0
    seeds = [{"selection_order": r.selection_order, "user_id": r.id, "marginal_gain": r.marginal_gain} for r in rows]
    return {"k_seeds": len(rows), "simulations": simulations, "propagation_prob": float(probability), "estimated_reach": reach, "reach_percentage": round(100 * reach / total, 2) if total else 0.0, "seeds": seeds}


ALGORITHMS = {
    "MutualFriends": ("lock", mutual_friends),
    "AreConnected": ("lock", are_connected),
    "ShortestPath": ("lock", shortest_path),
    "FriendSuggestion": ("lock", friend_suggestion),
    "MostConnected": ("lock", most_connected),
    "NetworkStats": ("lock", network_stats),
    "GetFriends": ("lock", get_friends),
    "Neighborhood": ("lock", neighborhood),
    "ConnectedComponents": ("job", connected_components),
    "AllDistances": ("job", all_distances),
    "CommunityDetection": ("job", community_detection),
    "PageRank": ("job", page_rank),
    "BetweennessCentrality": ("job", betweenness_centrality),
    "InfluenceMaximization": ("job", influence_maximization),
}


def as_json(result: dict) -> str:
    return json.dumps(result)
