"""Algorithms on a known graph and on random ones."""

import random
from collections import deque

import pytest

from docgraph.graph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from docgraph.operators import algorithms, envelopes, graphs


def made(spark, nodes, edges, directed=True):
    """A graph from ids and (src, dst) pairs."""
    return Graph(spark.createDataFrame([(n, "User", False, None) for n in nodes], NODE_SCHEMA), spark.createDataFrame([(a, b, "FOLLOWS", directed, None) for a, b in edges], EDGE_SCHEMA))


@pytest.fixture(scope="module")
def kite(spark):
    """p, q, r, s in a ring, t hung on s, u on t, and a pair v, w apart; worked out by hand below."""
    return made(spark, "pqrstuvw", ["pq", "qr", "rs", "ps", "ts", "tu", "vw"])


def run(graph, name, **params):
    return envelopes.ALGORITHMS[name][1](graph, **envelopes.parameters(name, params))


def test_lock_algorithms(kite):
    friends = run(kite, "GetFriends", user="s", edge_type="FOLLOWS", limit=3)
    assert (friends["friends"], friends["limit_applied"]) == (["p", "r", "t"], False)
    assert run(kite, "GetFriends", user="s", limit=2)["limit_applied"]
    assert [run(kite, "AreConnected", user1="q", user2=x)["hops"] for x in "uqw"] == [4, 0, -1]
    # Two shortest ways from q to u: over p and over r.
    assert run(kite, "ShortestPath", **{"from": "q", "to": "u"})["path"] == ["q", "p", "s", "t", "u"]
    assert run(kite, "ShortestPath", **{"from": "v", "to": "u"})["path"] == []
    assert run(kite, "MutualFriends", user1="p", user2="t")["mutual_friends"] == ["s"]
    assert run(kite, "FriendSuggestion", user="q")["suggestions"] == [{"user_id": "s", "mutual_friends": 2}]
    top = run(kite, "MostConnected", metric="total", node_type="User", limit=3)
    assert [(r["id"], r["in"], r["out"], r["total"]) for r in top["results"]] == [("s", 3, 0, 3), ("p", 0, 2, 2), ("q", 1, 1, 2)]
    stats = run(kite, "NetworkStats", mode="full")
    assert (stats["density"], stats["node_types"], stats["edge_types"], stats["degree"]["isolated_nodes"]) == (0.125, {"User": 8}, {"FOLLOWS": 7}, 0)
    assert run(kite, "Neighborhood", node="u", depth=2)["nodes"] == [{"id": "t", "distance": 1}, {"id": "s", "distance": 2}]
    for name, params in (("MostConnected", {"node_type": "Ship"}), ("MutualFriends", {"user1": "p", "user2": "x"}), ("MutualFriends", {"user1": "p", "user2": "q", "edge_type": "OWES"})):
        with pytest.raises(ValueError):
            run(kite, name, **params)


def test_job_algorithms(kite):
    assert [c["members"] for c in run(kite, "ConnectedComponents", node_type="User")["components"]] == [list("pqrstu"), ["v", "w"]]
    one = run(kite, "AllDistances", source="p", max_hops=2, node_type="User")
    assert (one["distances"], one["reached"], one["unreachable"]) == ([{"id": "q", "distance": 1}, {"id": "s", "distance": 1}, {"id": "r", "distance": 2}], 3, 4)
    every = {s["source"]: s["distances"] for s in run(kite, "AllDistances", source="p", all=True, max_hops=10)["sources"]}
    assert every["t"] == [{"id": "s", "distance": 1}, {"id": "u", "distance": 1}] and every["u"] == [] and len(every) == 8
    # s is between {p, q, r} and {t, u} on all six ways, and shares p-r with q: 6.5 pairs, both directions, of 7 times 6.
    between = {n["user_id"]: n["betweenness"] for n in run(kite, "BetweennessCentrality", top=8)["nodes"]}
    assert between == {k: pytest.approx(2 * x / 42, abs=1e-6) for k, x in {"s": 6.5, "t": 4, "p": 1.5, "r": 1.5, "q": 0.5, "u": 0, "v": 0, "w": 0}.items()}
    groups = run(kite, "CommunityDetection", max_iterations=20, members=True)
    assert groups["isolated_nodes"] == 0 and sorted(m for c in groups["communities"] for m in c["members"]) == list("pqrstuvw")
    best = run(kite, "InfluenceMaximization", k=2, simulations=3, probability=1.0)
    assert (best["estimated_reach"], best["reach_percentage"]) == (8.0, 100.0)
    assert sum(n["score"] for n in run(kite, "PageRank")["nodes"]) == pytest.approx(1)


def bfs(neighbours, start):
    far, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in neighbours.get(x, ()):
            if y not in far:
                far[y] = far[x] + 1
                queue.append(y)
    return far


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(18)]
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(24)})
    graph = made(spark, nodes, edges)
    out, both = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        if a != b:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
    want = {(s, t): d for s in nodes for t, d in bfs(out, s).items() if d}
    assert {(r.source, r.id): r.distance for r in algorithms.all_distances(graph, everything=True).collect()} == want
    near = {n: min(bfs(both, n)) for n in nodes}
    assert {r.id: r.component for r in algorithms.components(graph).collect()} == near
    # Shortest paths: all of them, the least first.
    for target in nodes[1:6]:
        far = bfs(both, nodes[0])
        paths = [[nodes[0]]]
        while paths and paths[0][-1] != target and len(paths[0]) <= len(nodes):
            paths = sorted(p + [y] for p in paths for y in both.get(p[-1], ()) if far[y] == len(p))
            hit = [p for p in paths if p[-1] == target]
            paths = hit or paths
        row = algorithms.shortest_path(graph, nodes[0], target).first()
        assert (row.found, row.hops) == (target in far, far.get(target, -1))
        assert list(row.path) == (paths[0] if target in far else [])
        assert algorithms.are_connected(graph, nodes[0], target).first().hops == far.get(target, -1)
    # Betweenness by counting paths, in both forms.
    counts = {}
    for s in nodes:
        far, ways = bfs(both, s), {s: 1}
        for t in sorted(far, key=far.get)[1:]:
            ways[t] = sum(ways[y] for y in both[t] if far.get(y) == far[t] - 1)
        counts[s] = far, ways
    score = {v: sum(counts[s][1][v] * counts[v][1][t] / counts[s][1][t] for s in nodes for t in nodes if len({s, t, v}) == 3 and t in counts[s][0] and v in counts[s][0] and counts[s][0][v] + counts[v][0].get(t, 99) == counts[s][0][t]) for v in nodes}
    norm = 1 / ((len(nodes) - 1) * (len(nodes) - 2))
    assert {r.id: r.betweenness for r in algorithms.betweenness(graph).collect()} == pytest.approx({v: x * norm for v, x in score.items()})
    assert {r.id: r.score for r in algorithms._betweenness_joins(graph, 7).collect()} == pytest.approx({v: x for v, x in score.items() if x})


def test_exports(spark, kite):
    ids, coo = graphs.export_coo(kite)
    assert {r.idx: r.id for r in ids.collect()} == dict(enumerate("pqrstuvw"))
    assert sorted((r.src_idx, r.dst_idx) for r in coo.collect()) == [(0, 1), (0, 3), (1, 2), (2, 3), (4, 3), (4, 5), (6, 7)]
    rows, columns = graphs.export_csr(kite)
    assert [(r.idx, r.start, r.degree) for r in rows.orderBy("idx").collect()] == [(0, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 0), (4, 4, 2), (5, 6, 0), (6, 6, 1), (7, 7, 0)]
    assert [r.dst_idx for r in columns.orderBy("position").collect()] == [1, 3, 2, 3, 3, 5, 7]


def test_small_graphs(spark):
    for nodes, edges in (("", []), ("a", []), ("ab", ["ab"])):
        graph = made(spark, nodes, edges)
        assert algorithms.components(graph).count() == len(nodes)
        assert algorithms.network_stats(graph).first().active_nodes == len(nodes)
        assert algorithms.betweenness(graph).count() == len(nodes)
        assert algorithms.communities(graph).count() == len(nodes)
        assert algorithms.pagerank(graph, 2).count() == len(nodes)


def test_undirected(spark):
    graph = made(spark, "abc", ["ab", "bc"], directed=False)
    assert {r.id: r.distance for r in algorithms.all_distances(graph, "c").collect()} == {"b": 1, "a": 2}
    assert graphs.edge_exists(graph, "b", "a").first()[0]
