"""Graph algorithms over arrays and their forms by joins, on graphs with cut nodes, loops and separate pieces."""

import random
import time

import numpy as np
import pytest

from docgraph.graph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from docgraph.operators import algorithms, arrays
from test_graphs import bfs


def graph_of(spark, names, edges) -> Graph:
    nodes = spark.createDataFrame([(n, "User", False, None) for n in names], NODE_SCHEMA)
    return Graph(nodes, spark.createDataFrame([(a, b, kind, True, None) for a, b, kind in edges], EDGE_SCHEMA))


def test_cascades_by_joins(spark, monkeypatch):
    """Larger graphs than the bound get the same seeds; candidates fill two words, and some edges are parallel."""
    rng = random.Random(3)
    names = [f"n{i}" for i in range(75)]
    graph = graph_of(spark, [*names, "alone"], [(*rng.sample(names, 2), rng.choice("ab")) for _ in range(180)])
    run = lambda: [tuple(r) for r in algorithms.influence(graph, 3, 4, 0.3).orderBy("selection_order").collect()]
    want = run()
    assert want[0][3] > 5
    monkeypatch.setattr(algorithms, "BROADCAST_STEPS", 10)
    assert run() == want


def test_every_node_is_a_candidate(spark, monkeypatch):
    """The best seeds are nodes of the least degree, which over a hundred others precede; in both forms."""
    pairs = [(f"p{i:02}", f"q{i:02}", kind) for i in range(55) for kind in "abc"]
    path = [f"w{i}" for i in range(9)]
    graph = graph_of(spark, sorted({n for a, b, _ in pairs for n in (a, b)} | {*path}), pairs + [(a, b, "a") for a, b in zip(path, path[1:])])
    run = lambda: [tuple(r) for r in algorithms.influence(graph, 3, 2, 1.0).orderBy("selection_order").collect()]
    want = [(1, "w1", 9.0, 9.0), (2, "p00", 2.0, 11.0), (3, "p01", 2.0, 13.0)]
    assert run() == want
    monkeypatch.setattr(algorithms, "BROADCAST_STEPS", 10)
    monkeypatch.setattr(algorithms, "CANDIDATES", 50)
    assert run() == want


def test_more_seeds_than_gains(spark, monkeypatch):
    """When nothing is left to reach, seeds that add nothing follow by degree; not more than there are nodes."""
    graph = graph_of(spark, ["a", "b", "c"], [("c", "b", "x"), ("b", "a", "x")])
    run = lambda: [tuple(r) for r in algorithms.influence(graph, 5, 2, 1.0).orderBy("selection_order").collect()]
    want = [(1, "b", 3.0, 3.0), (2, "a", 0.0, 3.0), (3, "c", 0.0, 3.0)]
    assert run() == want
    monkeypatch.setattr(algorithms, "BROADCAST_STEPS", 1)
    assert run() == want


@pytest.mark.parametrize("held", [100, arrays.SET_BITS])
def test_reaches(monkeypatch, held):
    """Strongly connected parts and what they reach, against closures."""
    monkeypatch.setattr(arrays, "SET_BITS", held)
    rng = np.random.default_rng(7)
    for n, many in ((1, 0), (30, 20), (60, 60), (60, 75), (80, 300), (300, 330)):
        src, dst = rng.integers(0, n, (2, many))
        part = arrays.strong(arrays.Arrays(n, src, dst))
        far = np.eye(n, dtype=bool)
        far[src, dst] = True
        for k in range(n):
            far |= far[:, k : k + 1] & far[k]
        assert ((far & far.T) == (part[:, None] == part)).all()
        a, b = part[src], part[dst]
        assert (a >= b).all()
        assert (arrays.reaches(np.bincount(part), a[a != b], b[a != b])[part] == far.sum(axis=1)).all()


@pytest.mark.parametrize("dense", [0, arrays.DENSE_PAIRS])
def test_parts(monkeypatch, dense):
    """Credits inside parts and pairs that cut nodes separate add up to those of the whole graph, with far fewer visits."""
    monkeypatch.setattr(arrays, "DENSE_PAIRS", dense)
    rng = random.Random(5)
    for size, blobs, many in ((1, 1, 0), (30, 1, 25), (30, 1, 40), (12, 8, 20), (10, 1, 60)):
        n, pairs = size * blobs, set()
        for k in range(blobs):
            pairs |= {(k * size + rng.randrange(size), k * size + rng.randrange(size)) for _ in range(many)} | ({(k * size, k * size - 1)} if k else set())
        steps = np.array(sorted({p for a, b in pairs if a != b for p in ((a, b), (b, a))}), np.int64).reshape(-1, 2)
        graph = arrays.Arrays(n, steps[:, 0], steps[:, 1])
        parts, score = arrays.parts(graph)
        for part in parts:
            score[part.nodes] += arrays.credits(part, np.arange(len(part.nodes)))
        assert score == pytest.approx(sum(arrays.brandes(graph, np.ones(n), s) for s in range(n)))
        if blobs > 1:
            assert sum(len(p.nodes) * len(p.steps.dst) for p in parts) * blobs <= n * len(graph.dst)


def undirected(n, src, dst) -> arrays.Arrays:
    kept = src != dst
    steps = np.unique(np.concatenate([[src[kept], dst[kept]], [dst[kept], src[kept]]], axis=1), axis=1)
    return arrays.Arrays(n, steps[0], steps[1])


def test_pairs_are_counted_once(monkeypatch):
    """Pairs with later nodes, doubled, are all pairs: on paths, rings, dense and separate pieces, with any weights."""
    rng = np.random.default_rng(4)
    ring = np.arange(50)
    graphs = [undirected(n, *rng.integers(0, n, (2, many))) for n, many in ((2, 1), (10, 12), (40, 400), (200, 230), (300, 9000))]
    for held in (3, arrays.ROWS):
        monkeypatch.setattr(arrays, "ROWS", held)
        for graph in (*graphs, undirected(50, ring, (ring + 1) % 50), undirected(50, ring[1:], ring[:-1])):
            n = len(graph.start) - 1
            weight, rows = rng.integers(1, 5, n).astype(float), arrays.Rows(graph)
            want = sum(weight[s] * arrays.brandes(graph, weight, s) for s in range(n))
            assert sum(2 * weight[s] * arrays.later(rows, weight, s) for s in range(n)) == pytest.approx(want)


def test_one_large_part():
    """In a part too large for matrices a search ends where all pairs are found; the last level is most of the steps."""
    n = 12_000
    graph = undirected(n, *np.random.default_rng(2).integers(0, n, (2, 40 * n)))
    part, sources = arrays.Part(np.arange(n), graph, np.ones(n)), np.arange(0, n, n // 24)
    arrays.credits(part, sources[:1])
    spent = []
    for of in (lambda: [arrays.brandes(graph, part.weight, int(s)) for s in sources], lambda: arrays.credits(part, sources)):
        began = time.process_time()
        of()
        spent.append(time.process_time() - began)
    assert not part.dense()
    assert spent[1] < spent[0] / 2


def test_no_level_by_level(spark):
    """Distances of all pairs and betweenness of a long path take no Spark job for each level."""
    names = [f"{i:02}" for i in range(60)]
    graph = graph_of(spark, names, [(a, b, "next") for a, b in zip(names, names[1:])] + [("05", "05", "next")])
    context = spark.sparkContext
    context.setJobGroup("levels", "levels")
    far = {(r.source, r.id): r.distance for r in algorithms.all_distances(graph, everything=True).collect()}
    between = {r.id: r.betweenness for r in algorithms.betweenness(graph).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("levels"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 50
    assert far == {(a, b): j - i for i, a in enumerate(names) for j, b in enumerate(names) if j > i}
    assert between == pytest.approx({n: 2 * i * (59 - i) / (59 * 58) for i, n in enumerate(names)})


def test_all_distances_forms(spark, monkeypatch):
    """Bounded hops and a type that filters, in both forms."""
    rng = random.Random(9)
    names = [f"n{i}" for i in range(20)]
    edges = [(*rng.sample(names, 2), "a") for _ in range(35)]
    graph = graph_of(spark, names, edges)
    out = {}
    for a, b, _ in edges:
        out.setdefault(a, set()).add(b)
    want = {(s, t, d) for s in names for t, d in bfs(out, s).items() if 0 < d <= 2}
    run = lambda: {tuple(r) for r in algorithms.all_distances(graph, everything=True, max_hops=2, node_type="User").collect()}
    assert run() == want
    monkeypatch.setattr(algorithms, "BROADCAST_STEPS", 10)
    assert run() == want
