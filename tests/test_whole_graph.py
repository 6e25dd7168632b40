"""Queries on the whole interaction graph against plain versions on a small table of events."""

import random
from collections import Counter

import pytest

from docgraph import queries
from test_graphs import bfs

USERS, EVENTS = 40, 90


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, users, distinct pairs of users of successive events) of events of several types: few are signups in a row."""
    rng = random.Random(8)
    events = [(i, rng.choice([*range(USERS)]), rng.choice(["signup", "click", "view"])) for i in range(EVENTS)] + [(EVENTS, 0, "view"), (EVENTS + 1, 2, "click"), (EVENTS + 2, 1, "view")]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    pairs = {(str(a[1]), str(b[1])) for a, b in zip(events, events[1:]) if a[1] != b[1]}
    return folder, sorted({str(e[1]) for e in events}), sorted(pairs)


@pytest.fixture(scope="module")
def both(small):
    out = {}
    for a, b in small[2]:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_reach(spark, small, both):
    folder, users, _ = small
    far = bfs(both, "0")
    run = lambda name: queries.QUERIES[name](spark, folder).collect()
    assert {r.id: r.distance for r in run("graph_neighborhood")} == {n: d for n, d in far.items() if 0 < d <= 12}
    assert [tuple(r) for r in run("algo_are_connected")] == [(True, far["1"])]
    assert {r.id: r.component for r in run("algo_components")} == {n: min(bfs(both, n)) for n in users}
    shared = Counter(y for x in both["0"] for y in both[x] if y != "0" and y not in both["0"])
    assert [(r.id, r.mutual_friends) for r in run("algo_friend_suggestion")] == sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_ranks(spark, small, both):
    folder, users, pairs = small
    run = lambda name: queries.QUERIES[name](spark, folder).collect()
    stats = run("algo_network_stats")[0]
    assert (stats.active_nodes, stats.active_edges) == (len(users), len(pairs))
    outs, rank = Counter(a for a, _ in pairs), {n: 1 / len(users) for n in users}
    for _ in range(20):
        lost = sum(r for n, r in rank.items() if not outs[n])
        fresh = {n: (0.15 + 0.85 * lost) / len(users) for n in users}
        for a, b in pairs:
            fresh[b] += 0.85 * rank[a] / outs[a]
        rank = fresh
    assert {r.id: r.rank for r in run("algo_pagerank")} == pytest.approx(rank, abs=1e-6)
    label = {n: n for n in users}
    for _ in range(10):
        votes = {n: Counter([label[n]]) for n in users}
        for a, b in pairs:
            votes[a][label[b]] += 1
            votes[b][label[a]] += 1
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    assert {r.id: r.community for r in run("algo_communities")} == label
    far = {n: bfs(both, n) for n in users}
    ways = {}
    for s in users:
        ways[s] = {s: 1}
        for t in sorted(far[s], key=far[s].get)[1:]:
            ways[s][t] = sum(ways[s][y] for y in both[t] if far[s].get(y) == far[s][t] - 1)
    passed = lambda s, v, t: ways[s][v] * ways[v][t] / ways[s][t] if far[s].get(v, 99) + far[v].get(t, 99) == far[s].get(t) else 0
    norm = (len(users) - 1) * (len(users) - 2)
    want = {v: sum(passed(s, v, t) for s in users for t in users if len({s, t, v}) == 3) / norm for v in users}
    assert {r.id: r.betweenness for r in run("algo_betweenness")} == pytest.approx(want, abs=1e-6)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """A folder of events that lead from user 0 over nine others to user 1."""
    folder = str(tmp_path_factory.mktemp("chain"))
    spark.createDataFrame([(i, u, "view") for i, u in enumerate([0, 5, 6, 7, 8, 9, 10, 11, 12, 1])], "event_id long, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    return folder


def test_far(spark, small, chain):
    """No bound of three, four or six steps."""
    row = queries.QUERIES["algo_shortest_path"](spark, chain).first()
    assert tuple(row) == (True, 9, "0>5>6>7>8>9>10>11>12>1")
    assert {r.id: r.distance for r in queries.QUERIES["algo_distances"](spark, chain).collect()}["1"] == 9
    folder, users, pairs = small
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = {(s, t): d for s in users for t, d in bfs(out, s).items() if d}
    assert max(want.values()) > 4
    assert {(r.source, r.id): r.distance for r in queries.QUERIES["algo_distances_all"](spark, folder).collect()} == want


def test_cascades(spark, small, both):
    """Five greedy seeds of twenty simulations, against simulations step by step with the same coins."""
    folder, users, pairs = small
    steps = sorted([*pairs, *((b, a) for a, b in pairs)])
    mask, place = (1 << 64) - 1, {}
    for i, (a, _) in enumerate(steps):
        place.setdefault(a, []).append(i)

    def coin(step, seed):
        mixed = ((step + 1) * 0x9E3779B97F4A7C15 & mask) ^ (seed * 0x5851F42D % (1 << 32))
        mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & mask
        return ((mixed ^ mixed >> 32) >> 11) / (1 << 53)

    def reach(seeds):
        total = 0
        for s in range(20):
            seen, front = set(seeds), list(seeds)
            while front:
                for i in place.get(front.pop(), ()):
                    if coin(i, 42 + s) < 0.1 and steps[i][1] not in seen:
                        seen.add(steps[i][1])
                        front.append(steps[i][1])
            total += len(seen)
        return total / 20

    degree = Counter(x for pair in pairs for x in pair)
    order = sorted(users, key=lambda n: (-degree[n], n))
    chosen, want = [], []
    for turn in range(1, 6):
        best = max((n for n in order if n not in chosen), key=lambda n: (reach([*chosen, n]), -order.index(n)))
        chosen.append(best)
        want.append((turn, best, reach(chosen)))
    rows = queries.QUERIES["algo_influence"](spark, folder).collect()
    assert [(r.selection_order, r.id) for r in rows] == [w[:2] for w in want]
    assert [r.reach for r in rows] == pytest.approx([w[2] for w in want])
