"""Graphs as arrays, for workers: adjacency, biconnected parts, path counts, and searches from many nodes at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Steps that one piece of a search looks at together.
PIECE = 1 << 20
#: Parts of so many nodes at most, and with one step for so many pairs at least, are counted as matrices.
DENSE_NODES, DENSE_PAIRS = 4096, 64
#: Rows of steps that path counts read together.
ROWS = 2048
#: Bits of sets of nodes that are held together while it is counted what nodes reach.
SET_BITS = 1 << 30


class Arrays:
    """``dst[start[i]:start[i + 1]]`` are the ends of the steps of node ``i``, in order."""

    def __init__(self, nodes: int, src: np.ndarray, dst: np.ndarray):
        both = src.astype(np.int64)
        both <<= 32
        both |= dst
        both.sort()
        self.dst = both.astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(both >> 32, minlength=nodes))]).astype(np.int64)

    def src(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1, dtype=np.int32), np.diff(self.start))

    def of(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, nodes): the steps of some nodes, and whose they are."""
        sizes = self.start[front + 1] - self.start[front]
        return np.repeat(self.start[front] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()), np.repeat(front, sizes)


def either_way(nodes: int, src: np.ndarray, dst: np.ndarray) -> Arrays:
    """Distinct steps between the ends of pairs, both ways."""
    once = np.minimum(src, dst).astype(np.int64)
    once <<= 32
    once |= np.maximum(src, dst)
    once.sort()
    once = once[np.flatnonzero(np.diff(once, prepend=-1))]
    one, two = (once >> 32).astype(np.int32), once.astype(np.int32)
    del once
    return Arrays(nodes, np.concatenate([one, two]), np.concatenate([two, one]))


class Rows:
    """Steps in rows of one width, those of node ``i`` are rows ``first[i]`` to ``first[i + 1]``; a free place holds the number of nodes."""

    def __init__(self, graph: Arrays):
        n, sizes = len(graph.start) - 1, np.diff(graph.start)
        self.width = max(1, min(32, len(graph.dst) // (4 * max(n, 1))))
        self.first = np.concatenate([[0], np.cumsum(-(-sizes // self.width))])
        self.ends = np.full((self.first[-1], self.width), n, np.int64)
        self.ends.ravel()[np.repeat(self.first[:-1] * self.width - graph.start[:-1], sizes) + np.arange(len(graph.dst))] = graph.dst
        self.last = np.where(self.ends < n, self.ends, -1).max(axis=1, initial=-1)


def collected(nodes: DataFrame, steps: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(ids in order, src, dst): ``steps(src, dst)`` between places of ``nodes(id)``; eight bytes a step reach the driver."""
    ids = sorted(nodes.select("id").toArrow().column("id").to_pylist())
    places = nodes.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.string()), "place": np.arange(len(ids), dtype=np.int32)}))
    ends = steps.join(places.select(F.col("id").alias("src"), F.col("place").alias("a")), "src").join(places.select(F.col("id").alias("dst"), F.col("place").alias("b")), "dst").select("a", "b").toArrow()
    return ids, ends.column("a").to_numpy(), ends.column("b").to_numpy()


def least_connected(nodes: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each node the least that edges connect with it."""
    least, before = np.arange(nodes), None
    while before is None or (least != before).any():
        before = least.copy()
        low = np.minimum(least[one], least[two])
        for side in (one, two):
            np.minimum.at(least, least[side], low)
            np.minimum.at(least, side, low)
        least = least[least]
    return least


def forest(graph: Arrays, roots: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """The parent of each node in breadth-first trees from one root of each component (-1: none), along ``live`` steps."""
    parent, seen = np.full(len(graph.start) - 1, -1, np.int32), np.zeros(len(graph.start) - 1, bool)
    seen[roots], front = True, roots
    while len(front):
        steps, came = graph.of(front)
        to = graph.dst[steps]
        fresh = ~seen[to] if live is None else ~seen[to] & live[steps]
        front, first = np.unique(to[fresh], return_index=True)
        parent[front], seen[front] = came[fresh][first], True
    return parent


@dataclass
class Part:
    """A biconnected part: its nodes, steps between their places in it, and how many nodes hang on each, itself included."""

    nodes: np.ndarray
    steps: Arrays
    weight: np.ndarray

    @cached_property
    def rows(self) -> Rows:
        return Rows(self.steps)

    def dense(self) -> bool:
        return len(self.nodes) <= DENSE_NODES and len(self.nodes) ** 2 <= DENSE_PAIRS * len(self.steps.dst)


def parts(graph: Arrays) -> tuple[list[Part], np.ndarray]:
    """Biconnected parts of over two nodes of a symmetric graph, and how many ordered pairs each node separates.

    Parts have the same nodes in a breadth-first forest with a forest of what it leaves (Cheriyan and Thurimella; Cong
    and Bader), so the depth-first search sees two edges a node.
    """
    n, src = len(graph.start) - 1, graph.src()
    once = src < graph.dst
    label = least_connected(n, src[once], graph.dst[once])
    size = np.bincount(label, minlength=n)[label] if n else label
    first = forest(graph, np.flatnonzero(label == np.arange(n)))
    live = (first[src] != graph.dst) & (first[graph.dst] != src)
    rest = least_connected(n, src[live & once], graph.dst[live & once])
    second = forest(graph, np.flatnonzero(rest == np.arange(n)), live)
    child = np.concatenate([np.flatnonzero(first >= 0), np.flatnonzero(second >= 0)])
    above = np.concatenate([first[first >= 0], second[second >= 0]])
    sparse = Arrays(n, np.concatenate([child, above]), np.concatenate([above, child]))
    members, tops, ends = _searched(sparse, np.flatnonzero((label == np.arange(n)) & (size > 1)))
    own = np.full(n, -1, np.int32)
    own[members] = np.repeat(np.arange(len(tops)), np.diff(ends))
    hang, squares, below = np.ones(n), np.zeros(n), np.zeros(len(tops))
    for k, top in enumerate(tops.tolist()):  # a part comes after those that hang on it
        below[k] = hang[members[ends[k] : ends[k + 1]]].sum()
        hang[top] += below[k]
        squares[top] += below[k] ** 2
    through = (size - 1.0) ** 2 - squares - (size - hang) ** 2
    if not len(tops):
        return [], through
    # A step lies in the part of one end, where the other is too or is its top.
    mine = (own[src] >= 0) & ((own[src] == own[graph.dst]) | (tops[own[src]] == graph.dst))
    part = np.where(mine, own[src], own[graph.dst])
    big = np.diff(ends) > 1
    kept = np.flatnonzero(big[part])
    kept = kept[np.argsort(part[kept], kind="stable")]
    borders = np.searchsorted(part[kept], np.arange(len(tops) + 1))
    at, found = np.empty(n, np.int32), []
    for k in np.flatnonzero(big).tolist():
        nodes = np.append(members[ends[k] : ends[k + 1]], tops[k])
        at[nodes] = np.arange(len(nodes))
        steps = kept[borders[k] : borders[k + 1]]
        weight = np.append(hang[nodes[:-1]], size[tops[k]] - below[k])
        found.append(Part(nodes.astype(np.int32), Arrays(len(nodes), at[src[steps]], at[graph.dst[steps]]), weight))
    return found, through


def _searched(graph: Arrays, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, tops, ends): the nodes of each biconnected part but its top, one part after the other, innermost first."""
    n = len(graph.start) - 1
    start, dst = memoryview(graph.start), memoryview(graph.dst)
    order, low, at, parent = (memoryview(x) for x in (np.zeros(n, np.int32), np.zeros(n, np.int32), graph.start[:-1].copy(), np.full(n, -1, np.int32)))
    members, tops, ends, turn = [], [], [0], 0
    for root in roots.tolist():
        turn += 1
        order[root] = low[root] = turn
        path, held = [root], []
        while path:
            node = path[-1]
            if at[node] < start[node + 1]:
                to = dst[at[node]]
                at[node] += 1
                if not order[to]:
                    turn += 1
                    order[to] = low[to] = turn
                    parent[to] = node
                    path.append(to)
                    held.append(to)
                elif to != parent[node] and order[to] < low[node]:
                    low[node] = order[to]
                continue
            path.pop()
            if not path:
                break
            above = path[-1]
            low[above] = min(low[above], low[node])
            if low[node] >= order[above]:
                place = len(held) - 1
                while held[place] != node:
                    place -= 1
                members.extend(held[place:])
                del held[place:]
                tops.append(above)
                ends.append(len(members))
    return np.array(members, np.int64), np.array(tops, np.int64), np.array(ends, np.int64)


def credits(part: Part, sources: np.ndarray) -> np.ndarray:
    """What each node of a part gets from paths of ``sources`` to all nodes, each pair as often as nodes hang on its ends."""
    if part.dense():
        return _credits_dense(part, sources)
    return sum((2 * part.weight[s] * later(part.rows, part.weight, int(s)) for s in sources), np.zeros(len(part.nodes)))


def _credits_dense(part: Part, sources: np.ndarray) -> np.ndarray:
    n, rows = len(part.nodes), np.arange(len(sources))
    matrix = np.zeros((n, n))
    matrix[part.steps.src(), part.steps.dst] = 1
    level, paths, front = np.full((len(sources), n), -1, np.int16), np.zeros((len(sources), n)), None
    level[rows, sources], paths[rows, sources] = 0, 1
    depth = 0
    while (level < 0).any():
        front = matrix[sources] if front is None else front @ matrix
        front[level >= 0] = 0
        fresh = front > 0
        if not fresh.any():
            break
        depth += 1
        level[fresh] = depth
        paths += front
    depends = np.zeros((len(sources), n))
    for k in range(depth, 1, -1):
        give = np.divide(part.weight + depends, paths, out=np.zeros_like(paths), where=level == k)
        depends += np.where(level == k - 1, paths * (give @ matrix), 0)
    return part.weight[sources] @ depends


def brandes(graph: Arrays, weight: np.ndarray, source: int) -> np.ndarray:
    """Dependencies of all nodes on one source, level by level: the plain form, which tests compare with."""
    n = len(graph.start) - 1
    level, paths = np.full(n, -1), np.zeros(n)
    level[source], paths[source] = 0, 1
    front, steps = np.array([source]), []
    while len(front):
        places, came = graph.of(front)
        to = graph.dst[places]
        level[to[level[to] < 0]] = len(steps) + 1
        forward = level[to] == len(steps) + 1
        came, to = came[forward], to[forward]
        np.add.at(paths, to, paths[came])
        steps.append((came, to))
        front = np.unique(to)
    depends = np.zeros(n)
    for came, to in reversed(steps):
        np.add.at(depends, came, paths[came] / paths[to] * (weight[to] + depends[to]))
    depends[source] = 0
    return depends


def strong(graph: Arrays) -> np.ndarray:
    """For each node the number of its strongly connected part; steps between parts lead to smaller numbers."""
    n = len(graph.start) - 1
    start, dst = memoryview(graph.start), memoryview(graph.dst)
    part = np.full(n, -1, np.int32)
    order, low, at, own = (memoryview(x) for x in (np.zeros(n, np.int32), np.zeros(n, np.int32), graph.start[:-1].copy(), part))
    held, turn, found = [], 0, 0
    for root in range(n):
        path = [] if order[root] else [root]
        while path:
            node = path[-1]
            if not order[node]:
                turn += 1
                order[node] = low[node] = turn
                held.append(node)
            place, end, least = at[node], start[node + 1], low[node]
            while place < end:
                to = dst[place]
                if not order[to]:
                    break
                if own[to] < 0 and low[to] < least:
                    least = low[to]
                place += 1
            at[node], low[node] = place, least
            if place < end:
                path.append(to)
                continue
            path.pop()
            if least == order[node]:
                while own[node] < 0:
                    own[held.pop()] = found
                found += 1
    return part


def spread_from(graph: Arrays, roots: np.ndarray) -> np.ndarray:
    """Which nodes some roots reach, themselves included."""
    seen = np.zeros(len(graph.start) - 1, bool)
    seen[roots], front = True, np.unique(roots)
    while len(front):
        to = graph.dst[graph.of(front)[0]]
        front = np.unique(to[~seen[to]])
        seen[front] = True
    return seen


def reaches(weight: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The weight of what each node of an acyclic graph reaches, itself included; steps lead to smaller numbers.

    What reaches the heaviest node reaches all behind it, so that only the rest is counted as sets.
    """
    if not len(src):
        return weight.copy()
    heavy = np.array([np.argmax(weight)])
    behind, before = spread_from(Arrays(len(weight), src, dst), heavy), spread_from(Arrays(len(weight), dst, src), heavy)
    out = np.where(before, weight[behind].sum(), 0)
    for kept, whose in ((~behind, before & ~behind), (~before, ~before)):
        inside = kept[src] & kept[dst]
        out[whose] += _reaches_sets(weight, src[inside], dst[inside])[whose]
    return out


def _reaches_sets(weight: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The same by sets of bits, as many for a node as it weighs; each weakly connected piece has bits of its own."""
    n, out = len(weight), weight.copy()
    piece = least_connected(n, src, dst)
    order, size, upto = np.argsort(piece, kind="stable"), np.zeros(n, np.int64), np.empty(n, np.int64)
    np.add.at(size, piece, weight)
    upto[order] = np.cumsum(weight[order])
    upto -= (np.cumsum(size) - size)[piece]
    order = np.argsort(src, kind="stable")
    src, dst, at, low = src[order], dst[order], np.empty(n, np.int64), 0
    while len(src):
        nodes = np.unique(np.concatenate([src, dst]))
        at[nodes], width = np.arange(len(nodes)), max(64, SET_BITS // len(nodes))
        first, last = (np.clip(x - low, 0, width).tolist() for x in (upto[nodes] - weight[nodes], upto[nodes]))
        sets = [(1 << b) - (1 << a) for a, b in zip(first, last, strict=True)]
        for a, b in zip(at[src].tolist(), at[dst].tolist(), strict=True):  # all steps of b came before
            sets[a] |= sets[b]
        if not low:
            out[nodes] = 0
        out[nodes] += [s.bit_count() for s in sets]
        low += width
        more = size[piece[src]] > low
        src, dst = src[more], dst[more]
    return out


def later(rows: Rows, weight: np.ndarray, source: int) -> np.ndarray:
    """Dependencies of all nodes on the pairs of one source and the nodes after it: both ways round, half of those of all.

    Each level looks at rows with later nodes first; where they end the search, the others need no look. Rows are read
    in pieces of ``ROWS``, into memory that stays.
    """
    n, width = len(rows.first) - 1, rows.width
    ends, held, ones = np.empty((ROWS, width), np.int64), np.empty((ROWS, width)), np.ones(width)
    seen, paths, give, turn = np.zeros(n + 1, bool), np.zeros(n + 1), np.zeros(n + 1), np.empty(n + 1, np.int64)
    seen[[source, n]], paths[source] = True, 1
    front, missing, levels = np.array([source]), n - 1 - source, []
    while missing and len(front):
        sizes = rows.first[front + 1] - rows.first[front]
        here = np.repeat(rows.first[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        whose = np.repeat(np.arange(len(front)), sizes)
        wanted, looked, after = rows.last[here] > source, [], front[:0]
        for some in (wanted, ~wanted):
            own, came = here[some], whose[some]
            looked.append((own, came))
            ways = paths[front[came]]
            if 4 * len(own) * width > n:
                got = np.zeros(n + 1)
                for low in range(0, len(own), ROWS):
                    m = len(own[low : low + ROWS])
                    rows.ends.take(own[low : low + m], axis=0, out=ends[:m], mode="clip")
                    held[:m] = ways[low : low + m, None]
                    np.add.at(got, ends[:m].ravel(), held[:m].ravel())
                got[seen] = 0
                paths += got
                fresh = np.flatnonzero(got)
            else:
                to = rows.ends[own].ravel()
                new = ~seen[to]
                fresh = to[new]
                np.add.at(paths, fresh, np.repeat(ways, width)[new])
            fresh = np.concatenate([after, fresh])
            turn[fresh] = np.arange(len(fresh))
            after = fresh[turn[fresh] == np.arange(len(fresh))]
            reached = np.count_nonzero(after > source)
            if reached == missing:
                break
        missing -= reached
        seen[after] = True
        levels.append((front, looked, after))
        front = after
    depends = np.zeros(n)
    for front, looked, after in reversed(levels):
        give[after] = (np.where(after > source, weight[after], 0) + depends[after]) / paths[after]
        for own, came in looked:
            sums = np.empty(len(own))
            for low in range(0, len(own), ROWS):
                m = len(own[low : low + ROWS])
                rows.ends.take(own[low : low + m], axis=0, out=ends[:m], mode="clip")
                give.take(ends[:m], out=held[:m], mode="clip")
                sums[low : low + m] = held[:m] @ ones
            depends[front] += paths[front] * np.bincount(came, weights=sums, minlength=len(front))
        give[after] = 0
    depends[source] = 0
    return depends


def bits(places: np.ndarray, nodes: int) -> np.ndarray:
    """A row of 64-bit words for each node: bit i at node ``places[i]``."""
    out = np.zeros((nodes, -(-len(places) // 64)), np.uint64)
    i = np.arange(len(places))
    np.bitwise_or.at(out, (places, i // 64), np.uint64(1) << (i % 64).astype(np.uint64))
    return out


def searched(back: Arrays, start: np.ndarray, most: int | None = None) -> Iterator[np.ndarray]:
    """The bits that reach each node first after 1, 2, ... steps; ``back`` holds the steps by their ends."""
    borders = np.unique(np.append(np.searchsorted(back.start, np.arange(0, len(back.dst), PIECE)), len(back.start) - 1))
    seen, front, level = start.copy(), start, 0
    while most is None or level < most:
        level += 1
        active, grown = front.any(axis=1), np.zeros_like(front)
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            here = back.dst[back.start[low] : back.start[high]]
            took = active[here]
            upto = np.concatenate([[0], np.cumsum(took)])[back.start[low : high + 1] - back.start[low]]
            some = np.flatnonzero(upto[1:] > upto[:-1])
            if len(some):
                grown[low + some] = np.bitwise_or.reduceat(front[here[took]], upto[some], axis=0)
        front = grown & ~seen
        if not front.any():
            return
        seen |= front
        yield front


def coins(steps: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each place of a step, from a hash of it and the seed."""
    mixed = (steps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed * 0x5851F42D % (1 << 32))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
