import heapq
import random

import pytest

from flowatlas.operators import paths
from flowatlas.sources import store

EDGES, PAIRS = "node_lo long, node_hi long, length double", "source long, target long"


def canonical(edges, source):
    """Distances in millionths and, for each node, the smallest neighbour on a shortest way."""
    graph = {}
    for a, b, w in edges:
        if a != b:
            w = max(round(w * 10**6), 1)
            for x, y in ((a, b), (b, a)):
                graph.setdefault(x, {})[y] = min(w, graph.get(x, {}).get(y, w))
    best, queue = {source: 0}, [(0, source)]
    while queue:
        d, a = heapq.heappop(queue)
        if d == best[a]:
            for b, w in graph.get(a, {}).items():
                if d + w < best.get(b, 10**30):
                    best[b] = d + w
                    heapq.heappush(queue, (d + w, b))
    parent = {v: min(u for u, w in graph[v].items() if best.get(u, 10**30) + w == best[v]) for v in best if v != source}
    return best, parent


def check(spark, edges, pairs):
    found = paths.shortest_paths(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(edges, EDGES)).collect()
    wanted = {}
    for s, t in set(pairs):
        if s is None or t is None:
            continue
        best, parent = canonical(edges, s)
        if t in best:
            way = [t]
            while way[-1] != s:
                way.append(parent[way[-1]])
            wanted[s, t] = (best[t] / 10**6, way[::-1])
    assert len(found) == len(wanted)
    assert {(r["source"], r["target"]): (r["length"], r["path"]) for r in found} == wanted


@pytest.mark.parametrize("seed, nodes, edges, longest", [(1, 60, 75, 3), (3, 25, 80, 2)])
def test_same_ways_as_dijkstra(spark, seed, nodes, edges, longest):
    r = random.Random(seed)
    rows = [(r.randrange(nodes), r.randrange(nodes), float(r.randint(0, longest))) for _ in range(edges)]
    check(spark, rows, [(r.randrange(nodes), r.randrange(nodes)) for _ in range(12)] + [(3, 3), (nodes + 5, 1), (nodes + 5, nodes + 5), (None, 1), (1, None)])


def test_rings_chains_and_dead_ends(spark):
    chain = [(i, i + 1, 0.1) for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 9, 1.0) for i in range(9)]  # apart from all others
    loop = [(20, 200, 1.0)] + [(200 + i, 201 + i, 1.0) for i in range(5)] + [(205, 20, 1.0)]  # leads back to where it starts
    twice = [(40, 300, 1.0), (300, 50, 1.0), (40, 301, 1.0), (301, 50, 1.0), (50, 40, 2.0)]
    check(spark, chain + ring + loop + twice, [(0, 40), (0, 203), (0, 50), (5, 5), (5, 6), (100, 104), (0, 100), (50, 0)])


def test_empty_tables(spark):
    check(spark, [], [(1, 2), (1, 1)])


def test_ties_on_a_lattice(spark):
    n = 9
    edges = [(i, i + 1, 1.0) for i in range(n * n) if i % n < n - 1] + [(i, i + n, 1.0) for i in range(n * n - n)]
    check(spark, edges, [(0, n * n - 1), (n - 1, n * n - n), (4, 76), (40, 0)])


def counted(spark, monkeypatch, edges, pairs):
    """The ways, the rows that a search wrote, and its rounds."""
    rows, rounds = [], []
    real, least = store.shared_table, paths._least

    def spy(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(paths, "shared_table", spy)
    monkeypatch.setattr(paths, "_least", lambda parts: rounds.append(1) or least(parts))
    found = paths.shortest_paths(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(edges, EDGES)).collect()
    return found, sum(rows), len(rounds) // 2


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 400
    found, rows, rounds = counted(spark, monkeypatch, [(i, i + 1, 1.0) for i in range(n)], [(0, n)])
    assert found[0]["path"] == list(range(n + 1)) and found[0]["length"] == n
    assert rounds <= 2  # n rounds without contraction
    assert rows < 2 * n * (n.bit_length() + 3)  # n * n / 2 labels without it


def test_lattice_takes_a_quarter_of_the_rounds(spark, monkeypatch):
    n = 17
    edges = [(i, i + 1, 1.0 + i % 3) for i in range(n * n) if i % n < n - 1] + [(i, i + n, 1.0 + i % 2) for i in range(n * n - n)]
    found, _, rounds = counted(spark, monkeypatch, edges, [(0, n * n - 1)])
    assert len(found[0]["path"]) >= 2 * n - 1
    assert rounds <= (2 * n - 2) / 4 + 5
