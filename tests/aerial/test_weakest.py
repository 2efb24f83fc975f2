import random

import pandas as pd
import pytest

from aerolith.operators import weakest as w


def simple_paths(edges, s, t):
    """Every simple path as a list of edges."""
    out = []

    def go(node, seen, path):
        if node == t:
            out.append(list(path))
            return
        for e in edges:
            for a, b in ((e[0], e[1]), (e[1], e[0])):
                if a == node and b not in seen:
                    go(b, seen | {b}, [*path, e])

    go(s, {s}, [])
    return out


def graph(rng, nodes=7, edges=11):
    found = {(min(p), max(p)) for p in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)) if p[0] != p[1]}
    scores = rng.sample(range(1, 100), len(found)) if rng.random() < 0.7 else [rng.randrange(1, 4) for _ in found]
    return [(a, b, s / 100) for (a, b), s in zip(sorted(found), scores, strict=True)]


@pytest.mark.parametrize("seed", range(150))
def test_edges_of_simple_paths(seed):
    rng = random.Random(seed)
    edges = graph(rng)
    for s, t in ((0, 1), (2, 5), (6, 3)):
        want = {e for p in simple_paths(edges, s, t) for e in p}
        assert set(w.path_edges(edges, s, t)) == want
        minima = [w.weakest(p) for p in simple_paths(edges, s, t)]
        assert w.weakest(minima) == w.weakest(w.path_edges(edges, s, t))


def by_paths(edges, image):
    """Removal as it is stated: the least of the paths' weakest edges goes until no path is left."""
    left = list(edges)
    for i in sorted(set(image.values())):
        points = sorted(n for n in image if image[n] == i)
        for k, s in enumerate(points):
            for t in points[k + 1 :]:
                while paths := simple_paths(left, s, t):
                    left.remove(w.weakest([w.weakest(p) for p in paths]))
    return left


def parts(edges, nodes):
    of = {n: {n} for n in nodes}
    for a, b, *_ in edges:
        if of[a] is not of[b]:
            joined = of[a] | of[b]
            for n in joined:
                of[n] = joined
    return {frozenset(v) for v in of.values()}


@pytest.mark.parametrize("task_edges", [50_000, 4])
def test_tracks_by_removal(spark, monkeypatch, task_edges):
    """Many small graphs at once, with several conflicts each, against the removal path by path."""
    monkeypatch.setattr(w, "TASK_EDGES", task_edges)
    rng = random.Random(5)
    edges, want, nodes = [], set(), set()
    for k in range(25):
        mine = [(a + 10 * k, b + 10 * k, s) for a, b, s in graph(rng, 7, 9)]
        own = {n for e in mine for n in e[:2]}
        want |= parts(by_paths(mine, {n: n % 10 % 4 for n in own}), own)
        edges, nodes = edges + mine, nodes | own
    got = w.tracks_by_removal(spark.createDataFrame(edges, "a long, b long, score double"), "node % 10 % 4").collect()
    found = {}
    for r in got:
        found.setdefault(r.track_id, set()).add(r.node)
    assert {frozenset(v) for v in found.values()} == want and len(got) == len(nodes)
    assert all(min(v) == k and len({n % 10 % 4 for n in v}) == len(v) for k, v in found.items())


def test_weakest_between(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.4), (1, 3, 0.5), (3, 4, 0.2), (3, 9, 0.1), (20, 21, 0.7)]
    pairs = [(1, 4), (1, 3), (1, 20), (20, 21), (5, 6), (1, 1)]
    got = w.weakest_between(spark.createDataFrame(edges, "a long, b long, score double"), spark.createDataFrame(pairs, "s long, t long"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2, 3, 0.4), (1, 4, 3, 4, 0.2), (20, 21, 20, 21, 0.7)]


def frame(edges, image):
    return pd.DataFrame([(0, a, b, s, image(a), image(b)) for a, b, s in edges], columns=["root", "a", "b", "score", "ia", "ib"])


def test_bridges_ask_for_no_new_search(monkeypatch):
    """A chain in which every two of 200 points of an image are parted: one search of the blocks, whatever is cut."""
    rng = random.Random(2)
    edges = [(n, n + 1, rng.random()) for n in range(1999)]
    searched = []
    search = w.Blocks.search
    monkeypatch.setattr(w.Blocks, "search", lambda self, *part: (searched.append(part), search(self, *part))[1])
    kept = w.kept_edges(frame(edges, lambda n: n % 10))
    assert searched == [(0, 2000)]
    assert all(len({n % 10 for n in p}) == len(p) for p in parts(list(zip(kept.a, kept.b, strict=True)), range(2000)))


@pytest.mark.parametrize("seed", range(40))
def test_climbing_blocks_equals_the_search_of_paths(seed):
    rng = random.Random(1000 + seed)
    edges = graph(rng, 12, 14)
    nodes = sorted({n for e in edges for n in e[:2]})
    pairs = [(s, t) for s in nodes for t in nodes if s < t]
    root = {n: min(p) for p in parts(edges, nodes) for n in p}
    table = pd.DataFrame([(root[a], a, b, s) for a, b, s in edges], columns=["root", "a", "b", "score"])
    joined = [(s, t) for s, t in pairs if root[s] == root[t]]
    got = w.weakest_of(table, pd.DataFrame(joined, columns=["s", "t"]))
    assert [tuple(x) for x in got.itertuples(index=False)] == [(s, t, *w.weakest(w.path_edges(edges, s, t))) for s, t in joined]
