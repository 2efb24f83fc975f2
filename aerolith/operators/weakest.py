"""Weakest edges between two points: which edges lie on a simple path, the least of them, and tracks from which such
edges were removed until no two points of one image are joined.

An edge lies on a simple path from s to t exactly if it is in one biconnected component with an edge from s to t added
to the graph. So no path is enumerated. Without that edge, these are the edges of the blocks (biconnected components)
between s and t, and blocks form a tree: one depth-first search finds the tree of all graphs of a task, with the weakest
edge of each block, and a pair climbs it from both ends. The removal of a bridge only cuts the tree; the removal of
another edge asks for a new search of its component. A connected component of the match graph is handled in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.graph import components
from aerolith.runtime import written

#: Edges that are dealt to one task.
TASK_EDGES = 50_000

Edge = tuple[int, int, float]


def path_edges(edges: list[Edge], s: int, t: int) -> list[Edge]:
    """The edges ``(a, b, score)`` that lie on a simple path from ``s`` to ``t``; none where there is no path."""
    around: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, (a, b, _) in enumerate([*edges, (s, t, 0.0)]):
        around[a].append((b, k))
        around[b].append((a, k))
    added = len(edges)
    order, low, stack = {s: 0}, {s: 0}, []
    walk = [(s, -1, iter(around[s]))]
    while walk:
        node, by, rest = walk[-1]
        step = next(((m, k) for m, k in rest if k != by), None)
        if step is None:
            walk.pop()
            if walk:
                parent = walk[-1][0]
                low[parent] = min(low[parent], low[node])
                if low[node] >= order[parent]:
                    block = []
                    while True:
                        block.append(stack.pop())
                        if block[-1] == by:
                            break
                    if added in block:
                        return [edges[k] for k in sorted(block) if k != added]
            continue
        m, k = step
        if m not in order:
            order[m] = low[m] = len(order)
            stack.append(k)
            walk.append((m, k, iter(around[m])))
        elif order[m] < order[node]:
            stack.append(k)
            low[node] = min(low[node], order[m])
    return []


def weakest(edges: Iterable[Edge]) -> Edge | None:
    """The edge of least score, ties to the lower ends."""
    return min(edges, key=lambda e: (e[2], e[0], e[1]), default=None)


class Blocks:
    """Blocks of graphs whose edges join the nodes ``a[k]`` and ``b[k]`` of 0 to n - 1; a lower edge is weaker. A node's
    block is the one through which the search came to it, ``top`` the node at which a block hangs; a node's place in
    ``order`` is after that of the top of its block."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int) -> None:
        # What is left of an edge's sum of ends without one end is the other.
        self.sums, self.around = (a + b).tolist(), [[] for _ in range(n)]
        for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            self.around[p].append(k)
            self.around[q].append(k)
        self.gone = bytearray(len(a))
        self.order, self.low, self.block, self.found = [-1] * n, [0] * n, [-1] * n, 0
        self.top: list[int] = []
        self.least: list[int] = []
        self.size: list[int] = []
        self.search(0, n)

    def search(self, first: int, stop: int) -> None:
        """(Re)build the blocks of the nodes from ``first`` to before ``stop``, which are whole components."""
        order, low, around, sums, gone = self.order, self.low, self.around, self.sums, self.gone
        found = self.found
        for v in range(first, stop):
            order[v] = self.block[v] = -1
        for start in range(first, stop):
            if order[start] >= 0:
                continue
            order[start] = low[start] = found
            found += 1
            walk, via, rest = [start], [-1], [iter(around[start])]
            edges: list[int] = []
            nodes: list[int] = []
            while walk:
                v, by = walk[-1], via[-1]
                for k in rest[-1]:
                    if k == by or gone[k]:
                        continue
                    w = sums[k] - v
                    if order[w] < 0:
                        order[w] = low[w] = found
                        found += 1
                        edges.append(k)
                        nodes.append(w)
                        walk.append(w)
                        via.append(k)
                        rest.append(iter(around[w]))
                        break
                    if order[w] < order[v]:
                        edges.append(k)
                        if order[w] < low[v]:
                            low[v] = order[w]
                else:
                    walk.pop()
                    via.pop()
                    rest.pop()
                    if not walk:
                        continue
                    up = walk[-1]
                    if low[v] >= order[up]:
                        self._close(edges, nodes, by, v, up)
                    elif low[v] < low[up]:
                        low[up] = low[v]
        self.found = found

    def _close(self, edges: list[int], nodes: list[int], by: int, v: int, up: int) -> None:
        """The block below ``up`` that the search entered by the edge ``by`` to ``v``."""
        mine, least, size = len(self.top), by, 1
        while (k := edges.pop()) != by:
            size += 1
            if k < least:
                least = k
        while (w := nodes.pop()) != v:
            self.block[w] = mine
        self.block[v] = mine
        self.top.append(up)
        self.least.append(least)
        self.size.append(size)

    def between(self, s: int, t: int) -> int:
        """The block between ``s`` and ``t`` that has the weakest edge; -1 where there is no path."""
        order, block, top, least = self.order, self.block, self.top, self.least
        best = -1
        while s != t:
            if order[s] < order[t]:
                s, t = t, s
            mine = block[s]
            if mine < 0:
                return -1
            if best < 0 or least[mine] < least[best]:
                best = mine
            if mine == block[t]:
                break
            s = top[mine]
        return best

    def part(self, s: int, t: int, first: int, stop: int) -> None:
        """Take out weakest edges until nothing joins ``s`` and ``t``, nodes of the component from ``first`` to before
        ``stop``."""
        while (worst := self.between(s, t)) >= 0:
            edge = self.least[worst]
            self.gone[edge] = 1
            if self.size[worst] > 1:
                self.search(first, stop)
                continue
            # A bridge: below it hangs the end that isn't the block's top.
            self.block[self.sums[edge] - self.top[worst]] = -1


def _numbered(graph: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, Blocks]:
    """A task's edges by component and from the weakest, its nodes by component, these, and the blocks."""
    graph = graph.sort_values(["root", "score", "a", "b"], ignore_index=True)
    ends = pd.DataFrame({"root": np.tile(graph.root.to_numpy(), 2), "node": np.concatenate([graph.a.to_numpy(), graph.b.to_numpy()])})
    ends = ends.drop_duplicates().sort_values(["root", "node"], ignore_index=True)
    nodes, by_node = ends.node.to_numpy(), np.argsort(ends.node.to_numpy(), kind="stable")
    at = lambda c: by_node[np.searchsorted(nodes, graph[c].to_numpy(), sorter=by_node)]
    return graph, nodes, ends.root.to_numpy(), Blocks(at("a"), at("b"), len(nodes))


def kept_edges(graph: pd.DataFrame) -> pd.DataFrame:
    """The edges ``root, a, b, score`` that remain when, for each two points of one image (``ia``, ``ib``) in order of
    image and points, the weakest edge on a simple path between them is taken out until there is none."""
    graph, nodes, roots, blocks = _numbered(graph)
    image = np.zeros(len(nodes), np.int64)
    order = np.argsort(nodes, kind="stable")
    for c, i in (("a", "ia"), ("b", "ib")):
        image[order[np.searchsorted(nodes, graph[c].to_numpy(), sorter=order)]] = graph[i].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]])) if len(roots) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(roots)))
    first, stop = np.repeat(starts, sizes).tolist(), np.repeat(starts + sizes, sizes).tolist()
    ranked = np.lexsort((nodes, image, roots))
    run = (roots[ranked][1:] != roots[ranked][:-1]) | (image[ranked][1:] != image[ranked][:-1])
    cuts = [0, *(np.flatnonzero(run) + 1).tolist(), len(ranked)]
    ranked = ranked.tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        for k in range(lo, hi - 1):
            s = ranked[k]
            for t in ranked[k + 1 : hi]:
                blocks.part(s, t, first[s], stop[s])
    return graph[~np.frombuffer(blocks.gone, np.uint8).astype(bool)]


def weakest_of(graph: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """``s, t, a, b, score`` for the pairs ``wanted(s, t)``, both points in one component of ``graph``."""
    graph, nodes, _, blocks = _numbered(graph)
    order = np.argsort(nodes, kind="stable")
    s, t = (order[np.searchsorted(nodes, wanted[c].to_numpy(), sorter=order)].tolist() for c in "st")
    worst = np.array([blocks.between(p, q) for p, q in zip(s, t, strict=True)], np.int64)
    some = worst >= 0
    edge = graph.iloc[np.array(blocks.least, np.int64)[worst[some]]]
    return pd.DataFrame({"s": wanted.s.to_numpy()[some], "t": wanted.t.to_numpy()[some], "a": edge.a.to_numpy(), "b": edge.b.to_numpy(), "score": edge.score.to_numpy()})


def _by_component(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with their component, and the components with the task to which they are dealt."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a <> b")
    # By range, so that graphs of nodes with near numbers are whole where components first contract them.
    edges = written(edges.repartitionByRange("a", "b"), "weighted")
    root = written(components(edges, "weakest"), "roots")
    sized = edges.join(root.select(F.col("node").alias("a"), "root"), "a")
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    deal = lambda df: df.withColumn("task", F.pmod(F.xxhash64("root"), F.lit(tasks)))
    return deal(sized), deal(root)


def weakest_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``s, t, a, b, score``: for each of ``pairs(s, t)`` the weakest edge on any simple path between the two points; no
    row where there is none."""
    sized, root = _by_component(edges)
    asked = pairs.select("s", "t").distinct().where("s <> t")
    home, other = (root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"), F.col("task").alias(f"{c}_task")) for c in "st")
    asked = asked.join(home, "s").join(other, "t").where("s_root = t_root").select("s_task", "s_root", "s", "t")

    def run(graph: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return weakest_of(graph, wanted)

    both = sized.select("task", "root", "a", "b", "score").groupBy("task").cogroup(asked.groupBy("s_task"))
    return both.applyInPandas(run, "s long, t long, a long, b long, score double")


def tracks_by_removal(edges: DataFrame, image_of: str) -> DataFrame:
    """``track_id, node``: tracks with one point for each image, after the removal of weakest edges. ``image_of`` gives a
    point's image from ``node``. Points without an edge left are tracks of their own."""
    sized, root = _by_component(edges)
    image = lambda c: F.expr(image_of.replace("node", c))

    def run(graph: pd.DataFrame) -> pd.DataFrame:
        return kept_edges(graph)[["a", "b", "score"]]

    rows = sized.select("task", "root", "a", "b", "score", image("a").alias("ia"), image("b").alias("ib"))
    kept = written(rows.groupBy("task").applyInPandas(run, "a long, b long, score double"), "kept")
    joined = components(kept.select("a", "b"), "tracks")
    return root.select("node").join(joined, "node", "left").select(F.coalesce("root", "node").alias("track_id"), "node")
