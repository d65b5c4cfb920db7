"""Exact top-k inner products: best-first search over an M-tree.

With c the largest |x|^2 of all rows, the points x' = (x, sqrt(c - |x|^2)) and q' = (q, 0) satisfy |q' - x'|^2 = |q|^2 + c - 2 q.x,
so the best inner product is the nearest neighbour of a metric. The upper level of the tree is the directory of `vectors`
(pivots with covering radii); below it each written page is a tree of nodes of at most ``PAGE`` entries. A node has a routing
point, a covering radius and, for each entry, its distance to the routing point. A query takes nodes in order of their least
possible distance; before it computes a distance it applies the stored ones: an entry o of the node p can only be near if
| d(q, p) - d(p, o) | - radius(o) is below the bound, which a query brings along from the pages it has seen. Bounds get a slack
for rounding and final scores are integers computed exactly, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .vectors import far

PAGE = 128
TOP = 5


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x.astype(np.float64)).astype(np.int64)


class MTree:
    """A tree over points, built by splitting at two far points; inner nodes hold at most ``PAGE`` routing entries.

    It is kept without its points: search() gets them back.
    """

    def __init__(self, points: np.ndarray):
        groups, todo = [], [np.arange(len(points))] if len(points) else []
        while todo:
            g = todo.pop()
            x = points[g]
            if len(g) <= PAGE:
                groups.append(g)
                continue
            a = x[far(x, x[0]).argmax()]
            b = x[far(x, a).argmax()]
            order = np.argsort(far(x, a) - far(x, b), kind="stable")  # equal points split too
            todo += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        # a node: routing point, radius, entries; leaves hold rows, inner nodes hold nodes, each with its distance to the router
        level = [self._node(g, points[g], np.zeros(len(g)), True) for g in groups]
        while len(level) > 1:
            up = []
            for at in range(0, len(level), PAGE):
                part = level[at : at + PAGE]
                up.append(self._node(part, np.array([p["router"] for p in part]), np.array([p["radius"] for p in part]), False))
            level = up
        self.root = level[0] if level else None

    def _node(self, entries, points, radii, leaf):
        router = points.mean(0)
        to_router = far(points, router)
        return {"router": router, "radius": float((to_router + radii).max()), "entries": entries, "radii": radii, "to_router": to_router, "leaf": leaf}

    def search(self, points: np.ndarray, q: np.ndarray, score, top: int, limit: float = np.inf) -> tuple[list[tuple[int, int]], int]:
        """The ``top`` best rows within ``limit`` as (-score, row), and how many distances were computed. score(rows): exact integers."""
        if self.root is None:
            return [], 0
        best: list[tuple[int, int]] = []  # ascending by (-score, row)
        computed, slack = 1, vectors.SLACK
        limit = limit * (1 + slack) + slack
        d = float(far(self.root["router"][None], q)[0])
        heap = [(max(0.0, d - self.root["radius"]), 0, d, self.root)]
        serial = 0
        while heap:
            least, _, d, node = heapq.heappop(heap)
            if least > limit:
                break
            may = np.flatnonzero(np.abs(d - node["to_router"]) - node["radii"] <= limit)
            if not len(may):
                continue
            held = points[node["entries"][may]] if node["leaf"] else np.array([node["entries"][k]["router"] for k in may.tolist()])
            dist = far(held, q)
            computed += len(may)
            if node["leaf"]:
                close = may[dist <= limit]
                if len(close):
                    rows = node["entries"][close]
                    best = sorted([*best, *zip((-score(rows)).tolist(), rows.tolist(), strict=True)])[:top]
                    if len(best) == top:
                        bound = float(far(points[int(best[-1][1])][None], q)[0])
                        limit = min(limit, bound * (1 + slack) + slack)
            else:
                for k, f in zip(may.tolist(), dist.tolist(), strict=True):
                    low = f - node["radii"][k]
                    if low <= limit:
                        serial += 1
                        heapq.heappush(heap, (max(0.0, low), serial, f, node["entries"][k]))
        return best, computed


def space(largest: int) -> vectors.Space:
    """The metric of inner products of quantised vectors whose squared norms are at most ``largest``."""

    def point(x):
        a = quantised(x)
        return np.hstack([a.astype(np.float64), np.sqrt(np.maximum(0, largest - (a * a).sum(1)))[:, None]])

    def query(x):
        return np.hstack([quantised(x).astype(np.float64), np.zeros((len(x), 1))])

    return vectors.Space(point, query)


def search_page(rows, ids, x, tree: MTree, metric: vectors.Space, q_rows, q, bounds, top: int):
    """(query, vec_id, distance, score) on one page; rows ascend by id, so ties of a score go to the smaller id."""
    a, b = quantised(x), quantised(q)
    points, asked = metric.point(x), metric.query(q)
    out = []
    for k, (row, bound) in enumerate(zip(q_rows.tolist(), bounds.tolist(), strict=True)):
        own = np.flatnonzero(rows == row)  # its own row takes no part; further rows with its id do
        skip = int(own[0]) if len(own) else -1
        found, _ = tree.search(points, asked[k], lambda r, v=b[k]: a[r] @ v, top + (skip >= 0), bound)
        found = [(r, -s) for s, r in found if r != skip][:top]
        if found:
            dist = far(points[[r for r, _ in found]], asked[k]).tolist()
            out += [(k, int(ids[r]), d, s) for (r, s), d in zip(found, dist, strict=True)]
    return out


def top_products(table: DataFrame, every: int = 50, top: int = TOP, page_rows: int = vectors.ROWS, cells: int = vectors.CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``top`` best inner products.

    Components become floor(256 x), x as double; scores are exact integers; ties go to the smaller vec_id; a query's own row is
    left out. Null ids, null or empty vectors and vectors with null or non-finite components take no part; vectors of unlike
    length never meet. Repeated rows are candidates, and queries, of their own. An empty table gives an empty result. Components
    so large that a score might not fit 63 bits raise an ArithmeticException.
    """
    rows = vectors.usable(table, zero=True)
    # floor and the cast to long raise beyond 64 bits, and so do the products and sums
    square = F.aggregate("embedding", F.lit(0).cast("long"), lambda t, v: t + F.floor(256 * v.cast("double")) * F.floor(256 * v.cast("double")))
    largest = {r["d"]: r["c"] for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.max(square).alias("c")).collect()}
    index = vectors.Index(rows, lambda dim: space(largest[dim]), lambda x, metric: MTree(metric.point(x)), "mips", page_rows, cells)
    found = index.nearest(every, top, lambda *page: search_page(*page, top), [F.col("score").desc()])
    return found.select("query_id", "rank", "vec_id", "score")
