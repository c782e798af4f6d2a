"""Algorithms that run on one graph in one task: each checks the graph's size first. Many graphs, told apart by a key, run in parallel."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDGES = 5_000_000


def _checked(e: DataFrame, key: str, max_edges: int) -> None:
    most = e.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most is not None and most > max_edges:
        raise ValueError(f"a graph has {most} edges, more than {max_edges}")


def flow_value(src: list[int], dst: list[int], cap: list[int], s: int, t: int) -> int:
    """The largest flow from s to t: blocking flows over levels of shortest paths in what capacity is left."""
    out: dict[int, list[int]] = {s: [], t: []}
    head, left = [], []
    for u, v, c in zip(src, dst, cap, strict=True):
        for a, b, x in ((u, v, c), (v, u, 0)):
            out.setdefault(a, []).append(len(head))
            head.append(b)
            left.append(x)
    total = 0
    while s != t:
        level, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for k in out[u]:
                if left[k] > 0 and head[k] not in level:
                    level[head[k]] = level[u] + 1
                    todo.append(head[k])
        if t not in level:
            break
        tried, path, u = dict.fromkeys(level, 0), [], s
        while True:
            if u == t:
                pushed = min(left[k] for k in path)
                for k in path:
                    left[k] -= pushed
                    left[k ^ 1] += pushed
                total += pushed
                path = path[: next(i for i, k in enumerate(path) if left[k] == 0)]
                u = head[path[-1]] if path else s
            while tried[u] < len(out[u]):
                k = out[u][tried[u]]
                if left[k] > 0 and level.get(head[k]) == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(out[u]):
                path.append(out[u][tried[u]])
                u = head[path[-1]]
            elif u == s:
                break
            else:
                u = head[path.pop() ^ 1]
                tried[u] += 1
    return total


def max_flow(e: DataFrame, source: int, sink: int, key: str = "graph", max_edges: int = MAX_EDGES) -> DataFrame:
    """(graph, flow) for edges (graph, src, dst, cap), capacities integers: 0 for a graph without a path, or with source and sink the same.

    Equal edges add up; edges with a null or without capacity are left out.
    """
    e = e.select(key, "src", "dst", F.col("cap").cast("long").alias("cap")).where("cap > 0 and src is not null and dst is not null").groupBy(key, "src", "dst").agg(F.sum("cap").alias("cap"))
    _checked(e, key, max_edges)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        return pd.DataFrame({key: pdf[key].iloc[:1].to_numpy(), "flow": [flow_value(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["cap"].tolist(), source, sink)]})

    return e.groupBy(key).applyInPandas(one, f"{key} {e.schema[key].dataType.simpleString()}, flow long")


def fiedler(u: np.ndarray, v: np.ndarray, n: int, error: float = 0.5e-7, max_rounds: int = 1_000_000) -> np.ndarray:
    """The second eigenvector of the Laplacian, by powers of twice the largest degree times I, less L, without the first; checked each 100 rounds.

    That matrix has no negative eigenvalues, so that graphs near bipartite ones converge, too. u, v hold both directions.
    """
    degree = np.bincount(u, minlength=n)
    x = np.random.default_rng(0).random(n)
    x /= np.linalg.norm(x)
    for k in range(max_rounds):
        y = x - x.mean()
        new = (2 * degree.max() - degree) * y + np.bincount(u, y[v], n)
        size = np.linalg.norm(new)
        if size < 1e-12:
            return y
        new /= size
        if k % 100 == 0 and ((new - x) ** 2).sum() < error:
            return new
        x = new
    raise RuntimeError("too many rounds")


def spectral_partition(e: DataFrame, key: str = "graph", max_edges: int = MAX_EDGES) -> DataFrame:
    """(graph, vid, side) of undirected edges (graph, src, dst): vertices whose value in the second eigenvector is below the median's and the others.

    The side of a graph's smallest vertex is true. Self loops are left out, repeated edges count once, and a graph has the vertices that its edges name.
    """
    e = e.select(key, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()
    _checked(e, key, max_edges)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        ids, at = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        x = fiedler(np.concatenate([at[:, 0], at[:, 1]]), np.concatenate([at[:, 1], at[:, 0]]), len(ids))
        side = x < np.sort(x)[len(x) // 2]
        return pd.DataFrame({key: pdf[key].iloc[0], "vid": ids, "side": side == side[0]})

    return e.groupBy(key).applyInPandas(one, f"{key} {e.schema[key].dataType.simpleString()}, vid long, side boolean")
