"""Connected components and spanning forests of undirected graphs given as edge DataFrames.

Three levels, each exact: every partition replaces its edges by its own spanning forest (a narrow pass, as
forest(A + B) = forest(forest(A) + forest(B))); rounds of large and small stars contract what is left; once at most
`finish_edges` edges remain, one task ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.cut import cut

#: Vertices that a partition's forest holds at once; it emits its edges and starts anew beyond that.
LOCAL_VERTICES = 2_000_000
#: Edges that one task may finish.
FINISH_EDGES = 100_000


class UnionFind:
    """Disjoint sets over any hashable ids; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        """Whether a and b were in different sets."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a < b:
            a, b = b, a
        self.parent[a] = b
        return True

    def __len__(self) -> int:
        return len(self.parent)


def _stars(sets: UnionFind) -> tuple[np.ndarray, np.ndarray]:
    ids = np.fromiter(sets.parent, np.int64, len(sets))
    roots = np.fromiter((sets.find(x) for x in ids.tolist()), np.int64, len(ids))
    keep = ids != roots
    return ids[keep], roots[keep]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()

    def out() -> Iterator[pa.RecordBatch]:
        a, b = _stars(sets)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets) > LOCAL_VERTICES:
            yield from out()
            sets = UnionFind()
    yield from out()


def _oriented(edges: DataFrame, src: str, dst: str) -> DataFrame:
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    return edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")


def _flip(e: DataFrame) -> DataFrame:
    return e.select(F.col("v").alias("u"), F.col("u").alias("v"))


def _large_star(e: DataFrame) -> DataFrame:
    """Links each larger neighbour of a vertex to the least of the vertex and its neighbours."""
    both = e.unionAll(_flip(e))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links each vertex's smaller neighbours, and itself, to the least of them. `e` has u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1] or 0


def star_edges(edges: DataFrame, src: str = "src", dst: str = "dst", finish_edges: int = FINISH_EDGES, max_rounds: int = 100) -> DataFrame:
    """(u, v) for every vertex u but the least of its component, v being that least vertex.

    Null endpoints make no link; self loops and repeats change nothing. An empty input gives no rows.
    """
    clean = _oriented(edges, src, dst)
    e = cut(clean.mapInArrow(_local_stars, "u long, v long").distinct())
    seen = _mark(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            return e
        if seen[0] <= finish_edges:
            return cut(e.coalesce(1).mapInArrow(_local_stars, "u long, v long"))
        e = cut(_small_star(_large_star(e)))
        if (now := _mark(e)) == seen:
            return e
        seen = now
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src", dst: str = "dst", vid: str = "vid", **how) -> DataFrame:
    """(vid, label) with label the least vertex id of the component.

    Without `vertices` the domain is the edges' endpoints; with it, `vertices[vid]`, so isolated vertices label
    themselves and endpoints outside the domain are still connected through but not returned.
    """
    stars = star_edges(edges, src, dst, **how)
    if vertices is None:
        ends = edges.select(F.explode(F.array(F.col(src).cast("long"), F.col(dst).cast("long"))).alias("vid")).where("vid is not null")
    else:
        ends = vertices.select(F.col(vid).cast("long").alias("vid")).where("vid is not null")
    return ends.distinct().join(stars, F.col("vid") == F.col("u"), "left").select("vid", F.coalesce("v", "vid").alias("label"))


def component_count(labels: DataFrame) -> DataFrame:
    """One row `components`: the vertices that label themselves."""
    return labels.agg(F.count_if(F.col("vid") == F.col("label")).alias("components"))


def _local_forest(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for batch in batches:
            if len(sets) > LOCAL_VERTICES:
                sets = UnionFind()  # a smaller forest is still exact: fewer edges go, none is lost
            pairs = zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)
            keep = [sets.union(a, b) for a, b in pairs]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def spanning_forest(edges: DataFrame, eid: str = "eid", src: str = "src", dst: str = "dst", finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(eid, u, v): a spanning forest that is the minimum one by edge id, so the choice is deterministic."""
    from quillgraph.operators.msf import minimum_spanning_forest

    unit = edges.select(F.col(eid).alias("eid"), F.col(src).alias("u"), F.col(dst).alias("v"), F.lit(0).cast("long").alias("w"))
    return minimum_spanning_forest(unit, finish_edges=finish_edges).select("eid", "u", "v")


def same_component(labels: DataFrame, a: Column | str, b: Column | str, pairs: DataFrame) -> DataFrame:
    """`pairs` with `connected`: whether both ends carry one label (false where an end is unknown)."""
    la = labels.select(F.col("vid").alias("_va"), F.col("label").alias("_la"))
    lb = labels.select(F.col("vid").alias("_vb"), F.col("label").alias("_lb"))
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return pairs.join(la, a == F.col("_va"), "left").join(lb, b == F.col("_vb"), "left").withColumn("connected", F.coalesce(F.col("_la") == F.col("_lb"), F.lit(False))).drop("_va", "_la", "_vb", "_lb")
