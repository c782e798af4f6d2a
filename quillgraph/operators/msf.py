"""Minimum (and maximum) spanning forests by rounds of lightest outgoing edges.

Edges are (eid, u, v, w). Ties are broken by (w, eid), which makes the forest unique. Every partition first replaces its
edges by its own forest, as MSF(A + B) = MSF(MSF(A) + MSF(B)); rounds over components follow; once at most `finish_edges`
edges remain, one task ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import FINISH_EDGES, UnionFind
from quillgraph.plans.cut import cut

#: Edges that a partition sorts at once.
LOCAL_EDGES = 1_000_000


def _kruskal(table: pa.Table, ends: tuple[str, str]) -> pa.Table:
    table = table.sort_by([("w", "ascending"), ("eid", "ascending")])
    sets = UnionFind()
    keep = [a != b and sets.union(a, b) for a, b in zip(table[ends[0]].to_pylist(), table[ends[1]].to_pylist(), strict=True)]
    return table.filter(pa.array(keep, pa.bool_()))


def _local(ends: tuple[str, str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > LOCAL_EDGES and not whole:
                kept = _kruskal(pa.Table.from_batches(held), ends)
                if kept.num_rows > LOCAL_EDGES // 2:  # hardly smaller: hand it on
                    yield from kept.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = kept.to_batches(), kept.num_rows
        if held:
            yield from _kruskal(pa.Table.from_batches(held), ends).to_batches()

    return run


SCHEMA = "eid long, u long, v long, w {w}, cu long, cv long"


def pointer_jump(parent: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) from (id, parent), where roots are their own parents: parents of parents until nothing changes."""
    p = parent
    for _ in range(max_rounds):
        up = p.select(F.col("id").alias("_i"), F.col("parent").alias("_p"))
        p = cut(p.join(up, F.col("parent") == F.col("_i"), "left").select("id", F.coalesce("_p", "parent").alias("parent"), (F.coalesce("_p", "parent") != F.col("parent")).alias("moved")))
        if p.where("moved").isEmpty():
            return p.select("id", F.col("parent").alias("root"))
        p = p.drop("moved")
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


def minimum_spanning_forest(edges: DataFrame, finish_edges: int = FINISH_EDGES, maximum: bool = False, max_rounds: int = 100) -> DataFrame:
    """(eid, u, v, w) of the unique forest under (w, eid); with `maximum`, under (-w, eid).

    Self loops and rows with a null endpoint, weight or eid are left out. `eid` is to be unique.
    """
    kind = edges.schema["w"].dataType.simpleString()
    sign = -1 if maximum else 1
    e = edges.select(F.col("eid").cast("long"), F.col("u").cast("long"), F.col("v").cast("long"), (F.col("w") * sign).cast(kind).alias("w"))
    e = e.where("u <> v and w is not null and eid is not null").select("*", F.col("u").alias("cu"), F.col("v").alias("cv"))
    schema = SCHEMA.format(w=kind)
    e = cut(e.mapInArrow(_local(("cu", "cv"), False), schema))
    out: list[DataFrame] = []
    for _ in range(max_rounds):
        left = e.count()
        if left <= finish_edges:
            out.append(e.coalesce(1).mapInArrow(_local(("cu", "cv"), True), schema).select("eid", "u", "v", "w") if left else e.select("eid", "u", "v", "w"))
            break
        ends = e.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("o")), F.struct(F.col("cv").alias("c"), F.col("cu").alias("o")))).alias("x"), "w", "eid", "u", "v").select("x.c", "x.o", "w", "eid", "u", "v")
        best = cut(ends.groupBy("c").agg(F.min(F.struct("w", "eid", "o", "u", "v")).alias("b")).select("c", "b.*"))
        out.append(best.select("eid", "u", "v", "w").distinct())
        other = best.select(F.col("c").alias("oc"), F.col("eid").alias("oe"))
        hooked = best.join(other, F.col("o") == F.col("oc"), "left").select(F.col("c").alias("id"), F.when((F.col("oe") == F.col("eid")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("parent"))
        roots = pointer_jump(hooked)
        ru, rv = (roots.select(F.col("id").alias(f"i{x}"), F.col("root").alias(f"r{x}")) for x in "uv")
        moved = e.join(ru, F.col("cu") == F.col("iu"), "left").join(rv, F.col("cv") == F.col("iv"), "left")
        e = moved.select("eid", "u", "v", "w", F.coalesce("ru", "cu").alias("cu"), F.coalesce("rv", "cv").alias("cv")).where("cu <> cv")
        e = cut(e.mapInArrow(_local(("cu", "cv"), False), schema))
    else:
        raise RuntimeError(f"no end within {max_rounds} rounds")
    found = out[0]
    for x in out[1:]:
        found = found.unionAll(x)
    return found.select("eid", "u", "v", (F.col("w") * sign).cast(kind).alias("w"))


def forest_weight(forest: DataFrame) -> DataFrame:
    """One row: total weight and number of edges."""
    return forest.agg(F.sum("w").alias("total_weight"), F.count("*").alias("edges"))


def heaviest_edge(forest: DataFrame) -> DataFrame:
    """One row: the eid and weight of the heaviest edge, the smallest eid among ties."""
    return forest.agg(F.max_by("eid", F.struct("w", -F.col("eid"))).alias("eid"), F.max("w").alias("w"))


def chunk_sizes(m: int, k: int, cpu_share: float = 0.4, cpu_most: int = 100_000_000) -> list[int]:
    """Sizes of k chunks of m edges and of a last one for another kind of worker: m / (k + share) each, and what is left, which is at most `cpu_most`."""
    each = int(m / (k + cpu_share))
    last = min(m - k * each, cpu_most)
    rest = m - last
    return [rest // k + (1 if i < rest % k else 0) for i in range(k)] + [last]


def filter_kruskal(edges: DataFrame, share: float = 0.25, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """The forest by way of its light edges: the forest of the lightest `share` of the edges first; of the others only those between its components go on."""
    from quillgraph.operators.components import star_edges

    pivot = edges.agg(F.percentile_approx("w", share, 10_000).alias("p")).first().p
    if pivot is None:
        return minimum_spanning_forest(edges, finish_edges)
    light = cut(minimum_spanning_forest(edges.where(F.col("w") <= pivot), finish_edges))
    stars = cut(star_edges(light, "u", "v", finish_edges))
    a, b = (stars.select(F.col("u").alias(f"_{x}"), F.col("v").alias(f"_r{x}")) for x in "uv")
    heavy = edges.where(F.col("w") > pivot).join(a, F.col("u") == F.col("_u"), "left").join(b, F.col("v") == F.col("_v"), "left")
    heavy = heavy.where(F.coalesce("_ru", "u") != F.coalesce("_rv", "v")).select("eid", "u", "v", "w")
    return minimum_spanning_forest(light.select("eid", "u", "v", "w").unionAll(heavy), finish_edges)


def hybrid_msf(edges: DataFrame, chunks: int, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """The forest from chunks of edge ids in order, sized by `chunk_sizes`: each chunk's forest is found by itself, the last one's by filtering; then their forest."""
    m = edges.agg(F.max("eid")).first()[0]
    if m is None:
        return minimum_spanning_forest(edges, finish_edges)
    parts, at = [], 0
    for k, n in enumerate(chunk_sizes(m + 1, chunks)):
        part = edges.where((F.col("eid") >= at) & (F.col("eid") < at + n)).select("eid", "u", "v", "w")
        parts.append(cut(filter_kruskal(part, finish_edges=finish_edges) if k == chunks else minimum_spanning_forest(part, finish_edges)))
        at += n
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return minimum_spanning_forest(whole, finish_edges)


def chunked_msf(edges: DataFrame, chunks: int, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """The forest by a fold over `chunks` slices of the edge ids, carrying at most V - 1 edges: F <- MSF(F + chunk)."""
    sized = edges.withColumn("_chunk", F.pmod(F.xxhash64("eid"), F.lit(chunks)))
    state: DataFrame | None = None
    for k in range(chunks):
        part = sized.where(F.col("_chunk") == k).drop("_chunk").select("eid", "u", "v", "w")
        state = cut(minimum_spanning_forest(part if state is None else state.unionAll(part), finish_edges))
    return state


def same_forest(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two forests have equal total weight and cover the same vertices."""
    def ends(x: DataFrame) -> DataFrame:
        return x.select(F.explode(F.array("u", "v")).alias("x")).distinct()

    apart = ends(a).exceptAll(ends(b)).unionAll(ends(b).exceptAll(ends(a))).agg(F.count("*").alias("apart"))
    wa, wb = a.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("wa")), b.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("wb"))
    return wa.join(wb).join(apart).select((F.col("wa") == F.col("wb")).alias("equal_weight"), (F.col("apart") == 0).alias("equal_vertices"))
