"""Graph algorithms as rounds of joins and aggregates. Edges are (src, dst) or (src, dst, w), directed unless said otherwise."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scalar import MIX_PRIME, mix
from quillgraph.operators.components import connected_components
from quillgraph.plans.cut import cut, shared_dir


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Parts that are kept already, as one; none is written again."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def transpose(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def symmetrise(e: DataFrame) -> DataFrame:
    """Both directions of every edge, once, without self loops."""
    return e.select("src", "dst").unionAll(e.select("dst", "src")).where("src <> dst").distinct()


def undirected(e: DataFrame) -> DataFrame:
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def num_vertices(e: DataFrame) -> DataFrame:
    return e.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("n"))


def degrees(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"))


def graph_stats(e: DataFrame) -> DataFrame:
    """One row: edges, vertices with an edge out, largest degree."""
    return degrees(e).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.count("*").alias("vertices"), F.max("degree").alias("max_degree"))


def normalised(e: DataFrame) -> DataFrame:
    """(src, dst, x) with x = 1 / out-degree of src: the column-normalised matrix."""
    return e.join(degrees(e), F.col("src") == F.col("vid")).select("src", "dst", (1.0 / F.col("degree")).alias("x"))


def adjacency(e: DataFrame) -> DataFrame:
    return e.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def edge_map(e: DataFrame, frontier: DataFrame, value, combine, done: list[DataFrame] | None = None) -> DataFrame:
    """(vid, value) of the vertices to which edges lead from `frontier`, but for those in `done`.

    `value` is a Column over the columns of the edge and of the frontier (which has `vid`), `combine` an aggregate function for the values that meet. Whether
    the frontier is sent to the edges or both are shuffled is Spark's choice by its size.
    """
    ends = frontier.withColumnRenamed("vid", "src")
    step = ends.join(e, "src").groupBy(F.col("dst").alias("vid")).agg(combine(value).alias("value"))
    for past in done or []:
        step = step.join(past.select("vid"), "vid", "left_anti")
    return step


def bfs(e: DataFrame, source: int, max_rounds: int = 10_000, undirected: bool = False) -> DataFrame:
    """(vid, level) of the vertices reachable from `source`.

    Levels are kept apart and none is written twice. With `undirected` (edges are there in both directions), a step looks back at two levels only.
    """
    e = cut(e.select("src", "dst").distinct())
    levels = [cut(e.sparkSession.createDataFrame([(source, 0)], "vid long, level long"))]
    for level in range(1, max_rounds):
        step = edge_map(e, levels[-1].select("vid"), F.lit(level).cast("long"), F.min, levels[-2:] if undirected else [union_all(levels)])
        frontier = cut(step.select("vid", F.col("value").alias("level")))
        if frontier.isEmpty():
            return union_all(levels)
        levels.append(frontier)
    raise RuntimeError("too many levels")


def bellman_ford(e: DataFrame, source: int) -> DataFrame | None:
    """(vid, dist) of the vertices reachable from `source`; None if a negative cycle is. Only changed vertices relax their edges."""
    spark = e.sparkSession
    e = cut(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    n = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().count() + 1
    dist = changed = cut(spark.createDataFrame([(source,)], "vid long").withColumn("dist", F.lit(0).cast(e.schema["w"].dataType)))
    for _ in range(n):
        step = changed.join(e, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        both = dist.join(step, "vid", "full").select("vid", F.least("dist", "new").alias("d"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("moved"))
        both = cut(both)
        dist, changed = (both.select("vid", F.col("d").alias("dist")), both.where("moved").select("vid", F.col("d").alias("dist")))
        if changed.isEmpty():
            return dist
    return None


def bucketed_dijkstra(e: DataFrame, source: int, width: int, max_rounds: int = 1_000_000) -> DataFrame:
    """(vid, dist) of the vertices reachable from `source`, for integer weights that are not negative.

    Vertices are settled by buckets of distances `width` wide, nearest first: in a bucket, rounds relax the edges of what changed until nothing does.
    """
    if e.where("w < 0").limit(1).count():
        raise ValueError("a weight is negative")
    e = cut(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    kept = cut(e.sparkSession.createDataFrame([(source,)], "vid long").select("vid", F.lit(0).cast(e.schema["w"].dataType).alias("dist")))
    at, settled = 0, []
    changed = kept
    for _ in range(max_rounds):
        step = edge_map(e, changed, F.col("dist") + F.col("w"), F.min, settled).withColumnRenamed("value", "new")
        both = cut(kept.join(step, "vid", "full").select("vid", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("moved")))
        kept, top = both.select("vid", "dist"), (at + 1) * width
        near, least, n = both.agg(F.count_if(F.col("moved") & (F.col("dist") < top)), F.min(F.when(F.col("dist") >= top, F.col("dist"))), F.count("*")).first()
        if near:
            changed = both.where(F.col("moved") & (F.col("dist") < top)).select("vid", "dist")
            continue
        settled.append(cut(kept.where(F.col("dist") < top)))
        if least is None:
            return union_all(settled)
        at = int(least) // width
        kept = cut(kept.where(F.col("dist") >= top))
        changed = kept.where(F.col("dist") < (at + 1) * width)
    raise RuntimeError("too many rounds")


def pagerank(e: DataFrame, n: int, rounds: int = 10, d: float = 0.85) -> DataFrame:
    """(vid, rank) for vertices 0, ..., n - 1 after so many rounds; vertices without edges out hand nothing on."""
    m = cut(normalised(e.select("src", "dst")))  # few rows a vertex: a round's join sends the ranks to it, or shuffles both
    r = e.sparkSession.range(n).select(F.col("id").alias("vid"), F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        got = r.join(m, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("x")).alias("got"))
        r = cut(r.join(got, F.col("vid") == F.col("to"), "left").select("vid", ((1 - d) / n + d * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return r


def _lists(kind: str):
    """Rows (src, dst), sorted by src, as rows (src, near): a list for each vertex of a batch."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            src, dst = batch.column(0), batch.column(1)
            if not len(src):
                continue
            ends = src.to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(ends[1:] != ends[:-1]) + 1, [len(ends)]])
            yield pa.RecordBatch.from_arrays([src.take(pa.array(first[:-1])), pa.ListArray.from_arrays(pa.array(first, pa.int32()), dst)], ["src", "near"])

    return run, f"src {kind}, near array<{kind}>"


def kcore(e: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(vid, core) of an undirected graph: vertices with fewer than k neighbours left are peeled, for k = 1, 2, ...

    The neighbours' lists are kept once; a round reads those of the vertices it peels and takes them off the others' degrees. Of each round the degrees left and the
    vertices peeled are written to the shared folder, and the degrees of the round before are deleted.
    """
    spark, sc = e.sparkSession, e.sparkSession.sparkContext
    base = f"{shared_dir(spark)}/kcore-{uuid.uuid4()}"
    both = e.select("src", "dst").unionAll(e.select("dst", "src")).where("src <> dst")
    kind = both.schema["src"].dataType.simpleString()
    run, schema = _lists(kind)
    # one shuffle serves the distinct edges and the lists; a vertex has several lists, none longer than a batch
    near = cut(both.repartition("src").distinct().sortWithinPartitions("src").mapInArrow(run, schema))
    degrees = near.groupBy(F.col("src").alias("vid")).agg(F.sum(F.size("near").cast("long")).alias("degree"))
    form, k = f"vid {kind}, degree bigint", 1
    degrees.write.parquet(f"{base}/left-0")
    spark.createDataFrame([], f"vid {kind}, core bigint").write.parquet(f"{base}/core/none")
    for n in range(max_rounds):
        left = spark.read.schema(form).parquet(f"{base}/left-{n}")
        least = left.agg(F.min("degree")).first()[0]
        if least is None:
            break
        k = max(k, least)
        gone = left.where(F.col("degree") <= k)
        gone.select("vid", F.lit(k).cast("long").alias("core")).write.parquet(f"{base}/core/round-{n}")
        lost = near.join(gone.select(F.col("vid").alias("src")), "src", "left_semi").select(F.explode("near").alias("vid")).groupBy("vid").agg(F.count("*").alias("_n"))
        after = left.where(F.col("degree") > k).join(lost, "vid", "left").select("vid", (F.col("degree") - F.coalesce("_n", F.lit(0))).alias("degree"))
        after.write.parquet(f"{base}/left-{n + 1}")
        old = sc._jvm.org.apache.hadoop.fs.Path(f"{base}/left-{n}")
        old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(f"vid {kind}, core bigint").parquet(f"{base}/core/*")


def triangles(e: DataFrame) -> DataFrame:
    """One row: triangles of an undirected graph, and twice as many. Edges point to the larger (degree, id), so hubs stay cheap."""
    u = symmetrise(e)
    deg = u.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("d"))
    a, b = (deg.select(F.col("vid").alias(v), F.col("d").alias(d)) for v, d in (("src", "ds"), ("dst", "dd")))
    up = cut(u.join(a, "src").join(b, "dst").where("(ds, src) < (dd, dst)").select("src", "dst"))
    two = up.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b")
    n = two.join(up.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"]).agg(F.count("*").alias("triangles"))
    return n.select("triangles", (F.col("triangles") * 2).alias("twice"))


def _order(c: str, hashed: bool, *first):
    """By `first`, then by the id, or by its hash before."""
    return F.struct(*first, *([mix(F.col(c))] if hashed else []), F.col(c))


def maximal_independent_set(e: DataFrame, vertices: DataFrame, hashed: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(vid) of the set that a pass over the vertices chooses: each with no chosen neighbour.

    The pass goes in the order of a hash of the ids, for which rounds grow with the logarithm of the vertices, or, if not `hashed`, of the ids.
    """
    u = symmetrise(e)
    left_e = cut(u.withColumn("before", _order("dst", hashed) < _order("src", hashed)))
    left_v = cut(vertices.select("vid").distinct())
    chosen: list[DataFrame] = []
    for _ in range(max_rounds):
        if left_v.isEmpty():
            return union_all(chosen) if chosen else vertices.select("vid").limit(0)
        blocked = left_e.where("before").select(F.col("src").alias("vid")).distinct()
        won = cut(left_v.join(blocked, "vid", "left_anti"))
        out = left_e.join(won, F.col("src") == F.col("vid"), "left_semi").select(F.col("dst").alias("vid")).distinct()
        left_v = cut(left_v.join(won, "vid", "left_anti").join(out, "vid", "left_anti"))
        for c in ("src", "dst"):
            left_e = left_e.join(left_v.select(F.col("vid").alias(c)), c, "left_semi")
        left_e = cut(left_e.select("src", "dst", "before"))
        chosen.append(won)
    raise RuntimeError("too many rounds")


def maximal_matching(e: DataFrame, hashed: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(eid, src, dst) of the matching that a pass over the edges chooses, in the order of a hash of `eid` or, if not `hashed`, of `eid`; self loops are skipped."""
    left = cut(e.select("eid", "src", "dst").where("src <> dst"))
    out: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            return union_all(out) if out else left
        best = left.select("eid", F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.min(_order("eid", hashed))["eid"].alias("best"))
        a, b = (best.select(F.col("v").alias(v), F.col("best").alias(x)) for v, x in (("src", "ba"), ("dst", "bb")))
        won = cut(left.join(a, "src").join(b, "dst").where("eid = ba and eid = bb").select("eid", "src", "dst"))
        used = won.select(F.explode(F.array("src", "dst")).alias("v"))
        left = cut(left.join(used.select(F.col("v").alias("src")), "src", "left_anti").join(used.select(F.col("v").alias("dst")), "dst", "left_anti").select("eid", "src", "dst"))
        out.append(won)
    raise RuntimeError("too many rounds")


def colour(e: DataFrame, vertices: DataFrame, hashed: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(vid, colour): greedily, vertices in order of degree (largest first), then of a hash of the id (or the id, if not `hashed`), the smallest colour no neighbour has.

    A vertex waits for its neighbours that come before it; the edges to these are joined with the colours found in the last round alone.
    """
    u = symmetrise(e)
    deg = u.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("d"))
    v = cut(vertices.select("vid").distinct().join(deg, "vid", "left").select("vid", (-F.coalesce("d", F.lit(0))).alias("p")))
    a, b = (v.select(F.col("vid").alias(x), F.col("p").alias(p)) for x, p in (("src", "ps"), ("dst", "pd")))
    before = u.join(a, "src").join(b, "dst").where(_order("dst", hashed, F.col("pd").alias("p")) < _order("src", hashed, F.col("ps").alias("p"))).select("src", "dst")  # dst is coloured first
    none = F.array().cast("array<long>")
    waits = cut(v.join(before.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("open")), "vid", "left").select("vid", F.coalesce("open", F.lit(0)).alias("open"), none.alias("used")))
    before = cut(before)
    out: list[DataFrame] = []
    for _ in range(max_rounds):
        if waits.isEmpty():
            return union_all(out) if out else v.select("vid", F.lit(0).cast("long").alias("colour")).limit(0)
        free = F.array_min(F.array_except(F.transform(F.sequence(F.lit(0), F.size("used")), lambda x: x.cast("long")), F.col("used")))
        new = cut(waits.where("open = 0").select("vid", free.alias("colour")))
        told = before.join(new.withColumnRenamed("vid", "dst"), "dst").groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("n"), F.collect_set("colour").alias("more"))
        left = waits.where("open > 0").join(told, "vid", "left")
        waits = cut(left.select("vid", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.when(F.col("more").isNull(), F.col("used")).otherwise(F.array_union("used", "more")).alias("used")))
        out.append(new)
    raise RuntimeError("too many rounds")


def betweenness(e: DataFrame, source: int, undirected: bool = False) -> DataFrame:
    """(vid, delta): dependencies of `source` on each vertex it reaches, along shortest paths. Each level's numbers are written once."""
    e = cut(e.select("src", "dst").distinct())
    levels = cut(bfs(e, source, undirected=undirected))
    dag = cut(e.join(levels.select(F.col("vid").alias("src"), F.col("level").alias("ls")), "src").join(levels.select(F.col("vid").alias("dst"), F.col("level").alias("ld")), "dst").where("ld = ls + 1").select("src", "dst", "ls"))
    depth = levels.agg(F.max("level")).first()[0]
    sigma = [cut(levels.where("level = 0").select("vid", F.lit(1.0).alias("sigma")))]
    for k in range(depth):
        step = edge_map(dag.where(F.col("ls") == k), sigma[-1], F.col("sigma"), F.sum)
        sigma.append(cut(step.select("vid", F.col("value").alias("sigma"))))
    last = cut(levels.where(F.col("level") == depth).select("vid", F.lit(0.0).alias("delta")))
    delta = [last]
    for k in range(depth - 1, -1, -1):
        a, b = (s.select(F.col("vid").alias(v), F.col("sigma").alias(c)) for s, v, c in ((sigma[k], "src", "ss"), (sigma[k + 1], "dst", "sd")))
        part = dag.where(F.col("ls") == k).join(last.select(F.col("vid").alias("dst"), "delta"), "dst").join(a, "src").join(b, "dst").groupBy("src").agg(F.sum(F.col("ss") / F.col("sd") * (1 + F.col("delta"))).alias("delta"))
        last = cut(levels.where(F.col("level") == k).join(part, F.col("vid") == F.col("src"), "left").select("vid", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        delta.append(last)
    return union_all(delta).withColumn("delta", F.when(F.col("vid") == source, 0.0).otherwise(F.col("delta")))


def cycle_count(p: DataFrame) -> DataFrame:
    """One row `cycles` of the permutation (idx, value)."""
    labels = connected_components(p, src="idx", dst="value")
    return labels.agg(F.countDistinct("label").alias("cycles"))


def set_cover(sets: DataFrame, epsilon: float = 0.1, max_rounds: int = 100_000) -> DataFrame:
    """(set) of a cover of all elements of (set, element), within (1 + epsilon) ln n of the best.

    In a round the sets that would cover at least 1 / (1 + epsilon) of what the best would compete; an element goes to the smallest of its sets,
    and sets that win enough of theirs are chosen.
    """
    left = cut(sets.select("set", "element").distinct())
    out: DataFrame | None = None
    for _ in range(max_rounds):
        size = left.groupBy("set").agg(F.count("*").alias("n"))
        most = size.agg(F.max("n")).first()[0]
        if not most:
            return out if out is not None else left.select("set")
        bar = most / (1 + epsilon)
        rivals = left.join(size.where(F.col("n") >= bar).select("set"), "set", "left_semi")
        owner = rivals.groupBy("element").agg(F.min("set").alias("set"))
        won = cut(owner.groupBy("set").agg(F.count("*").alias("got")).where(F.col("got") >= bar / (1 + epsilon)).select("set"))
        left = cut(left.join(left.join(won, "set", "left_semi").select("element").distinct(), "element", "left_anti").select("set", "element"))
        out = won if out is None else out.unionAll(won)
    raise RuntimeError("too many rounds")


def low_diameter_decomposition(e: DataFrame, vertices: DataFrame, beta: float = 0.2, seed: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """(vid, centre): vertices start as centres at hashed exponential delays, unless reached before; clusters grow a step a round."""
    e = cut(symmetrise(e))
    u = (mix(F.col("vid"), seed) + 1) / float(MIX_PRIME + 1)
    shifted = vertices.select("vid").distinct().withColumn("s", -F.log(u) / beta)
    top = shifted.agg(F.max("s").alias("top"))
    v = cut(shifted.join(F.broadcast(top)).select("vid", F.floor(F.col("top") - F.col("s")).alias("start")))
    total, found = v.count(), 0
    done: list[DataFrame] = [cut(v.limit(0).select("vid", F.col("vid").alias("centre")))]
    for k in range(max_rounds):
        if found == total:
            return union_all(done)
        reached = edge_map(e, done[-1], F.col("centre"), F.min).select("vid", F.col("value").alias("centre"))
        starts = v.where(F.col("start") == k).select("vid", F.col("vid").alias("centre")).join(reached.select("vid"), "vid", "left_anti")
        new = reached.unionAll(starts).join(union_all(done).select("vid"), "vid", "left_anti")
        done.append(cut(new))
        found += done[-1].count()
        if len(done) > 10:  # few parts to read in a round
            done = [cut(union_all(done[:-1])), done[-1]]
    raise RuntimeError("too many rounds")


def rmat(spark: SparkSession, scale: int, edges: int, a: float = 0.5, b: float = 0.15, c: float = 0.15, seed: int = 0) -> DataFrame:
    """(src, dst) of a recursive-matrix graph on 2 ** scale vertices (scale at most 62): distinct, without self loops."""
    r = spark.range(edges)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(scale):
        u = mix(F.col("id") * 64 + k, seed) / float(MIX_PRIME)
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when((u >= a) & (u < a + b) | (u >= a + b + c), 1).otherwise(0)
    return r.select(src.alias("src"), dst.alias("dst")).where("src <> dst").distinct()


def grid(spark: SparkSession, side: int) -> DataFrame:
    """(src, dst): each cell of a side x side grid and its up to 8 neighbours, both directions."""
    v = spark.range(side * side).select((F.col("id") / side).cast("long").alias("r"), (F.col("id") % side).alias("c"), F.col("id").alias("src"))
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    at = v.withColumn("s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))).select("src", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
    return at.where(f"r >= 0 and c >= 0 and r < {side} and c < {side}").select("src", (F.col("r") * side + F.col("c")).alias("dst"))


def le_lists(e: DataFrame, order: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(vid, root, dist): for each vertex those roots that are nearer to it, along the edges, than all roots before them in the order (vid, ord).

    `ord` is 0, 1, ...; prefixes of the order double. In a prefix all roots step together, and a vertex hands on the first root it was reached from.
    """
    e, order = cut(e.select("src", "dst").distinct()), cut(order.select("vid", "ord"))
    n, r = order.count(), 0
    nearest = cut(order.limit(0).select("vid", F.lit(0).alias("near")))
    lists: DataFrame | None = None
    while r < n:
        frontier = best = cut(order.where((F.col("ord") >= r) & (F.col("ord") < 2 * r + 1)).select("vid", F.col("ord").alias("root")))
        found = frontier.select("vid", "root", F.lit(0).alias("dist"))
        for dist in range(1, max_rounds + 1):
            step = frontier.join(e, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg(F.min("root").alias("root"))
            step = step.join(nearest, "vid", "left").where(F.col("near").isNull() | (F.col("near") > dist))
            step = step.join(best.withColumnRenamed("root", "first"), "vid", "left").where("first is null or root < first")
            frontier = cut(step.select("vid", "root"))
            if frontier.isEmpty():
                break
            found = found.unionAll(frontier.select("vid", "root", F.lit(dist).alias("dist")))
            best = cut(best.unionAll(frontier).groupBy("vid").agg(F.min("root").alias("root")))
        else:
            raise RuntimeError("too many rounds")
        nearest = cut(nearest.unionAll(found.select("vid", F.col("dist").alias("near"))).groupBy("vid").agg(F.min("near").alias("near")))
        lists = found if lists is None else lists.unionAll(found)
        r = 2 * r + 1
    if lists is None:
        return order.select("vid", F.col("vid").alias("root"), F.lit(0).alias("dist"))
    return lists.join(order.select(F.col("vid").alias("by"), F.col("ord").alias("root")), "root").select("vid", F.col("by").alias("root"), "dist")
