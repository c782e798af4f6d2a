"""Near-duplicate vectors by cosine, with an epsilon grid order join.

Distinct unit vectors are turned onto principal axes and sorted by their cells, of width epsilon, on the leading ones (the
epsilon grid order). The sorted sequence is cut into blocks with bounding boxes; block pairs whose boxes are further apart
than epsilon are skipped, and so are, within a pair, intervals of the sequences, which are halved until they are short. What is left is
compared: in single precision with a margin first, then exactly, by cosine in double precision.

Boxes have an axis more, the length of what lies off the leading axes: it differs by no more than the vectors do. A block is sent as single-precision numbers
where these hold its components exactly, as they do for vectors stored that way.

cos >= c means that unit vectors are at most epsilon = sqrt(2 - 2 c) apart. Exact copies are one vector with a count. A pair of blocks
gives a count for each vector and links that connect what all its pairs connect, at most one a vector, so large groups of near
copies never become all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.operators.components import star_edges
from quillgraph.plans.cut import cut

THRESHOLD = 0.9
#: Vectors in a block; in an interval that is compared; leading axes of the order, and of bounding boxes.
BLOCK, LEAF, ORDER_AXES, BOX_AXES = 8192, 256, 8, 32
MARGIN = 1e-4


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow on the way."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _moments(d: int):
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + len(upper[0]))
        for batch in batches:
            if batch.num_rows:
                u = unit(_matrix(batch.column("e"), d))
                total += np.concatenate([[len(u)], u.sum(axis=0), (u.T @ u)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "x"])

    return run


def principal_axes(vectors: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthonormal axes (columns, widest first) of the unit vectors. What is collected has (d + 1)(d + 2) / 2 numbers."""
    rows = vectors.select("e").mapInArrow(_moments(d), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    total = np.array([r.x for r in rows])
    n, mean = total[0], total[1 : d + 1] / total[0]
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = total[d + 1 :] / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, np.linalg.eigh(cov)[1][:, ::-1]


def _ordered(d: int, mean: np.ndarray, axes: np.ndarray, eps: float):
    lead = axes[:, : min(d, ORDER_AXES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor((unit(_matrix(batch.column("e"), d)) - mean) @ lead / eps).astype(np.int64) + (1 << 31)
                keys = cells.astype(">u4")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=[*batch.schema.names, "cells"])

    return run


def boxed(u: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors on the leading axes, and the length of the rest."""
    c = u - mean
    p = c @ axes[:, : min(len(axes), BOX_AXES)]
    rest = np.sqrt(np.maximum((c * c).sum(axis=1) - (p * p).sum(axis=1), 0))
    return np.column_stack([p, rest])


def packed(v: np.ndarray) -> bytes:
    """Little-endian components, in single precision if that loses nothing."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return (short if (short == v).all() else v.astype("<f8")).tobytes()


def unpacked(raw: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * n * d else "<f8").astype(np.float64).reshape(n, d)


def _blocks(d: int, mean: np.ndarray, axes: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = TaskContext.get().partitionId() << 32, []

        def out(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            v = _matrix(rows["e"].chunk(0), d)
            p = boxed(unit(v), mean, axes)
            values = {"block": [k], "uids": [rows["uid"].to_numpy().astype("<i8").tobytes()], "copies": [rows["n"].to_numpy().astype("<i8").tobytes()], "vectors": [packed(v)], "lo": [p.min(axis=0).tolist()], "hi": [p.max(axis=0).tolist()]}
            return pa.RecordBatch.from_pydict(values, schema=BLOCK_SCHEMA)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                rows = pa.Table.from_batches(held)
                while rows.num_rows >= size:
                    yield out(rows.slice(0, size))
                    k, rows = k + 1, rows.slice(size)
                held = rows.to_batches()
        if sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    return run


BLOCK_SCHEMA = pa.schema({"block": pa.int64(), "uids": pa.binary(), "copies": pa.binary(), "vectors": pa.binary(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64())})


def near_blocks(boxes: DataFrame, eps: float) -> DataFrame:
    """(i, j), i <= j: the pairs of blocks whose boxes are at most `eps` apart, by an equi-join on strips of the first axis."""
    at = lambda c: F.floor(F.col(c)[0] / eps).cast("long")
    left = boxes.select(F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), F.explode(F.sequence(at("lo"), at("hi"))).alias("strip"))
    right = boxes.select(F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"), F.explode(F.sequence(at("lo") - 1, at("hi") + 1)).alias("strip"))
    gap = "aggregate(zip_with(zip_with(lo_i, hi_j, (a, b) -> greatest(a - b, 0D)), zip_with(lo_j, hi_i, (a, b) -> greatest(a - b, 0D)), (a, b) -> pow(greatest(a, b), 2)), 0D, (s, x) -> s + x)"
    return left.join(right, "strip").where("i <= j").where(F.expr(gap) <= eps * eps * (1 + 1e-9)).select("i", "j").distinct()


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its component under the links a - b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (up := new[new] != new).any():
            new[up] = new[new[up]]
        if (new == label).all():
            return label
        label = new


class Pair:
    """The links between two blocks, or within one."""

    def __init__(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, mean: np.ndarray, axes: np.ndarray, same: bool) -> None:
        self.a, self.b, self.na, self.nb, self.threshold, self.same = a, b, na, nb, threshold, same
        self.eps2 = (2 - 2 * threshold) * (1 + 1e-9) + 1e-7  # the length of the rest is a difference of squares, exact to about 1e-8
        self.ua, self.ub = unit(a), unit(b)
        self.pa, self.pb = boxed(self.ua, mean, axes), boxed(self.ub, mean, axes)
        self.sa, self.sb = self.ua.astype(np.float32), self.ub.astype(np.float32)
        self.count_a, self.count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.join(0, len(a), 0, len(b))

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:
            return  # the other half
        pa_, pb_ = self.pa[a0:a1], self.pb[b0:b1]
        gap = np.maximum(np.maximum(pa_.min(axis=0) - pb_.max(axis=0), pb_.min(axis=0) - pa_.max(axis=0)), 0)
        if (gap * gap).sum() > self.eps2:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self.compare(a0, a1, b0, b1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            self.join(a0, mid, b0, b1)
            self.join(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            self.join(a0, a1, b0, mid)
            self.join(a0, a1, mid, b1)

    def compare(self, a0: int, a1: int, b0: int, b1: int) -> None:
        i, j = np.nonzero(self.sa[a0:a1] @ self.sb[b0:b1].T >= self.threshold - MARGIN)
        i, j = i + a0, j + b0
        if self.same:
            keep = i < j
            i, j = i[keep], j[keep]
        keep = np.concatenate([(self.ua[i[k : k + 8192]] * self.ub[j[k : k + 8192]]).sum(axis=1) >= self.threshold for k in range(0, len(i), 8192)] or [np.zeros(0, bool)])
        i, j = i[keep], j[keep]
        if len(i):
            self.count_a += np.bincount(i, self.nb[j], len(self.a)).astype(np.int64)
            (self.count_a if self.same else self.count_b)[:] += np.bincount(j, self.na[i], len(self.b)).astype(np.int64)
            self.links.append(self.starred(i, j))

    def starred(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewer links that connect the same: nodes are those of a, then those of b (in one block: the same)."""
        j = j if self.same else j + len(self.a)
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        least = stars(at[: len(i)], at[len(i) :], len(ids))
        keep = least != np.arange(len(ids))
        return ids[keep], ids[least[keep]]

    def all_links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate([x[k] for x in self.links]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = stars(at[: len(a)], at[len(a) :], len(ids))
        keep = least != np.arange(len(ids))
        return ids[keep], ids[least[keep]]


def _compare(d: int, threshold: float, mean: np.ndarray, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                (ua, na), (ub, nb) = ((np.frombuffer(x[f"uids_{s}"], "<i8"), np.frombuffer(x[f"copies_{s}"], "<i8")) for s in "ij")
                a, b = unpacked(x["vectors_i"], len(ua), d), unpacked(x["vectors_j"], len(ub), d)
                same = x["i"] == x["j"]
                pair = Pair(a, b, na, nb, threshold, mean, axes, same)
                uids = ua if same else np.concatenate([ua, ub])
                counts = pair.count_a if same else np.concatenate([pair.count_a, pair.count_b])
                src, dst = pair.all_links()
                some = np.flatnonzero(counts)
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(uids[some]), pa.array(uids[src])]), pa.concat_arrays([none, pa.array(uids[dst])]), pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(src), pa.int64())])], names=["uid", "other", "n"]
                )

    return run


def cosine_links(each: DataFrame, d: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows (uid, null, n), to be summed, for the linked copies of each vector, and (uid, other, null) for links that connect what all links do.

    `each` is (uid, e, n) with distinct vectors of d finite components, not all zero.
    """
    eps = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-7
    mean, axes = principal_axes(each, d)
    keyed = each.select("uid", "e", "n").mapInArrow(_ordered(d, mean, axes, eps), "uid long, e array<double>, n long, cells binary")
    ordered = keyed.repartitionByRange("cells", "uid").sortWithinPartitions("cells", "uid").select("uid", "e", "n")
    blocks = cut(ordered.mapInArrow(_blocks(d, mean, axes, block), "block long, uids binary, copies binary, vectors binary, lo array<double>, hi array<double>"))
    pairs = near_blocks(blocks.select("block", "lo", "hi"), eps)
    left, right = (blocks.select(F.col("block").alias(f"_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("uids", "copies", "vectors"))) for s in "ij")
    joined = pairs.join(left, F.col("i") == F.col("_i")).join(right, F.col("j") == F.col("_j")).drop("_i", "_j")
    return joined.mapInArrow(_compare(d, threshold, mean, axes), "uid long, other long, n long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`.

    Two rows link if the cosine of their vectors, in double precision, is at least `threshold` (in (0, 1)). Null, empty and zero vectors and those with null or
    non-finite components link with nothing, as do vectors of different lengths; such a row is its own component. `component_id` is the
    smallest id reachable (null ids are never smallest; null if there is no other), `kept` whether it is the row's own. Repeated rows link with one another.
    An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    usable = F.coalesce(F.expr("size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"), F.lit(False))
    rows = cut(rows.select("vec_id", F.when(usable, F.col("e")).alias("e")))
    each = rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("uid", F.monotonically_increasing_id())
    each = cut(each)
    found = None
    for (d,) in each.select(F.size("e")).distinct().orderBy(F.size("e")).collect():
        part = cosine_links(each.where(F.size("e") == d), d, threshold, block)
        found = part if found is None else found.unionAll(part)
    if found is None:
        none = F.lit(0).cast("long")
        return rows.select(F.col("vec_id").alias(id_col), none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    star = star_edges(found.where("other is not null"), "uid", "other")
    counts = found.where("n is not null").groupBy("uid").agg(F.sum("n").alias("links"))
    known = each.join(counts, "uid", "left").join(star, F.col("uid") == F.col("u"), "left").select(F.col("e").alias("_e"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("v", "uid").alias("label"))
    known = cut(known)
    smallest = known.groupBy("label").agg(F.min("least").alias("component"))
    known = known.join(smallest, "label").select("_e", "links", "component")
    out = rows.join(known, F.col("e") == F.col("_e"), "left")
    component = F.when(F.col("_e").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Null and unusable ones link with nothing."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
ORACLES = {
    "op9_embedding_dedup": """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r(a, c) as (select vec_id, vec_id from v union select l.a, r.c from r join l on l.b = r.a where r.c < l.a),
c as (select a, min(c) as component from r group by a),
n as (select a, count(*) as links from l group by a)
select v.vec_id, coalesce(links, 0) as n_links, component as component_id, component = v.vec_id as kept from v left join n on n.a = v.vec_id left join c on c.a = v.vec_id"""
}
