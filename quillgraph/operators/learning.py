"""Decision trees grown by levels of grouped counts, the lasso on a Gram matrix, and linear programs in the plane."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.cut import cut


@dataclass
class Tree:
    """Nodes from 0, the root. `cut` is -1 for a split by value; `child` maps (node, value or 0/1) to a node. Leaves have feature -1."""

    features: list[str]
    majority: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    child: dict[tuple[int, int], int] = field(default_factory=dict)


def _bits(counts: np.ndarray) -> np.ndarray:
    """Entropy times size, over the last axis."""
    total = counts.sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(counts > 0, -counts * np.log2(counts / total), 0.0).sum(axis=-1)


def _choose(threshold: float, discrete: list[bool]):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["label"].max()) + 1
        labels = np.zeros(n)
        first = pdf[pdf["feature"] == -1]
        np.add.at(labels, first["label"].to_numpy(), first["n"].to_numpy())
        best, at, where = math.inf, -1, -1
        for k, d in enumerate(discrete):
            part = pdf[pdf["feature"] == k]
            m = int(part["value"].max()) + 1
            table = np.zeros((m, n))
            np.add.at(table, (part["value"].to_numpy(), part["label"].to_numpy()), part["n"].to_numpy())
            if d:
                cost, c = float(_bits(table).sum()), -1
            else:
                low = np.cumsum(table, axis=0)[:-1]
                costs = _bits(low) + _bits(labels - low)
                if not len(costs):
                    continue
                c = int(costs.argmin())
                cost, c = float(costs[c]), c + 1
            if cost < best:
                best, at, where = cost, k, c
        if labels.sum() < 2 or (labels > 0).sum() < 2 or float(_bits(labels)) - best < threshold:
            at, where = -1, -1
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "majority": [int(labels.argmax())], "feature": [at], "cut": [where]})

    return one


def c45(df: DataFrame, label: str, discrete: list[str], continuous: list[str]) -> Tree:
    """A tree for small non-negative integers: each node takes the feature (and cut, `value >= cut`) with the least conditional information.

    A node is a leaf if it has one row, one label, or would gain less than log2(features, label included), size-weighted. Ties go to the first
    feature and cut, majorities to the least label. Rows with a null in any of these columns are left out. A level costs one aggregate over all rows;
    what is collected is the tree. An empty table gives a leaf for -1.
    """
    names = discrete + continuous
    rows = cut(df.dropna(subset=[label, *names]).select(F.col(label).cast("int").alias("_y"), *(F.col(c).cast("int").alias(f"_x{i}") for i, c in enumerate(names)), F.lit(0).alias("_n")))
    tree = Tree(names)
    one = _choose(math.log2(len(names) + 1), [True] * len(discrete) + [False] * len(continuous))
    cells = F.array(F.struct(F.lit(-1).alias("feature"), F.lit(0).alias("value")), *(F.struct(F.lit(i).alias("feature"), F.col(f"_x{i}").alias("value")) for i in range(len(names))))
    while True:
        counts = rows.select("_n", "_y", F.explode(cells).alias("c")).groupBy(F.col("_n").alias("node"), "c.feature", "c.value", F.col("_y").alias("label")).agg(F.count("*").alias("n"))
        made = counts.groupBy("node").applyInPandas(one, "node int, majority int, feature int, cut int").orderBy("node").collect()
        if not made and not tree.majority:
            tree.majority, tree.feature, tree.cut = [-1], [-1], [-1]
        for r in made:
            for held in (tree.majority, tree.feature, tree.cut):
                held.extend([-1] * (r.node + 1 - len(held)))
            tree.majority[r.node], tree.feature[r.node], tree.cut[r.node] = r.majority, r.feature, r.cut
        split = [(r.node, r.feature, r.cut) for r in made if r.feature >= 0]
        if not split:
            return tree
        moved = rows.join(F.broadcast(df.sparkSession.createDataFrame(split, "_n int, _f int, _c int")), "_n")
        value = F.get(F.array(*(F.col(f"_x{i}") for i in range(len(names)))), F.col("_f"))
        moved = cut(moved.withColumn("_v", F.when(F.col("_c") < 0, value).otherwise((value >= F.col("_c")).cast("int"))))
        new = [(r._n, r._v) for r in moved.select("_n", "_v").distinct().orderBy("_n", "_v").collect()]
        ids = {key: len(tree.majority) + i for i, key in enumerate(new)}
        tree.child |= ids
        step = df.sparkSession.createDataFrame([(n, v, i) for (n, v), i in ids.items()], "_n int, _v int, _m int")
        rows = cut(moved.join(F.broadcast(step), ["_n", "_v"]).select("_y", *(f"_x{i}" for i in range(len(names))), F.col("_m").alias("_n")))


def classify(df: DataFrame, tree: Tree, name: str = "predicted") -> DataFrame:
    """`df` with the label of the leaf each row comes to; at a value that had no training rows, the node's majority. A null goes to where it is met."""

    @F.pandas_udf("int")
    def walk(*xs: pd.Series) -> pd.Series:
        x = [s.to_numpy(float, na_value=np.nan) for s in xs]
        out = np.zeros(len(x[0]), np.int64)
        todo = [(0, np.arange(len(out)))]
        while todo:
            node, at = todo.pop()
            out[at] = tree.majority[node]
            f, c = tree.feature[node], tree.cut[node]
            if f < 0:
                continue
            v = x[f][at]
            key = v if c < 0 else np.where(np.isnan(v), np.nan, (v >= c).astype(float))
            for k in np.unique(key[~np.isnan(key)]):
                if (node, int(k)) in tree.child and k == int(k):
                    todo.append((tree.child[node, int(k)], at[key == k]))
        return pd.Series(out)

    return df.withColumn(name, walk(*(F.col(c).cast("double") for c in tree.features)))


def _gram(d: int):
    def run(batches):
        total = np.zeros((d + 1, d + 1))
        for pdf in batches:
            if len(pdf):
                a = np.column_stack([np.stack(pdf["v"].to_numpy()), pdf["y"].to_numpy()])
                total += a.T @ a
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    return run


def lasso(df: DataFrame, penalty: float, vector: str = "v", target: str = "y", rounds: int = 10_000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """(weights, objective) that minimise ||A w - y||^2 + penalty |w|_1, by cyclic descent in the order of the columns.

    One pass over the rows adds up the Gram matrix, whose size depends on the number of columns alone. Rows with nulls are left out;
    columns of zeros have weight 0; no rows give no weights.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(target).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"))
    first = rows.select(F.size("v")).first()
    if first is None:
        return np.zeros(0), 0.0
    d = first[0]
    g = np.zeros((d + 1, d + 1))
    for r in rows.mapInPandas(_gram(d), "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        g[r.i, r.j] = r.g
    a, b = g[:d, :d], g[:d, d]
    w = np.zeros(d)
    for _ in range(rounds):
        moved = 0.0
        for j in range(d):
            if a[j, j] <= 0:
                continue
            pull = 2 * (b[j] - a[j] @ w + a[j, j] * w[j])
            new = math.copysign(max(abs(pull) - penalty, 0.0), pull) / (2 * a[j, j])
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            break
    return w, float(w @ a @ w - 2 * w @ b + g[d, d] + penalty * np.abs(w).sum())


def _best(held: list[tuple[float, float, float]], cx: float, cy: float) -> tuple[float, float]:
    """The best point under a few constraints: each pair that holds c from both sides bounds the value, and the least bound is met."""
    side = {s: [h for h in held if np.sign(h[0] * cy - h[1] * cx) == s] for s in (-1.0, 0.0, 1.0)}

    def meet(g, h):
        d = g[0] * h[1] - g[1] * h[0]
        return (h[1] * g[2] - g[1] * h[2]) / d, (g[0] * h[2] - h[0] * g[2]) / d

    points = [meet(g, h) for g in side[-1.0] for h in side[1.0]]
    flat = min(side[0.0], key=lambda h: h[2] / (h[0] * cx + h[1] * cy), default=None)
    p = min(points, key=lambda x: (x[0] * cx + x[1] * cy, x))
    if flat is not None and flat[2] / (flat[0] * cx + flat[1] * cy) * (cx * cx + cy * cy) < p[0] * cx + p[1] * cy:
        p = max((meet(flat, h) for h in side[1.0]), key=lambda x: x[0] * -cy + x[1] * cx) if side[1.0] else p
    return p


def linear_program_2d(constraints: DataFrame, cx: float, cy: float, max_rounds: int = 10_000) -> tuple[float, float]:
    """The point that maximises cx x + cy y under `a x + b y <= c` for rows (a, b, c); (inf, inf) if it is not bounded.

    Constraints that face away from the objective, or hold nulls, are left out. A round finds the constraint that the best point
    so far violates most, by one aggregate, and adds it to the few that are held.
    """
    if cx == 0 and cy == 0:
        raise ValueError("the objective is to have a direction")
    h = cut(constraints.select(*(F.col(c).cast("double").alias(c) for c in "abc")).dropna().where(F.col("a") * cx + F.col("b") * cy > 0))
    turn = F.col("a") * cy - F.col("b") * cx
    row = F.struct("a", "b", "c")
    ends = h.agg(F.min(F.when(turn < 0, row)).alias("l"), F.min(F.when(turn > 0, row)).alias("r")).first()
    if ends.l is None or ends.r is None:
        return math.inf, math.inf
    held = [tuple(ends.l), tuple(ends.r)]
    for _ in range(max_rounds):
        x, y = _best(held, cx, cy)
        size = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2)
        over = (F.col("a") * x + F.col("b") * y - F.col("c")) / size
        worst = h.agg(F.max(F.struct(over.alias("over"), "a", "b", "c")).alias("w")).first().w
        new = (worst.a, worst.b, worst.c)
        if worst.over <= 1e-9 * max(1.0, abs(x), abs(y)) or new in held:
            return x, y
        held.append(new)
    raise RuntimeError("too many rounds")
