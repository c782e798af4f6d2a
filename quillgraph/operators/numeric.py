"""Numeric and small machine-learning algorithms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quillgraph.functions.scalar import MIX_PRIME, mix
from quillgraph.plans.cut import cut


def linefit(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: intercept and slope of the least-squares line."""
    return df.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def primes(spark: SparkSession, n: int) -> DataFrame:
    """(value) of the primes up to n, n included: numbers that no prime up to the root of n divides properly."""
    root = int(n**0.5)
    small = [p for p in range(2, root + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    c = spark.range(2, max(n + 1, 2)).select(F.col("id").alias("value"))
    if not small:
        return c
    multiple = F.exists(F.array(*map(F.lit, small)), lambda p: (F.col("value") % p == 0) & (F.col("value") > p))
    return c.where(~multiple)


def integrate(spark: SparkSession, f: str, a: float, b: float, n: int) -> DataFrame:
    """One row: the midpoint rule for an expression in x."""
    h = (b - a) / n
    x = spark.range(n).select((F.lit(a) + (F.col("id") + 0.5) * h).alias("x"))
    return x.agg((F.sum(F.expr(f)) * h).alias("integral"))


def _digits(v: int, n: int) -> list[int]:
    return [(v >> (32 * i)) & 0xFFFFFFFF for i in range(n)]


def _number(d, signed: bool = True) -> int:
    v = sum(int(x) << (32 * i) for i, x in enumerate(d))
    return v - (1 << (32 * len(d))) if signed and len(d) and int(d[-1]) >> 31 else v


def _big(op):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else op(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(run, ArrayType(LongType()))


def _wide(v: int, n: int) -> list[int]:
    while n > 1 and _number(_digits(v, n - 1)) == v:
        n -= 1
    return _digits(v, n)


#: Digits are 32-bit, least significant first, in two's complement.
big_add = _big(lambda x, y: _wide(_number(x) + _number(y), max(len(x), len(y)) + 1))
big_subtract = _big(lambda x, y: _wide(_number(x) - _number(y), max(len(x), len(y)) + 1))
big_multiply = _big(lambda x, y: _wide(_number(x) * _number(y), len(x) + len(y) + 1))


def big_digits(x: Column, n: int = 4) -> Column:
    """The digits of a whole number, by default as many as any decimal(38, 0) takes."""
    x, base, out = x.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(10,0)"), []
    for _ in range(n):
        low = F.pmod(x, base)
        out.append(low.cast("long"))
        x = ((x - low) / base).cast("decimal(38,0)")
    return F.array(*out)


def fft(s: DataFrame, key: str = "key") -> DataFrame:
    """(key, idx, re, im): for each key's (idx, re, im) the discrete transform with root exp(-2 pi i / n), not normalised.

    A key's sequence is transformed in one task, and its length is to be a power of two.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        if len(pdf) & (len(pdf) - 1):
            raise ValueError("the length is to be a power of two")
        y = np.fft.fft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        return pd.DataFrame({key: pdf[key].to_numpy(), "idx": np.arange(len(y)), "re": y.real, "im": y.imag})

    return s.groupBy(key).applyInPandas(one, f"{key} {s.schema[key].dataType.simpleString()}, idx long, re double, im double")


def kmeans(points: DataFrame, k: int, rounds: int = 50, tolerance: float = 1e-6, id_col: str = "idx", vector: str = "v") -> tuple[list[list[float]], int]:
    """Centres and rounds. The first centre is the point with the least hash; each next one is drawn in proportion to the squared
    distance, by exponential races over hashes, so that it depends on the ids alone. What is collected has k rows."""
    p = cut(points.select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v")))

    def d2(c: list[float]):
        lit = F.array(*map(F.lit, c))
        return F.aggregate(F.zip_with("v", lit, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    centres = [p.orderBy(mix(F.col("i")), "i").first().v]
    for r in range(1, k):
        near = F.least(*(d2(c) for c in centres), F.lit(float("inf")))
        u = (mix(F.col("i"), r) + 1) / float(MIX_PRIME + 1)
        centres.append(p.orderBy(F.when(near > 0, -F.log(u) / near).otherwise(float("inf")), "i").first().v)
    for n in range(1, rounds + 1):
        which = F.array_position(F.array(*(d2(c) for c in centres)), F.array_min(F.array(*(d2(c) for c in centres))))
        dims = range(len(centres[0]))
        rows = p.groupBy(which.alias("c")).agg(*(F.avg(F.col("v")[j]).alias(f"x{j}") for j in dims)).collect()
        new = list(centres)
        for row in rows:
            new[row.c - 1] = [row[f"x{j}"] for j in dims]
        moved = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(centres, new, strict=True))
        centres = new
        if moved <= tolerance**2:
            break
    return centres, n


def transpose(m: DataFrame) -> DataFrame:
    """(row, col, value) with rows and columns exchanged."""
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def knn(points: DataFrame, k: int, id_col: str = "id", vector: str = "v", queries: DataFrame | None = None, axes: int = 3) -> DataFrame:
    """(id, neighbours): each query's k nearest other points by squared distance, furthest first, ties by id, padded with -1.

    A query meets the points of its own and the neighbouring cells of a grid on the first `axes` axes. One whose k-th nearest is no further than a cell is wide is done; the others go
    on with cells twice as wide, until these hold everything. Ids are taken to be unique; of points in one place the k + 1 with the least ids are enough.
    """
    p = points.select(F.col(id_col).cast("long").alias("p"), F.col(vector).cast("array<double>").alias("pv")).where("pv is not null")
    q = (points if queries is None else queries).select(F.col(id_col).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("qv"))
    same = Window.partitionBy("pv").orderBy("p")
    p = cut(p.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r"))
    left = cut(q.where("qv is not null"))
    none = F.array_repeat(F.lit(-1).cast("long"), k)
    n, d = p.agg(F.count("*"), F.max(F.size("pv"))).first()
    found: list[DataFrame] = []
    if n:
        dims = range(min(d, axes))
        both = p.select(F.col("pv").alias("x")).unionAll(left.select("qv"))
        ends = both.agg(*(f(F.col("x")[i]) for f in (F.min, F.max) for i in dims)).first()
        low, extent = ends[: len(dims)], max(b - a for a, b in zip(ends[: len(dims)], ends[len(dims) :], strict=True)) or 1.0
        side = extent / max(1.0, (n / (k + 1)) ** (1 / len(dims)))
        while True:
            at = lambda v: [F.floor((F.col(v)[i] - low[i]) / side).cast("long").alias(f"c{i}") for i in dims]  # noqa: B023, E731
            near = left.select("q", "qv", *at("qv"))
            for i in dims:
                near = near.withColumn(f"c{i}", F.explode(F.array(*(F.col(f"c{i}") + j for j in (-1, 0, 1)))))
            gap = F.aggregate(F.zip_with("qv", "pv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
            met = near.join(p.select("p", "pv", *at("pv")), [f"c{i}" for i in dims]).where("p <> q").select("q", "p", gap.alias("d"))
            best = met.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("d", "p"))).where(F.col("_r") <= k)
            best = best.groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("far"), F.transform(F.sort_array(F.collect_list(F.struct("d", "p")), asc=False), lambda x: x["p"]).alias("ids"))
            tried = cut(left.join(best, "q", "left"))
            sure = F.lit(side > extent) | F.coalesce((F.col("n") == k) & (F.col("far") <= side * side), F.lit(False))
            found.append(tried.where(sure).select("q", F.concat(F.array_repeat(F.lit(-1).cast("long"), (k - F.coalesce("n", F.lit(0))).cast("int")), F.coalesce("ids", F.array().cast("array<long>"))).alias("ids")))
            left = tried.where(~sure).select("q", "qv")
            if side > extent or left.isEmpty():
                break
            side *= 2
    top = found[0] if found else q.select("q", none.alias("ids")).limit(0)
    for x in found[1:]:
        top = top.unionAll(x)
    return q.select("q").join(top, "q", "left").select(F.col("q").alias("id"), F.coalesce("ids", none).alias("neighbours"))
