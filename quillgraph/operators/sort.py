"""Sorts, selection and permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.seq import with_index


def stable_sort(s: DataFrame, descending: bool = False) -> DataFrame:
    """(idx, value, source): the sorted sequence, equal elements in their old order; `source` is where each was."""
    key = F.col("value").desc() if descending else F.col("value")
    return with_index(s.select(F.col("idx").alias("source"), "value"), [key, "source"]).select("idx", "value", "source")


def counting_sort(df: DataFrame, n: int, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The rows stably ordered by key in 0, ..., n - 1, and (key, offset), where each key's rows begin."""
    from quillgraph.operators.agg import histogram_by_index
    from quillgraph.operators.scan import scan

    placed = with_index(df.withColumnRenamed("idx", "source"), [key, "source"])
    counts = histogram_by_index(df, n, key).select(F.col(key).alias("idx"), "value")
    return placed, scan(counts, "sum").select(F.col("idx").alias(key), F.col("scan").alias("offset"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted sequences as one; of equal elements those of `a` come first."""
    both = a.select("value", F.lit(0).alias("_s"), F.col("idx").alias("_i")).unionAll(b.select("value", F.lit(1), "idx"))
    return with_index(both, ["value", "_s", "_i"]).select("idx", "value")


def kth_smallest(s: DataFrame, k: int, rounds: int = 64) -> DataFrame:
    """One row `value`: the element at position k of the sorted sequence, from 0; no row if there is none.

    A range is narrowed by counting below quantile estimates until few rows are left, which are then sorted; no global sort.
    """
    left, skip = s.select("value"), k
    for _ in range(rounds):
        n = left.count()
        if n <= 100_000:
            break
        share = skip / n
        low, high = left.agg(F.percentile_approx("value", [max(0.0, share - 0.01), min(1.0, share + 0.01)], 1000).alias("q")).first().q
        below, within = left.agg(F.count_if(F.col("value") < low), F.count_if(F.col("value").between(low, high))).first()
        if not below <= skip < below + within or within > n // 2:
            break
        left, skip = left.where(F.col("value").between(low, high)), skip - below
    return left.orderBy("value").offset(skip).limit(1)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """A top-n report."""
    return df.orderBy(*order).limit(n)


def random_shuffle(s: DataFrame, seed: int = 0) -> DataFrame:
    """A permutation that depends on positions and seed alone."""
    return with_index(s.select("value", F.col("idx").alias("_i"), F.xxhash64("idx", F.lit(seed)).alias("_h")), ["_h", "_i"]).select("idx", "value")


def random_permutation(spark, n: int, seed: int = 0) -> DataFrame:
    return random_shuffle(spark.range(n).select(F.col("id").alias("idx"), F.col("id").alias("value")), seed)


def kth_smallest_approximate(s: DataFrame, k: int, accuracy: int = 1000) -> DataFrame:
    """One row `value`: an element whose position in the sorted sequence is within 1 / `accuracy` of all rows of k; no row if there is none."""
    n = s.count()
    if not 0 <= k < n:
        return s.select("value").limit(0)
    return s.agg(F.percentile_approx("value", (k + 0.5) / n, accuracy).alias("value"))
