"""Reductions, groupings and histograms of sequences; the by-index forms are dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.scan import MONOIDS


def reduce(s: DataFrame, monoid: str = "sum") -> DataFrame:
    """One row `value`; the identity for an empty sequence (null for min and max)."""
    f, identity = MONOIDS[monoid]
    return s.agg(F.coalesce(f("value"), F.lit(identity)).alias("value") if identity is not None else f("value").alias("value"))


def minmax_element(s: DataFrame) -> DataFrame:
    """Positions of the first least and the first largest element."""
    return s.agg(F.min_by("idx", F.struct("value", "idx")).alias("min_pos"), F.max_by("idx", F.struct(F.col("value"), -F.col("idx"))).alias("max_pos"))


def reduce_by_key(df: DataFrame, monoid: str = "sum", key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(MONOIDS[monoid][0]("value").alias("value"))


def group_by_key(df: DataFrame, key: str = "key", order: str | None = "idx") -> DataFrame:
    """(key, items): each key's values, in input order if there is an order column."""
    if order is None:
        return df.groupBy(key).agg(F.collect_list("value").alias("items"))
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]).alias("items"))


def histogram_by_key(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def remove_duplicates(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(column).distinct()


def unique(s: DataFrame) -> DataFrame:
    """Without elements that equal the one before them; positions stay."""
    from quillgraph.operators.seq import _blocked

    n = _blocked(s).select((F.col("idx") + 1).alias("idx"), "next", F.col("next").eqNullSafe(F.struct("value")).alias("_same"))
    return s.join(n.where("_same and next is not null").select("idx"), "idx", "left_anti")


def _dense(df: DataFrame, n: int, key: str, value: Column, empty: Column) -> DataFrame:
    domain = df.sparkSession.range(n).select(F.col("id").alias(key))
    known = df.select(F.when((F.col(key) < 0) | (F.col(key) >= n), F.raise_error(F.concat(F.lit("index out of range: "), F.col(key).cast("string")))).otherwise(F.col(key)).cast("long").alias(key), *[c for c in df.columns if c != key])
    return domain.join(known.groupBy(key).agg(value.alias("_v")), key, "left").select(key, F.coalesce("_v", empty).alias("value"))


def reduce_by_index(df: DataFrame, n: int, monoid: str = "sum", key: str = "key") -> DataFrame:
    """(key, value) for every key in 0, ..., n - 1: the identity where there is none. A key outside is an error."""
    f, identity = MONOIDS[monoid]
    return _dense(df, n, key, f("value"), F.lit(identity))


def histogram_by_index(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    return _dense(df, n, key, F.count("*"), F.lit(0).cast("long"))


def group_by_index(df: DataFrame, n: int, key: str = "key", order: str = "idx") -> DataFrame:
    items = F.transform(F.sort_array(F.collect_list(F.struct(order, "value"))), lambda x: x["value"])
    return _dense(df, n, key, items, F.array().cast(f"array<{df.schema['value'].dataType.simpleString()}>"))


def remove_duplicate_integers(df: DataFrame, most: int) -> DataFrame:
    """The distinct integers of `value` in 0, ..., most - 1, sorted."""
    return df.select("value").where((F.col("value") >= 0) & (F.col("value") < most)).distinct().orderBy("value")


def text_counts(lines: DataFrame, column: str = "text") -> DataFrame:
    """One row: lines, words and bytes of all texts, in one pass."""
    c = F.coalesce(F.col(column), F.lit(""))
    return lines.agg(F.coalesce(F.sum(F.length(c) - F.length(F.replace(c, F.lit("\n")))), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.regexp_count(c, F.lit(r"[^ \f\n\r\t\x0B]+"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias("bytes"))
