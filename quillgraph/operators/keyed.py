"""Tables with one value a key: what a hash table or map does one call at a time, for many keys at once, as joins and aggregates.

A table is (key, value). Operations on many keys are taken in the order of `at`, and the first one for a key counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame, order: str = "at") -> DataFrame:
    """The table of (key, value) rows: of rows with one key the first in the order of `order` stays. Null keys are left out."""
    return rows.where("key is not null").groupBy("key").agg(F.min_by("value", F.struct(order, "value")).alias("value"))


def insert(table: DataFrame, rows: DataFrame, order: str = "at") -> DataFrame:
    """(key, value, inserted) of the table after inserts: a present key keeps its value, and `inserted` says which keys are new."""
    both = table.select("key", "value", F.lit(False).alias("inserted")).unionAll(build(rows, order).select("key", "value", F.lit(True)))
    return both.groupBy("key").agg(F.min(F.struct("inserted", "value")).alias("x")).select("key", "x.value", "x.inserted")


def update(table: DataFrame, rows: DataFrame, how: str = "min") -> DataFrame:
    """The table after each row's value was combined with its key's by `how` (min, max or sum); new keys are inserted."""
    f = {"min": F.min, "max": F.max, "sum": F.sum}[how]
    return table.select("key", "value").unionAll(rows.where("key is not null").select("key", "value")).groupBy("key").agg(f("value").alias("value"))


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without those keys; absent ones change nothing."""
    return table.join(keys.select("key").distinct(), "key", "left_anti").select("key", "value")


def find(table: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, found) for each row of `keys`, repeated or null ones, too."""
    t = table.select(F.col("key").alias("_k"), "value", F.lit(True).alias("found"))
    return keys.select("key").join(t, F.col("key") == F.col("_k"), "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def size(table: DataFrame) -> DataFrame:
    """One row `n`."""
    return table.agg(F.count("*").alias("n"))
