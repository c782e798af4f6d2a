"""Ordered sequences as DataFrames (idx, value), idx from 0, and the primitives on them.

Predicates and functions are Column expressions over `idx` and `value` (a string or a Column). Every result is ordered by
its own idx, not by the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.plans.cut import cut

BLOCK = 65_536


def _col(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def with_index(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """`df` with the position of each row in the order of `order`, from 0.

    Rows are range-partitioned and numbered within their partition; the partitions' counts, one row each, give the first numbers. No task
    sees all rows.
    """
    ordered = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    kept = cut(ordered)
    local = kept.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    first = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"))
    return local.join(first, F.col("_p") == F.col("_q")).withColumn(name, (F.col("_r") + F.col("_f") - 1).cast("long")).drop("_p", "_q", "_r", "_f")


def tabulate(spark: SparkSession, n: int, f: str | Column) -> DataFrame:
    """f(0), ..., f(n - 1), with `idx` the argument."""
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(None).alias("value")).select("idx", _col(f).alias("value"))


def iota(spark: SparkSession, n: int) -> DataFrame:
    return tabulate(spark, n, "idx")


def from_array(df: DataFrame, column: str) -> DataFrame:
    """The sequence in an array column of a one-row DataFrame."""
    return df.select(F.posexplode(column).alias("idx", "value")).select(F.col("idx").cast("long"), "value")


def map_values(s: DataFrame, f: str | Column) -> DataFrame:
    return s.select("idx", _col(f).alias("value"))


def filter_values(s: DataFrame, p: str | Column) -> DataFrame:
    """The elements with p, at their old positions; `renumber` closes the gaps."""
    return s.where(_col(p))


def remove_if(s: DataFrame, p: str | Column) -> DataFrame:
    return s.where(~F.coalesce(_col(p), F.lit(False)))


def renumber(s: DataFrame) -> DataFrame:
    return with_index(s.select(F.col("idx").alias("_i"), "value"), ["_i"]).select("idx", "value")


def pack(s: DataFrame, flags: DataFrame) -> DataFrame:
    """The elements whose flag (idx, value) is true."""
    f = flags.where("value").select(F.col("idx"))
    return s.join(f, "idx", "left_semi")


def pack_index(flags: DataFrame) -> DataFrame:
    """The positions of true flags, as (idx)."""
    return flags.where("value").select("idx")


def map_maybe(s: DataFrame, f: str | Column) -> DataFrame:
    """f of each element, without nulls."""
    return map_values(s, f).where("value is not null")


def zip_with(a: DataFrame, b: DataFrame, f: str | Column = "struct(a, b)") -> DataFrame:
    """f of the elements `a` and `b` at each position that both have."""
    return a.select("idx", F.col("value").alias("a")).join(b.select("idx", F.col("value").alias("b")), "idx").select("idx", _col(f).alias("value"))


def count_if(s: DataFrame, p: str | Column) -> DataFrame:
    return s.agg(F.count_if(_col(p)).alias("n"))


def quantify(s: DataFrame, p: str | Column) -> DataFrame:
    """One row all_of, any_of, none_of; true, false, true for an empty sequence."""
    any_ = F.coalesce(F.bool_or(_col(p)), F.lit(False))
    return s.agg(F.coalesce(F.bool_and(_col(p)), F.lit(True)).alias("all_of"), any_.alias("any_of"), (~any_).alias("none_of"))


def _first(s: DataFrame, p: Column, end: Column, name: str = "pos") -> DataFrame:
    return s.agg(F.coalesce(F.min(F.when(p, F.col("idx"))), end).alias(name))


def length() -> Column:
    return F.coalesce(F.max("idx") + 1, F.lit(0))


def find_if(s: DataFrame, p: str | Column) -> DataFrame:
    """The first position with p, or the length."""
    return _first(s, _col(p), length())


def find_first_of(s: DataFrame, of: DataFrame) -> DataFrame:
    """The first position whose value is in `of`, or the length."""
    hit = s.join(of.select("value").distinct(), "value", "left_semi").agg(F.min("idx").alias("hit"))
    return s.agg(length().alias("n")).join(hit).select(F.coalesce("hit", "n").alias("pos"))


def _blocked(s: DataFrame) -> DataFrame:
    """`s` with `next`, the value after each: windows run within blocks of positions, and first elements are joined to the blocks before."""
    b = s.withColumn("_b", F.floor(F.col("idx") / BLOCK))
    inner = b.withColumn("_n", F.lead(F.struct("value")).over(Window.partitionBy("_b").orderBy("idx")))
    heads = b.where(F.col("idx") % BLOCK == 0).select((F.col("_b") - 1).alias("_b"), F.struct("value").alias("_h"))
    return inner.join(heads, "_b", "left").select("idx", "value", F.coalesce("_n", "_h").alias("next"))


def adjacent_find(s: DataFrame, p: str | Column = "value = next") -> DataFrame:
    """The first position for which p holds between `value` and `next`, or the length."""
    n = _blocked(s).select("idx", "value", F.col("next").isNotNull().alias("_has"), F.col("next.value").alias("next"))
    return _first(n, F.col("_has") & _col(p), length())


def mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first position at which the two differ, or the shorter length."""
    z = a.select("idx", F.struct("value").alias("a")).join(b.select("idx", F.struct("value").alias("b")), "idx", "full")
    return z.agg(F.coalesce(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("idx"))), length()).alias("pos"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    z = a.select("idx", F.struct("value").alias("a")).join(b.select("idx", F.struct("value").alias("b")), "idx", "full")
    return z.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("equal"))


def lexicographical_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether a comes before b: at the first difference a is smaller, or has ended."""
    z = a.select("idx", F.struct("value").alias("a")).join(b.select("idx", F.struct("value").alias("b")), "idx", "full")
    less = F.when(F.col("a").isNull(), True).when(F.col("b").isNull(), False).otherwise(F.col("a.value") < F.col("b.value"))
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    return z.where(differs).agg(F.coalesce(F.min_by(less, F.col("idx")), F.lit(False)).alias("less"))


def search(s: DataFrame, pattern: DataFrame) -> DataFrame:
    """One row (first, last, n): where `pattern` begins in `s`, or the length for both and 0. An empty pattern is found nowhere."""
    p = pattern.select(F.col("idx").alias("at"), "value")
    m = pattern.agg(F.count("*").alias("m"))
    starts = s.join(p, "value").select((F.col("idx") - F.col("at")).alias("start")).where("start >= 0").groupBy("start").count().join(m).where(F.col("count") == F.col("m"))
    found = starts.agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.count("*").alias("n"))
    return s.agg(length().alias("end")).join(found).select(F.coalesce("lo", "end").alias("first"), F.coalesce("hi", "end").alias("last"), "n")


def is_sorted_until(s: DataFrame) -> DataFrame:
    """One row: the length of the longest sorted prefix, and whether it is all."""
    n = _blocked(s)
    drop = F.min(F.when(F.col("next.value") < F.col("value"), F.col("idx") + 1))
    return n.agg(F.coalesce(drop, length()).alias("until"), drop.isNull().alias("sorted"))


def is_partitioned(s: DataFrame, p: str | Column) -> DataFrame:
    """Whether all elements with p come before all without."""
    return s.agg(F.coalesce(F.max(F.when(_col(p), F.col("idx"))) < F.min(F.when(~_col(p), F.col("idx"))), F.lit(True)).alias("partitioned"))


def _with_length(s: DataFrame) -> DataFrame:
    return s.join(F.broadcast(s.agg(length().alias("_n"))))


def reverse(s: DataFrame) -> DataFrame:
    return _with_length(s).select((F.col("_n") - 1 - F.col("idx")).alias("idx"), "value")


def rotate(s: DataFrame, t: int) -> DataFrame:
    """out[i] = in[(i + t) mod n]."""
    return _with_length(s).select(F.pmod(F.col("idx") - t, F.col("_n")).alias("idx"), "value")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(length().alias("_n"))
    return a.select("idx", "value").unionAll(b.join(F.broadcast(n)).select((F.col("idx") + F.col("_n")).alias("idx"), "value"))


def cut_between(s: DataFrame, begin: int, end: int) -> DataFrame:
    return s.where((F.col("idx") >= begin) & (F.col("idx") < end)).select((F.col("idx") - begin).alias("idx"), "value")


def erase(s: DataFrame, begin: int, end: int) -> DataFrame:
    return s.where((F.col("idx") < begin) | (F.col("idx") >= end)).select(F.when(F.col("idx") < begin, F.col("idx")).otherwise(F.col("idx") - (end - begin)).alias("idx"), "value")


def insert(s: DataFrame, at: int, other: DataFrame) -> DataFrame:
    n = F.broadcast(other.agg(length().alias("_n")))
    moved = s.join(n).select(F.when(F.col("idx") < at, F.col("idx")).otherwise(F.col("idx") + F.col("_n")).alias("idx"), "value")
    return moved.unionAll(other.select((F.col("idx") + at).alias("idx"), "value"))


def flatten(nested: DataFrame) -> DataFrame:
    """(idx, value array) to one sequence, in order."""
    sized = nested.select("idx", F.coalesce(F.size("value"), F.lit(0)).cast("long").alias("value"))
    from quillgraph.operators.scan import scan

    first = scan(sized, "sum").select("idx", F.col("scan").alias("_f"))
    return nested.join(first, "idx").select(F.posexplode("value").alias("_k", "value"), "_f").select((F.col("_f") + F.col("_k")).alias("idx"), "value")


def split_at(s: DataFrame, p: str | Column) -> DataFrame:
    """(piece, items): an element with p ends its piece and is in it; there is a piece more than such elements, empty if one is last."""
    from quillgraph.operators.scan import scan

    flags = s.select("idx", "value", _col(p).cast("long").alias("_f"))
    piece = scan(flags.select("idx", F.col("_f").alias("value")), "sum").select("idx", F.col("scan").alias("piece"))
    items = s.join(piece, "idx").groupBy("piece").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("items"))
    all_ = flags.agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("piece"))
    kind = items.schema["items"].dataType.simpleString()
    return all_.join(items, "piece", "left").select("piece", F.coalesce("items", F.array().cast(kind)).alias("items"))


def gather(s: DataFrame, at: DataFrame) -> DataFrame:
    """s[at[i]] for each i; positions outside are left out."""
    return at.select(F.col("idx").alias("i"), F.col("value").alias("_at")).join(s, F.col("_at") == F.col("idx")).select(F.col("i").alias("idx"), "value")


def scatter(s: DataFrame, to: DataFrame, how: str = "max_by") -> DataFrame:
    """out[to[i]] = s[i]. Of writers to one place the last position wins; with sum, min or max the values are combined."""
    z = s.join(to.select("idx", F.col("value").alias("_to")), "idx")
    agg = F.max_by("value", "idx") if how == "max_by" else getattr(F, how)("value")
    return z.groupBy(F.col("_to").alias("idx")).agg(agg.alias("value"))


def split_two(s: DataFrame, flag: str | Column) -> DataFrame:
    """The elements without `flag` (null counts as without), then those with it, each in order."""
    return with_index(s.withColumn("_flag", F.coalesce(_col(flag), F.lit(False))), ["_flag", "idx"], "_new").select(F.col("_new").alias("idx"), "value")


def resize(s: DataFrame, n: int, value=None) -> DataFrame:
    """The first n elements, followed by `value` (null if not given) as often as it takes."""
    domain = s.sparkSession.range(n).select(F.col("id").alias("idx"))
    known = s.select("idx", "value", F.lit(True).alias("_k"))
    fill = F.lit(value).cast(s.schema["value"].dataType)
    return domain.join(known, "idx", "left").select("idx", F.when(F.col("_k"), F.col("value")).otherwise(fill).alias("value"))
