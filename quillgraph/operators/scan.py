"""Prefix scans in two levels, ranks, and what follows from them.

Positions are cut into blocks. Each block is aggregated (map-side first), the few block results are scanned, and every block
is then scanned by itself from there: no window ever holds the whole sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536

#: Aggregate function and value on nothing.
MONOIDS: dict[str, tuple[Callable[[Column], Column], object]] = {
    "sum": (F.sum, 0),
    "product": (F.product, 1.0),
    "max": (F.max, None),
    "min": (F.min, None),
    "and": (F.bool_and, True),
    "or": (F.bool_or, False),
    "bit_and": (F.bit_and, -1),
    "bit_or": (F.bit_or, 0),
    "bit_xor": (F.bit_xor, 0),
}


def scan(s: DataFrame, monoid: str = "sum", inclusive: bool = False, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """`s` with `scan`: the monoid over all earlier elements (and the element itself if inclusive), within groups of `by`.

    On nothing it is the monoid's identity (null for min and max).
    """
    f, identity = MONOIDS[monoid]
    by = by or []
    b = s.withColumn("_b", F.floor(F.col("idx") / block))
    past = (Window.partitionBy(*by) if by else Window).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*by, "_b").agg(f("value").alias("_t")).withColumn("_before", f("_t").over(past))
    totals = totals.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col("_b").alias("_c"), "_before")
    own = f("value").over(Window.partitionBy(*by, "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    on = F.col("_b") == F.col("_c")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = b.withColumn("_own", own).join(totals, on, "left")
    if monoid == "sum":
        both = F.coalesce("_before", F.lit(0)) + F.coalesce("_own", F.lit(0))
    elif monoid == "product":
        both = F.coalesce("_before", F.lit(1.0)) * F.coalesce("_own", F.lit(1.0))
    elif monoid in ("max", "min"):
        both = {"max": F.greatest, "min": F.least}[monoid](F.col("_before"), F.col("_own"))
    elif monoid in ("and", "or"):
        x, y = (F.coalesce(c, F.lit(identity)) for c in ("_before", "_own"))
        both = x & y if monoid == "and" else x | y
    else:
        x, y = (F.coalesce(c, F.lit(identity).cast(s.schema["value"].dataType)) for c in ("_before", "_own"))
        both = {"bit_and": x.bitwiseAND, "bit_or": x.bitwiseOR, "bit_xor": x.bitwiseXOR}[monoid](y)
    return joined.select(*s.columns, both.alias("scan"))


def ordered_reduce(s: DataFrame, combine: Callable, identity, kind: str, block: int = BLOCK):
    """One row `value`: a custom, associative, perhaps non-commutative monoid over the values in order.

    Blocks are reduced where they lie, then the few block results in order.
    """

    def fold(values):
        out = identity
        for v in values:
            out = combine(out, v)
        return out

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"idx": [pdf["idx"].min()], "value": [fold(pdf.sort_values("idx")["value"])]})

    parts = s.withColumn("_b", F.floor(F.col("idx") / block)).groupBy("_b").applyInPandas(reduce_block, f"idx long, value {kind}")
    return parts.groupBy().applyInPandas(reduce_block, f"idx long, value {kind}").select("value")


def custom_scan(s: DataFrame, combine: Callable, identity, kind: str, inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """(idx, value, scan) with a custom, associative, perhaps non-commutative monoid over all earlier elements (and the element itself if inclusive).

    Blocks are reduced where they lie; the block results, one row a block, are scanned in one task; each block is then scanned from there.
    """
    blocked = s.select("idx", "value", F.floor(F.col("idx") / block).alias("_b"))

    def fold(values, out):
        for v in values:
            out = combine(out, v)
        return out

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_b": [pdf["_b"].iloc[0]], "_t": [fold(pdf.sort_values("idx")["value"], identity)]})

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, found = pdf.sort_values("_b"), identity, []
        for t in pdf["_t"]:
            found.append(out)
            out = combine(out, t)
        return pd.DataFrame({"_c": pdf["_b"].to_numpy(), "_before": found})

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found = pdf.sort_values("idx"), []
        out = pdf["_before"].iloc[0]
        for v in pdf["value"]:
            new = combine(out, v)
            found.append(new if inclusive else out)
            out = new
        return pd.DataFrame({"idx": pdf["idx"].to_numpy(), "value": pdf["value"].to_numpy(), "scan": found})

    sums = blocked.groupBy("_b").applyInPandas(totals, f"_b long, _t {kind}").groupBy().applyInPandas(before, f"_c long, _before {kind}")
    joined = blocked.join(sums, F.col("_b") == F.col("_c")).select("idx", "value", "_b", "_before")
    return joined.groupBy("_b").applyInPandas(each, f"idx long, value {s.schema['value'].dataType.simpleString()}, scan {kind}")


def rank(s: DataFrame) -> DataFrame:
    """(idx, rank): the position each element has after a stable sort, from 0; equal elements are ranked in order."""
    from quillgraph.operators.seq import with_index

    return with_index(s.select("idx", "value"), ["value", "idx"], "rank").select("idx", "rank")


def max_contiguous_sum(s: DataFrame) -> DataFrame:
    """One row `mcss`: the largest sum of a run of at least one element (null for none)."""
    upto = scan(s, "sum", inclusive=True).select("idx", F.col("scan").alias("value"))
    lowest = scan(upto.select("idx", "value"), "min").select("idx", F.least(F.coalesce("scan", F.lit(0)), F.lit(0)).alias("low"))
    return upto.join(lowest, "idx").agg(F.max(F.col("value") - F.col("low")).alias("mcss"))
