"""String functions and algorithms on text columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: The six ASCII white-space characters.
SPACE = r"[ \f\n\r\t\x0B]+"


def tokens(c: Column) -> Column:
    """The words between white space, without empty ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda x: x != "")


def token_bounds(c: Column) -> Column:
    """[(start, end), ...] of the words, from 0, end exclusive. A null text has none."""
    chars = F.split(F.coalesce(c, F.lit("")), "")
    word = F.transform(chars, lambda x: (x != "") & ~x.rlike(SPACE))
    before = F.concat(F.array(F.lit(False)), word)
    after = F.concat(F.slice(word, 2, F.greatest(F.size(word) - 1, F.lit(0))), F.array(F.lit(False)))

    def where(edge: Column, shift: int) -> Column:
        at = F.transform(F.arrays_zip(word.alias("w"), edge.alias("e")), lambda x, i: F.when(x["w"] & ~x["e"], i + shift))
        return F.filter(at, lambda i: i.isNotNull())

    return F.arrays_zip(where(F.slice(before, 1, F.size(word)), 0).alias("start"), where(after, 1).alias("end"))


def clean_letters(c: Column) -> Column:
    """ASCII letters in lower case; everything else is a space."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", " "))


def word_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) over all texts, of letters only."""
    return df.select(F.explode(tokens(clean_letters(F.col(column)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def match_positions(c: Column, pattern: str) -> Column:
    """All positions, from 0, at which `pattern` occurs, overlaps included, each once; none for an empty or longer pattern.

    The text is split where the pattern lies ahead, and the pieces' lengths are added up, in one pass over the text.
    """
    none = F.array().cast("array<int>")
    if not pattern:
        return none
    quoted = "\\E\\\\E\\Q".join(pattern.split("\\E"))
    pieces = F.split(c, "(?=\\Q" + quoted + "\\E)", -1)
    starts = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), none, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(x)))
    return F.when(c.startswith(pattern), F.concat(F.array(F.lit(0)), starts)).otherwise(F.coalesce(starts, none))


@F.pandas_udf(LongType())
def insert_delete_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fewest insertions and deletions that turn a into b: no substitutions."""

    def one(x, y):
        if x is None or y is None:
            return None
        if len(x) < len(y):
            x, y = y, x
        v = np.array([ord(c) for c in y])
        row = np.arange(len(v) + 1)
        span = np.arange(len(v) + 1)
        for i, c in enumerate(x, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[1:] + 1, np.where(v == ord(c), row[:-1], row[1:] + 1))
            row = np.minimum.accumulate(new - span) + span  # from the left, one more each
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int64")


def suffix_array_of(text: str) -> np.ndarray:
    """Starts of the suffixes in order of their code points, by doubling of ranks."""
    v = np.array([ord(c) for c in text], np.int64)
    n = len(v)
    if n == 0:
        return v
    rank = np.unique(v, return_inverse=True)[1]
    k = 1
    while True:
        second = np.full(n, -1)
        second[: n - k] = rank[k:] if k < n else []
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        if new.max() == n - 1:
            return order
        rank, k = new, 2 * k


def lcp_of(text: str, sa: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbours in the suffix array."""
    n = len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    out = np.zeros(max(n - 1, 0), np.int64)
    h = 0
    for i in range(n):
        if rank[i] == n - 1:
            h = 0
            continue
        j = sa[rank[i] + 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(h - 1, 0)
    return out


@F.pandas_udf(ArrayType(LongType()))
def suffix_array(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else suffix_array_of(t))


@F.pandas_udf(ArrayType(LongType()))
def lcp_array(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else lcp_of(t, suffix_array_of(t)))


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("len", "pos1", "pos2")]))
def longest_repeat(c: pd.Series) -> pd.DataFrame:
    """Length and two starts of the longest substring that occurs twice; the first such in suffix order."""

    def one(t):
        if not t or len(t) < 2:
            return 0, 0, 0
        sa = suffix_array_of(t)
        lcp = lcp_of(t, sa)
        k = int(lcp.argmax())
        return int(lcp[k]), int(min(sa[k], sa[k + 1])), int(max(sa[k], sa[k + 1]))

    return pd.DataFrame([one(t) for t in c], columns=["len", "pos1", "pos2"])


@F.pandas_udf(StringType())
def burrows_wheeler(c: pd.Series) -> pd.Series:
    """The last column of the sorted rotations of the text with a NUL in front of its end."""

    def one(t):
        if t is None:
            return None
        s = t + "\0"
        sa = suffix_array_of(s)
        return "".join(s[i - 1] for i in sa)

    return c.map(one)
