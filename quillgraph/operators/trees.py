"""The range-minimum index, and trees over sequences, texts and weights as node tables."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quillgraph.functions.text import lcp_of, suffix_array_of
from quillgraph.plans.cut import cut

FAN = 16


def range_min_index(s: DataFrame, fan: int = FAN) -> tuple[DataFrame, int]:
    """(level, node, m) and the number of levels: m is the least (value, idx) among the positions that `fan ** level` divides to node. Nulls are left out."""
    n = (s.agg(F.max("idx")).first()[0] or 0) + 1
    level = cut(s.where("value is not null").select("idx", F.struct("value", "idx").alias("m"), F.col("idx").alias("node")).drop("idx"))
    tree, k = level.select(F.lit(0).alias("level"), "node", "m"), 1
    while n > fan:
        level = cut(level.groupBy(F.expr(f"node div {fan}").alias("node")).agg(F.min("m").alias("m")))
        tree, k, n = tree.unionAll(level.select(F.lit(k).alias("level"), "node", "m")), k + 1, -(-n // fan)
    return tree, k


def _least_table(rank: np.ndarray) -> list[np.ndarray]:
    """Row k has the least of the 2 ** k ranks from each position on."""
    rows = [rank]
    while 2 << len(rows) - 1 <= len(rank):
        half = 1 << len(rows) - 1
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    return rows


def _least_of(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least rank in each range of positions lo, ..., hi; where there is none, as many as there are positions."""
    out = np.full(len(lo), len(table[0]), dtype=table[0].dtype)
    span = hi - lo + 1
    k = np.frexp(np.maximum(span, 1))[1] - 1
    for level in np.unique(k):
        at = np.flatnonzero((k == level) & (span > 0))
        row = table[level]
        out[at] = np.minimum(row[lo[at]], row[hi[at] + 1 - (1 << level)])
    return out


def _ranked(at: np.ndarray, value: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The table of ranks at n positions, of which `at` have values, and the order of the values; of equal ones the first is less."""
    order = np.lexsort((at,)) if not len(at) else np.lexsort((at, pd.factorize(value, sort=True, use_na_sentinel=False)[0]))
    rank = np.full(n, n, dtype=np.int64)
    rank[at[order]] = np.arange(len(order))
    return _least_table(rank), order


def range_min(s: DataFrame, queries: DataFrame, fan: int = FAN) -> DataFrame:
    """(qid, pos, value): for each query (qid, i, j) the first position of the least value among i, ..., j; null where there is none.

    Positions are cut into blocks of fan ** 4, or of the root of the length if that is more. A query goes to the block of i, where the rest of this block and, from the blocks' least
    values (one row a block, which every task has), the blocks between are searched, then to the block of j: two rows a query are shuffled, whatever its length.
    """
    kind, key = s.schema["value"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    n = (s.agg(F.max("idx")).first()[0] or 0) + 1
    block = max(fan**4, 1 << ((n - 1).bit_length() + 1) // 2)
    q = queries.select("qid", F.greatest(F.col("i").cast("long"), F.lit(0)).alias("i"), F.least(F.col("j").cast("long"), F.lit(n - 1)).alias("j"), F.coalesce(F.expr("i <= j"), F.lit(False)).alias("_ok"))
    q = q.withColumn("_ok", F.col("_ok") & (F.col("i") <= F.col("j")))
    values = s.where("value is not null").select(F.col("idx").cast("long").alias("idx"), "value", F.expr(f"idx div {block}").alias("_b"))
    least = values.groupBy("_b").agg(F.min(F.struct("value", "idx")).alias("m")).select("_b", "m.value", "m.idx").toPandas()
    none = q.where("not _ok").select("qid", F.lit(None).cast(f"struct<value:{kind},idx:bigint>").alias("m"))
    if not len(least):
        return queries.select("qid").distinct().select("qid", F.lit(None).cast("long").alias("pos"), F.lit(None).cast(kind).alias("value"))
    tops, tops_at = least["value"].to_numpy(), least["idx"].to_numpy(np.int64)
    above, order = _ranked(least["_b"].to_numpy(np.int64), tops, -(-n // block))
    tops, tops_at = tops[order], tops_at[order]

    def better(value, pos, new, new_pos):
        """The new values, of later positions, where there are any and they are less."""
        less = new < value
        if value.dtype.kind == "f":
            less |= np.isnan(value) & ~np.isnan(new)
        take = (new_pos >= 0) & ((pos < 0) | less)
        return np.where(take, new, value), np.where(take, new_pos, pos)

    def within(y: pd.DataFrame, b: int, lo: np.ndarray, hi: np.ndarray):
        at, value = y["idx"].to_numpy(np.int64), y["value"].to_numpy()
        if not len(at):
            return np.repeat(tops[:1], len(lo)), np.full(len(lo), -1)
        table, order = _ranked(at - b * block, value, block)
        r = _least_of(table, lo, hi)
        found = r < len(order)
        which = order[np.where(found, r, 0)]
        return value[which], np.where(found, at[which], -1)

    def begin(k, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, j, b = x["i"].to_numpy(np.int64), x["j"].to_numpy(np.int64), int(k[0])
        ends = j // block
        value, pos = within(y, b, i - b * block, np.where(ends > b, block - 1, -1))
        r = _least_of(above, np.full(len(j), b + 1).clip(max=len(above[0]) - 1), np.where(ends > b + 1, ends - 1, -1))
        found = r < len(tops)
        which = np.where(found, r, 0)
        value, pos = better(value, pos, tops[which], np.where(found, tops_at[which], -1))
        return pd.DataFrame({"qid": x["qid"].to_numpy(), "i": i, "j": j, "value": value, "pos": pos})

    def end(k, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        b = int(k[0])
        value, pos = within(y, b, np.maximum(x["i"].to_numpy(np.int64) - b * block, 0), x["j"].to_numpy(np.int64) - b * block)
        value, pos = better(x["value"].to_numpy(), x["pos"].to_numpy(np.int64), value, pos)
        return pd.DataFrame({"qid": x["qid"].to_numpy(), "value": value, "pos": pos})

    # a block that many queries begin or end in is searched in several groups
    ok = q.where("_ok").drop("_ok")
    ends = ok.select(F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.expr(f"{e} div {block}").alias("_b")) for e in "ij"))).alias("x")).groupBy("x.e", "x._b").agg(F.ceil(F.count("*") / (4 * block)).alias("_n"))
    ends = cut(ends)

    def pass_(x: DataFrame, e: str, f, schema: str) -> DataFrame:
        many = F.broadcast(ends.where(F.col("e") == e).select("_b", "_n"))
        x = x.withColumn("_b", F.expr(f"{e} div {block}")).join(many, "_b").withColumn("_s", F.pmod(F.xxhash64("qid", "i", "j"), F.col("_n"))).drop("_n")
        y = values.join(many, "_b").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
        meet = lambda k, x, y: f(k, x, y) if len(x) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return x.groupBy("_b", "_s").cogroup(y.groupBy("_b", "_s")).applyInPandas(meet, schema)

    half = pass_(ok, "i", begin, f"qid {key}, i long, j long, value {kind}, pos long")
    found = pass_(half, "j", end, f"qid {key}, value {kind}, pos long").select("qid", F.when(F.col("pos") >= 0, F.struct("value", F.col("pos").alias("idx"))).alias("m"))
    return found.unionAll(none).groupBy("qid").agg(F.min("m").alias("m")).select("qid", F.col("m.idx").alias("pos"), F.col("m.value").alias("value"))


def cartesian_parents(v: np.ndarray) -> np.ndarray:
    """Each position's parent in the tree whose root is the least value; of equal values the first is above. The root is its own parent."""
    parent = np.arange(len(v))
    spine: list[int] = []
    for i in range(len(v)):
        last = -1
        while spine and v[spine[-1]] > v[i]:
            last = spine.pop()
        if last >= 0:
            parent[last] = i
        if spine:
            parent[i] = spine[-1]
        spine.append(i)
    return parent


@F.pandas_udf(ArrayType(LongType()))
def cartesian_tree(c: pd.Series) -> pd.Series:
    """The parents for an array column without null elements; a null array gives null."""
    return c.map(lambda v: None if v is None else cartesian_parents(np.asarray(v)))


def radix_nodes(lcp: np.ndarray, leaves: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, parent, depth, string) of the tree of sorted strings with these common prefixes of neighbours.

    A leaf for string s is node 2 s; branches are odd, numbered as they are closed from left to right. The root is its own parent.
    """
    out: list[tuple[int, int, int, int]] = []
    branches = 0
    stack: list[tuple[int, list[tuple[int, int, int]], int]] = [(0, [], int(leaves[0]) if len(leaves) else 0)]  # depth, closed children, a string
    for k in range(len(leaves)):
        item = (2 * int(leaves[k]), int(lengths[k]), int(leaves[k]))
        d = int(lcp[k]) if k < len(lcp) else 0
        if d > stack[-1][0]:
            stack.append((d, [], item[2]))
        stack[-1][1].append(item)
        while d < stack[-1][0]:
            depth, children, string = stack.pop()
            node = 2 * branches + 1
            branches += 1
            out.extend((c, node, cd, cs) for c, cd, cs in children)
            if d > stack[-1][0]:
                stack.append((d, [], string))
            stack[-1][1].append((node, depth, string))
    _, children, string = stack[0]
    root = 2 * branches + 1
    out.extend((c, root, cd, cs) for c, cd, cs in children)
    out.append((root, root, 0, string))
    return out


@F.pandas_udf(ArrayType(StructType([StructField(c, LongType()) for c in ("node", "parent", "depth", "start")])))
def suffix_tree(c: pd.Series) -> pd.Series:
    """The nodes of a text's suffix tree. A suffix that begins another one is a leaf beside it, below the same branch. An empty text has a root alone."""

    def one(t):
        if t is None:
            return None
        sa = suffix_array_of(t)
        nodes = radix_nodes(lcp_of(t, sa), sa, len(t) - sa)
        return [dict(zip(("node", "parent", "depth", "start"), x, strict=True)) for x in nodes]

    return c.map(one)


def find_in_tree(text: str, node: np.ndarray, parent: np.ndarray, depth: np.ndarray, start: np.ndarray, pattern: str) -> tuple[int, int | None, int] | None:
    """The highest node whose text begins with `pattern`, the first of the leaves below it and how many they are; None if no suffix begins so.

    A leaf's start is an occurrence, overlaps included. All leaves are below the root, which the empty pattern finds; an empty text has none (start None).
    """
    below: dict[int, list[int]] = {}
    root = 0
    for k, (n, up) in enumerate(zip(node.tolist(), parent.tolist(), strict=True)):
        if n == up:
            root = k
        else:
            below.setdefault(up, []).append(k)
    at, known = root, 0
    while known < len(pattern):
        # a leaf that ends where its branch does has no next character
        at = next((k for k in below.get(int(node[at]), []) if depth[k] > known and text[start[k] + known] == pattern[known]), -1)
        end = min(int(depth[at]), len(pattern))
        if at < 0 or text[start[at] + known : start[at] + end] != pattern[known:end]:
            return None
        known = end
    leaves, rest = [], [at]
    while rest:
        k = rest.pop()
        if node[k] % 2 == 0:
            leaves.append(int(start[k]))
        rest.extend(below.get(int(node[k]), []))
    return int(node[at]), min(leaves, default=None), len(leaves)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("node", "start", "n")]))
def _find(text: pd.Series, node: pd.Series, parent: pd.Series, depth: pd.Series, start: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    rows = zip(text, node, parent, depth, start, pattern, strict=True)
    found = [None if any(x is None for x in r) else find_in_tree(r[0], *(np.asarray(x, np.int64) for x in r[1:5]), r[5]) for r in rows]
    return pd.DataFrame([x or (None, None, None) for x in found], columns=["node", "start", "n"]).astype("Int64")


def suffix_tree_find(text: Column, nodes: Column, pattern: Column) -> Column:
    """(node, start, n) of `pattern` in a text whose `nodes` come from `suffix_tree`: its node, first position, and how often it occurs.

    The fields are null where it doesn't occur or an argument is null. The empty pattern is at the root, and at every position.
    """
    return _find(text, *(nodes.getField(c) for c in ("node", "parent", "depth", "start")), pattern)


def huffman_tree(weights: DataFrame, max_symbols: int = 1 << 20) -> DataFrame:
    """(node, parent, weight, symbol, depth) for (symbol, weight): leaves first, in order of weight, then symbol; the root's parent is itself.

    Of equal weights the older node is merged first, so that the tree is fixed. An alphabet of more than `max_symbols` is an error; equal
    symbols are added up, null weights count 0.
    """
    spark, kind = weights.sparkSession, weights.schema["symbol"].dataType.simpleString()
    rows = weights.groupBy("symbol").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("weight")).orderBy("weight", "symbol").limit(max_symbols + 1).collect()
    if len(rows) > max_symbols:
        raise ValueError("too many symbols")
    schema = f"node long, parent long, weight double, symbol {kind}, depth long"
    if not rows:
        return spark.createDataFrame([], schema)
    weight = [r.weight for r in rows]
    heap = [(w, i) for i, w in enumerate(weight)]
    parent = list(range(len(rows)))
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        new = len(weight)
        weight.append(a + b)
        parent[i] = parent[j] = new
        parent.append(new)
        heapq.heappush(heap, (a + b, new))
    depth = [0] * len(weight)
    for i in range(len(weight) - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return spark.createDataFrame([(i, parent[i], weight[i], rows[i].symbol if i < len(rows) else None, depth[i]) for i in range(len(weight))], schema)
