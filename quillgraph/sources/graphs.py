"""Readers and writers of graph and sequence files. The format is named by the function, never guessed from an extension."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scalar import generated_weight, hash10_weight, mix

SPACES = r"[ \t]+"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, _at): the lines of the files at `path`, `_at` rising with the files' paths, then with the lines of each. Spark itself reads larger files first."""
    from pyspark.sql import Window

    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = raw.select("_file", "_start").distinct().withColumn("_block", F.row_number().over(Window.orderBy("_file", "_start")).cast("long"))
    # a block is in one partition, whose rows are numbered in the lower 33 bits
    at = F.shiftleft("_block", 33) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return raw.join(F.broadcast(blocks), ["_file", "_start"]).select("value", at.alias("_at"))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split("line", SPACES).alias("f"))


def _int(i: int) -> Column:
    """Leading digits of a field: 3.7 is 3, and what begins with no digit is 0."""
    return F.coalesce(F.regexp_extract(F.get("f", F.lit(i)), r"^(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst), src < dst, of a file with a line `n m` and lines `u v`, 0-based, both directions present. Only one line of each pair is kept: u < v.

    The header is the line of the first two numbers in the file.
    """
    raw = _placed(spark, path)
    head = raw.agg(F.min("_at").alias("_h"))
    rows = raw.join(F.broadcast(head)).where("_at > _h").select(F.trim("value").alias("line")).where("line <> ''")
    return _fields(rows).select(_int(0).alias("src"), _int(1).alias("dst")).where("src < dst")


def read_matrix_market(spark: SparkSession, path: str, normalise: bool = True, weight: str = "file") -> DataFrame:
    """(eid, u, v, w), 0-based, in the order of the file. Lines with % are comments; the first other line is `rows cols nnz`.

    `weight` is file (generated where a line has none), generated or hash10 (whatever a line has; the latter from the second end). With `normalise`, u <= v.
    """
    from quillgraph.operators.seq import with_index

    raw = _placed(spark, path).where("not startswith(value, '%') and trim(value) <> ''")
    head = raw.orderBy("_at").limit(1).select(F.col("_at").alias("_h"), F.split(F.trim("value"), SPACES)[0].cast("long").alias("n"))
    rows = raw.join(F.broadcast(head)).where("_at > _h").select("_at", "n", F.split(F.trim("value"), SPACES).alias("f"))
    rows = rows.select("_at", "n", _int(0).alias("a"), _int(1).alias("b"), F.when(F.size("f") > 2, _int(2)).alias("w"))
    made = generated_weight(F.col("a"), F.col("b"), F.col("n"))
    if weight not in ("file", "generated", "hash10"):
        raise ValueError(f"no such weight: {weight}")
    w = {"generated": made, "hash10": hash10_weight(F.col("b")), "file": F.coalesce("w", made)}[weight]
    u, v = F.col("a") - 1, F.col("b") - 1
    if normalise:
        u, v = F.least(u, v), F.greatest(u, v)
    return with_index(rows.select("_at", u.alias("u"), v.alias("v"), w.alias("w")), ["_at"], "eid").select("eid", "u", "v", "w")


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst), src < dst, of binary files: int64 n and m, n + 1 int64 offsets, m int32 neighbours, little-endian, symmetric.

    A file is one record of Spark's binary reader, so it is to be less than 2 GB; larger graphs are read from several files or as text.
    """

    def rows(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                n, m = np.frombuffer(raw, "<i8", 2)
                offsets = np.frombuffer(raw, "<i8", n + 1, 16)
                dst = np.frombuffer(raw, "<i4", m, 16 + 8 * (n + 1)).astype(np.int64)
                src = np.repeat(np.arange(n), np.diff(offsets))
                keep = src < dst
                for k in range(0, int(keep.sum()), 1_000_000):
                    yield pd.DataFrame({"src": src[keep][k : k + 1_000_000], "dst": dst[keep][k : k + 1_000_000]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "src long, dst long")


def csr_bytes(edges: list[tuple[int, int]], n: int) -> bytes:
    """The binary form of a small symmetric graph."""
    both = sorted({(u, v) for a, b in edges for u, v in ((a, b), (b, a)) if u != v})
    offsets = np.searchsorted([u for u, _ in both], np.arange(n + 1))
    return np.array([n, len(both)], "<i8").tobytes() + offsets.astype("<i8").tobytes() + np.array([v for _, v in both], "<i4").tobytes()


def read_edge_array(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst[, w]) of a file with a header word and lines `u v [w]`."""
    word = _placed(spark, path).orderBy("_at").first()
    kind = word.value.strip() if word else ""
    if kind not in ("EdgeArray", "WeightedEdgeArray"):
        raise ValueError(f"no edge array: {kind!r}")
    rows = _fields(_lines(spark, path).where(f"line <> '{kind}'"))
    cols = [F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst")]
    return rows.select(*cols, *([F.col("f")[2].cast("double").alias("w")] if kind[0] == "W" else []))


def _numbers(spark: SparkSession, path: str, headers: tuple[str, ...]) -> tuple[str, DataFrame]:
    """The header word, and (idx, value) of the tokens after it, in file order."""
    from quillgraph.operators.seq import with_index

    raw = _placed(spark, path).select("_at", F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("_k", "value"))
    first = raw.orderBy("_at", "_k").first()
    kind = first.value if first else ""
    if kind not in headers:
        raise ValueError(f"header {kind!r} is none of {headers}")
    return kind, with_index(raw, ["_at", "_k"]).where("idx > 0").select((F.col("idx") - 1).alias("idx"), "value")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst[, w]) of an adjacency file: header word, n, m, n offsets, m targets[, m weights]."""
    kind, t = _numbers(spark, path, ("AdjacencyGraph", "WeightedAdjacencyGraph"))
    n, m = (int(r.value) for r in t.where("idx < 2").orderBy("idx").collect())
    offsets = t.where((F.col("idx") >= 2) & (F.col("idx") < 2 + n)).select((F.col("idx") - 2).alias("src"), F.col("value").try_cast("long").alias("begin"))
    ends = offsets.select((F.col("src") - 1).alias("src"), F.col("begin").alias("end"))
    spans = offsets.join(ends, "src", "left").select("src", "begin", F.coalesce("end", F.lit(m)).alias("end")).where("begin < end")
    at = spans.select("src", F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
    out = at.join(t.select((F.col("idx") - 2 - n).alias("at"), F.col("value").try_cast("long").alias("dst")), "at")
    if kind[0] == "W":
        out = out.join(t.select((F.col("idx") - 2 - n - m).alias("at"), F.col("value").try_cast("double").alias("w")), "at")
    return out.drop("at")


def read_gap_adjacency(spark: SparkSession, path: str, symmetric: bool = False) -> DataFrame:
    """(src, dst) of a file of numbers: n, m, n degrees, m gaps. A vertex's first neighbour is written as it is, each next one as the distance from the one before.

    With `symmetric`, each edge is in the file in one direction and is returned in both.
    """
    from pyspark.sql import Window

    from quillgraph.operators.scan import scan
    from quillgraph.operators.seq import with_index

    raw = _placed(spark, path).select("_at", F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("_k", "value"))
    t = with_index(raw, ["_at", "_k"]).select("idx", F.col("value").cast("long").alias("value"))
    head = {r.idx: r.value for r in t.where("idx < 2").collect()}
    n, m = head.get(0, 0), head.get(1, 0)
    if t.count() != n + m + 2:
        raise ValueError("the file is to hold n, m, n degrees and m gaps")
    begins = scan(t.where((F.col("idx") >= 2) & (F.col("idx") < 2 + n)).select((F.col("idx") - 2).alias("idx"), "value"))
    at = begins.where("value > 0").select(F.col("idx").alias("src"), F.explode(F.sequence("scan", F.col("scan") + F.col("value") - 1)).alias("at"))
    gaps = at.join(t.where(F.col("idx") >= 2 + n).select((F.col("idx") - 2 - n).alias("at"), "value"), "at")
    out = gaps.select("src", F.sum("value").over(Window.partitionBy("src").orderBy("at")).alias("dst"))
    return out.unionAll(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if symmetric else out


def write_gap_adjacency(e: DataFrame, n: int, path: str, symmetric: bool = False) -> None:
    """The edges (src, dst) among vertices 0, ..., n - 1 as `read_gap_adjacency` reads them, a number a line. With `symmetric`, only those with src < dst."""
    from pyspark.sql import Window

    e = e.select("src", "dst").where("src < dst") if symmetric else e.select("src", "dst")
    gap = F.col("dst") - F.coalesce(F.lag("dst").over(Window.partitionBy("src").orderBy("dst")), F.lit(0))
    degree = e.sparkSession.range(n).select(F.col("id").alias("src")).join(e.groupBy("src").agg(F.count("*").alias("d")), "src", "left").select(F.lit(2).alias("k"), "src", F.lit(0).alias("dst"), F.coalesce("d", F.lit(0)).alias("value"))
    sizes = e.agg(F.count("*").alias("m")).select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(n).cast("long").alias("value")), F.struct(F.lit(1).alias("k"), F.col("m").alias("value")))).alias("s"))
    rows = sizes.select("s.k", F.lit(0).alias("src"), F.lit(0).alias("dst"), "s.value").unionAll(degree).unionAll(e.select(F.lit(3).alias("k"), "src", "dst", gap.alias("value")))
    rows.repartitionByRange("k", "src", "dst").sortWithinPartitions("k", "src", "dst", "value").select(F.col("value").cast("string").alias("value")).write.text(path)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value) of a typed sequence file, whose header word names the type."""
    kinds = {"sequenceInt": "long", "sequenceDouble": "double", "sequenceChar": "string"}
    kind, t = _numbers(spark, path, tuple(kinds))
    return t.select("idx", F.col("value").cast(kinds[kind]).alias("value"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(idx, x, y[, z]) of a points file."""
    kind, t = _numbers(spark, path, ("pbbs_sequencePoint2d", "pbbs_sequencePoint3d"))
    d = int(kind[-2])
    names = "xyz"[:d]
    return t.groupBy(F.floor(F.col("idx") / d).alias("idx")).agg(*(F.max(F.when(F.col("idx") % d == k, F.col("value").cast("double"))).alias(c) for k, c in enumerate(names)))


def write_msf(forest: DataFrame, path: str) -> None:
    """Lines `u v w`, 1-based."""
    forest.select(F.concat_ws(" ", F.col("u") + 1, F.col("v") + 1, F.col("w"))).write.text(path)


def write_sequence(s: DataFrame, path: str, header: str = "sequenceInt") -> None:
    """A header word and a value a line, in order, in one folder of text files."""
    one = s.sparkSession.createDataFrame([(-1, header)], "idx long, value string")
    s.select("idx", F.col("value").cast("string")).unionAll(one).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.text(path)


def write_edge_array(e: DataFrame, path: str) -> None:
    weighted = "w" in e.columns
    one = e.sparkSession.createDataFrame([(0, "WeightedEdgeArray" if weighted else "EdgeArray")], "k int, value string")
    rows = e.select(F.lit(1).alias("k"), F.concat_ws(" ", "src", "dst", *(["w"] if weighted else [])).alias("value"))
    one.unionAll(rows).repartitionByRange("k").sortWithinPartitions("k", "value").select("value").write.text(path)


def write_matrix_market(e: DataFrame, n: int, path: str, both: bool = True) -> None:
    """Edges (u, v, w), 0-based, as Matrix Market lines, 1-based, with each edge in both directions unless `both` is false."""
    e = e.select("u", "v", "w")
    rows = e.unionAll(e.select("v", "u", "w")) if both else e
    head = rows.agg(F.count("*").alias("m")).select(F.explode(F.array(F.struct(F.lit(-2).alias("k"), F.lit("%%MatrixMarket matrix coordinate integer general").alias("value")), F.struct(F.lit(-1).alias("k"), F.concat_ws(" ", F.lit(n), F.lit(n), "m").alias("value")))).alias("h")).select("h.k", F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), "h.value")
    body = rows.select(F.lit(0).alias("k"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.concat_ws(" ", F.col("u") + 1, F.col("v") + 1, "w").alias("value"))
    head.unionAll(body).repartitionByRange("k", "u", "v").sortWithinPartitions("k", "u", "v").select("value").write.text(path)


def write_edge_text(e: DataFrame, n: int, path: str) -> None:
    """Undirected edges (src, dst) as a line `n m` and lines `u v`, 0-based, both directions present."""
    rows = e.select("src", "dst").unionAll(e.select("dst", "src"))
    head = rows.agg(F.count("*").alias("m")).select(F.lit(-1).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.concat_ws(" ", F.lit(n), "m").alias("value"))
    body = rows.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.concat_ws(" ", "src", "dst").alias("value"))
    head.unionAll(body).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").select("value").write.text(path)


def reorder_vertices(e: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The edges (src, dst[, w]) with vertices 0, ..., n - 1 numbered anew, in an order that depends on their numbers and the seed alone."""
    from quillgraph.operators.seq import with_index

    v = e.sparkSession.range(n).select(F.col("id").alias("_v"), mix(F.col("id"), seed).alias("_h"))
    new = with_index(v, ["_h", "_v"], "_n").select("_v", "_n")
    a, b = (new.select(F.col("_v").alias(c), F.col("_n").alias(f"_{c}")) for c in ("src", "dst"))
    return e.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *(c for c in e.columns if c not in ("src", "dst")))


def write_adjacency(e: DataFrame, n: int, path: str, ordered: bool = True, seed: int = 0) -> None:
    """The edges (src, dst[, w]) among vertices 0, ..., n - 1 as `read_adjacency` reads them, a number a line. Unless `ordered`, vertices are numbered anew at random."""
    from quillgraph.operators.scan import scan

    e = e if ordered else reorder_vertices(e, n, seed)
    weighted = "w" in e.columns
    degree = e.sparkSession.range(n).select(F.col("id").alias("idx")).join(e.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("d")), "idx", "left").select("idx", F.coalesce("d", F.lit(0)).alias("value"))
    zero = F.lit(0).cast("long")
    head = e.agg(F.count("*").alias("m")).select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("value")) for k, v in enumerate((F.lit(("Weighted" if weighted else "") + "AdjacencyGraph"), F.lit(n), F.col("m")))))).alias("h")).select("h.k", zero.alias("a"), zero.alias("b"), "h.value")
    rows = head.unionAll(scan(degree).select(F.lit(3), "idx", zero, F.col("scan").cast("string")))
    rows = rows.unionAll(e.select(F.lit(4), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("dst").cast("string")))
    if weighted:
        rows = rows.unionAll(e.select(F.lit(5), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("string")))
    rows.repartitionByRange("k", "a", "b").sortWithinPartitions("k", "a", "b", "value").select("value").write.text(path)


def read_graph(spark: SparkSession, path: str, format: str, **how) -> DataFrame:
    """The graph in a file of the named format: edges, csr, mtx, edge_array, adjacency or gap_adjacency."""
    readers = {"edges": read_edge_text, "csr": read_csr, "mtx": read_matrix_market, "edge_array": read_edge_array, "adjacency": read_adjacency, "gap_adjacency": read_gap_adjacency}
    if format not in readers:
        raise ValueError(f"no such format: {format}")
    return readers[format](spark, path, **how)


def write_points(points: DataFrame, path: str) -> None:
    """(idx, x, y[, z]) as a points file: a header word, then a point a line, in order."""
    names = [c for c in "xyz" if c in points.columns]
    one = points.sparkSession.createDataFrame([(-1, f"pbbs_sequencePoint{len(names)}d")], "idx long, value string")
    body = points.select(F.col("idx").cast("long").alias("idx"), F.concat_ws(" ", *names).alias("value"))
    one.unionAll(body).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.text(path)


def write_triangles(points: DataFrame, triangles: DataFrame, path: str) -> None:
    """Points (idx, x, y[, z]) and triangles (tid, a, b, c) of their numbers as one file: a header word, both counts, the points, then the triangles, numbered from 1."""
    names = [c for c in "xyz" if c in points.columns]
    counts, more = (x.agg(F.count("*").cast("string").alias("value")).select(F.lit(k).alias("k"), F.lit(0).cast("long").alias("i"), "value") for k, x in ((1, points), (2, triangles)))
    one = points.sparkSession.createDataFrame([(0, 0, "pbbs_triangles")], "k int, i long, value string")
    rows = one.unionAll(counts).unionAll(more).unionAll(points.select(F.lit(3), F.col("idx").cast("long"), F.concat_ws(" ", *names)))
    rows = rows.unionAll(triangles.select(F.lit(4), F.col("tid").cast("long"), F.concat_ws(" ", *(F.col(c) + 1 for c in "abc"))))
    rows.repartitionByRange("k", "i").sortWithinPartitions("k", "i").select("value").write.text(path)


def read_triangles(spark: SparkSession, path: str, dims: int = 2) -> tuple[DataFrame, DataFrame]:
    """The points (idx, x, y[, z]) and triangles (tid, a, b, c), of points numbered from 0, of a triangles file."""
    _, t = _numbers(spark, path, ("pbbs_triangles",))
    n, m = (int(r.value) for r in t.where("idx < 2").orderBy("idx").collect())

    def rows(first: int, count: int, width: int, kind: str, names: str, key: str) -> DataFrame:
        at = F.col("idx") - first
        part = t.where((at >= 0) & (at < count * width))
        return part.groupBy(F.floor(at / width).alias(key)).agg(*(F.max(F.when(at % width == k, F.col("value").cast(kind))).alias(c) for k, c in enumerate(names)))

    points = rows(2, n, dims, "double", "xyz"[:dims], "idx")
    found = rows(2 + n * dims, m, 3, "long", "abc", "tid")
    return points, found.select("tid", *((F.col(c) - 1).alias(c) for c in "abc"))


def read_chars(spark: SparkSession, path: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """(path, content): each file's bytes from `begin` up to `end`, a file a row; files of less than 2 GB."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    n = F.octet_length("content") if end is None else F.least(F.octet_length("content"), F.lit(end))
    return raw.select("path", F.substring("content", F.lit(begin + 1), F.greatest(n - begin, F.lit(0))).alias("content"))


def write_chars(lines: DataFrame, path: str, column: str = "text") -> None:
    """A text a line, as plain text files."""
    lines.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_decision_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(idx, c0, ..., label) of a comma-separated table, and the kinds of the columns: its first line has `d` (discrete) or `i` (integer) for each, the label's last."""
    from quillgraph.operators.seq import with_index

    raw = _placed(spark, path).where("trim(value) <> ''")
    head = raw.orderBy("_at").first()
    kinds = [x.strip() for x in head.value.split(",")]
    if any(k not in ("d", "i") for k in kinds):
        raise ValueError(f"the first line is to hold d and i: {head.value!r}")
    names = [*(f"c{i}" for i in range(len(kinds) - 1)), "label"]
    f = raw.where(F.col("_at") > head["_at"]).select("_at", F.split("value", ",").alias("f"))
    rows = f.select("_at", *(F.trim(F.col("f")[i]).cast("int").alias(c) for i, c in enumerate(names)))
    return with_index(rows, ["_at"]).select("idx", *names), kinds


def split_by_position(t: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first `share` of the rows (idx, ...) and the rest."""
    n = t.agg(F.count("*")).first()[0]
    at = int(n * share)
    return t.where(F.col("idx") < at), t.where(F.col("idx") >= at)
