"""Queries that write tables as files of the graph formats and read them back, and on keyed tables, and their SQL; `catalog` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog as base
from quillgraph.catalog import on_items, query
from quillgraph.catalog_graphs import SO_SQL, SP_SQL, indexed, supplier_orders, supplier_parts
from quillgraph.catalog_more import POINT_SQL, folder, points


@query("edge_array_file", f"with {SO_SQL} select u as src, v as dst, w::double as w from e")
def edge_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.graphs import read_graph, write_edge_array

    path = folder(spark, "edges")
    write_edge_array(supplier_orders(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), "w"), path)
    return read_graph(spark, path, "edge_array")


def dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The graph of suppliers and parts as (eid, u, v, w), and its vertices' number."""
    e = indexed(supplier_parts(spark, sf_dir))
    return e, e.agg(F.max(F.greatest("u", "v")) + 1).first()[0]


@query("edge_text_file", f"with {SP_SQL} select least(u, v) as src, greatest(u, v) as dst from e")
def edge_text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.graphs import read_graph, write_edge_text

    e, n = dense(spark, sf_dir)
    path = folder(spark, "text")
    write_edge_text(e.select(F.col("u").alias("src"), F.col("v").alias("dst")), n, path)
    return read_graph(spark, path, "edges")


@query("matrix_market_file", f"with {SP_SQL}, b as (select u as a, v as b, w from e union all select v, u, w from e) select row_number() over (order by a, b) - 1 as eid, least(a, b) as u, greatest(a, b) as v, w from b")
def matrix_market_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.graphs import read_graph, write_matrix_market

    e, n = dense(spark, sf_dir)
    path = folder(spark, "mtx")
    write_matrix_market(e, n, path)
    return read_graph(spark, path, "mtx")


@query("generated_weights", f"with {SP_SQL}, n as (select max(greatest(u, v)) + 1 as n from e) select eid, least(u, v) as u, greatest(u, v) as v, cast(((u::hugeint * v) % 4294967296) % n.n + 1 as bigint) as w from e, n")
def generated_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's own weights are set aside for those that are made from the ends."""
    from quillgraph.sources.graphs import read_graph, write_matrix_market

    e, n = dense(spark, sf_dir)
    path = folder(spark, "mtx")
    write_matrix_market(e, n, path, both=False)
    return read_graph(spark, path, "mtx", weight="generated")


@query("csr_file", f"with {base.NATION_SQL} select u as src, v as dst from e")
def csr_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of nations, at most 300 edges, in binary form."""
    from quillgraph.sources.graphs import csr_bytes, read_graph

    path = folder(spark, "csr")
    raw = csr_bytes([(r.u, r.v) for r in base.nations(spark, sf_dir).collect()], 25)
    sc = spark.sparkContext
    file = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/g.bin")
    out = file.getFileSystem(sc._jsc.hadoopConfiguration()).create(file)
    out.write(bytearray(raw))
    out.close()
    return read_graph(spark, f"{path}/g.bin", "csr")


@query("adjacency_file", f"with {SP_SQL} select u as src, v as dst, w::double as w from e")
def adjacency_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.graphs import read_graph, write_adjacency

    e, n = dense(spark, sf_dir)
    path = folder(spark, "adjacency")
    write_adjacency(e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w"), n, path)
    return read_graph(spark, path, "adjacency")


@query("reordered_graph", f"with {SP_SQL}, d as (select u as x from e union all select v from e) select n as degree, count(*) as vertices from (select x, count(*) as n from d group by x) group by n")
def reordered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices a degree, after the vertices were numbered anew and the graph was written and read: as before."""
    from quillgraph.sources.graphs import read_graph, write_adjacency

    e, n = dense(spark, sf_dir)
    path = folder(spark, "reordered")
    write_adjacency(e.select(F.col("u").alias("src"), F.col("v").alias("dst")), n, path, ordered=False)
    ends = read_graph(spark, path, "adjacency").select(F.explode(F.array("src", "dst")).alias("x"))
    return ends.groupBy("x").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("vertices"))


@query("points_file", f"with {POINT_SQL} select row_number() over (order by id) - 1 as idx, x, y, z from p")
def points_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.seq import with_index
    from quillgraph.sources.graphs import read_points, write_points

    path = folder(spark, "points")
    write_points(with_index(points(spark, sf_dir), ["id"]), path)
    return read_points(spark, path)


@query("triangles_file", f"with {POINT_SQL}, i as (select row_number() over (order by id) - 1 as i from p), n as (select count(*) as n from p) select i as tid, i as a, (i + 1) % n as b, (i + 2) % n as c from i, n")
def triangles_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of neighbouring customers, written with their points and read back."""
    from quillgraph.operators.seq import with_index
    from quillgraph.sources.graphs import read_triangles, write_triangles

    p = with_index(points(spark, sf_dir), ["id"])
    n, path = p.count(), folder(spark, "triangles")
    i = F.col("idx")
    write_triangles(p.select("idx", "x", "y", "z"), p.select(i.alias("tid"), i.alias("a"), ((i + 1) % n).alias("b"), ((i + 2) % n).alias("c")), path)
    return read_triangles(spark, path, 3)[1]


@query("chars_file", "select cast(sum(strlen(p_name) + 1) as bigint) as bytes from part")
def chars_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all names, written a line each and read as whole files."""
    from quillgraph.sources.graphs import read_chars, write_chars

    path = folder(spark, "chars")
    write_chars(spark.read.parquet(f"{sf_dir}/part.parquet"), path, "p_name")
    return read_chars(spark, path).agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query("decision_table_file", "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as idx, l_linenumber as c0, cast(l_quantity as int) as c1, ascii(l_returnflag) as label from lineitem")
def decision_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.seq import with_index
    from quillgraph.sources.graphs import read_decision_table

    path = folder(spark, "table")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = with_index(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("idx", F.concat_ws(",", "l_linenumber", F.col("l_quantity").cast("int"), F.ascii("l_returnflag")).alias("value"))
    one = spark.createDataFrame([(-1, "d,i,d")], "idx long, value string")
    one.unionAll(rows).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.text(path)
    return read_decision_table(spark, path)[0]


# --- keyed tables and sequences ------------------------------------------------------------------------------------------

MAP_SQL = "m as (select o_custkey as key, arg_min(o_orderkey, o_orderkey) as value from orders where o_orderkey % 2 = 0 group by 1)"


def first_orders(spark: SparkSession, sf_dir: str):
    """The table of customers' first even orders, and the rows of all orders."""
    from quillgraph.operators import keyed

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("at"))
    return keyed.build(rows.where("value % 2 = 0")), rows


@query("map_insert", f"with {MAP_SQL}, o as (select o_custkey as key, min(o_orderkey) as value from orders group by 1) select o.key, coalesce(m.value, o.value) as value, m.key is null as inserted from o left join m using (key)")
def map_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators import keyed

    table, rows = first_orders(spark, sf_dir)
    return keyed.insert(table, rows)


@query("map_update", "select o_custkey as key, min(o_orderkey) as value from orders group by 1")
def map_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators import keyed

    table, rows = first_orders(spark, sf_dir)
    return keyed.update(table, rows, "min")


@query("map_find", f"with {MAP_SQL} select c_custkey as key, value, value is not null as found from customer left join m on key = c_custkey")
def map_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators import keyed

    return keyed.find(first_orders(spark, sf_dir)[0], spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key")))


@query("map_delete", f"with {MAP_SQL} select key, value from m where key not in (select c_custkey from customer where c_acctbal < 0)")
def map_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators import keyed

    return keyed.delete(first_orders(spark, sf_dir)[0], spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0").select(F.col("c_custkey").alias("key")))


def custom_maximum(s: DataFrame) -> DataFrame:
    """(idx, value, scan): the greatest value * 1000000 + idx so far; the value is what is left without the position, which may have more than six digits."""
    from quillgraph.operators import scan

    both = s.select("idx", (F.col("value") * 1_000_000 + F.col("idx")).alias("value"))
    return scan.custom_scan(both, max, -1, "long", inclusive=True).select("idx", F.expr("(value - idx) div 1000000").alias("value"), "scan")


def _register() -> None:
    from quillgraph.operators import agg, scan, seq, sort

    on_items("seq_scan_product", "select idx, value, case when sum(case when value % 7 = 0 then 1 else 0 end) over w > 0 then 0 else 1 end::double as scan from s window w as (order by idx rows between unbounded preceding and 1 preceding)".replace("sum(case when value % 7 = 0 then 1 else 0 end) over w", "coalesce(sum(case when value % 7 = 0 then 1 else 0 end) over w, 0)"))(lambda s: scan.scan(s.select("idx", F.when(F.col("value") % 7 == 0, 0.0).otherwise(1.0).alias("value")), "product").join(s.select("idx", F.col("value").alias("v")), "idx").select("idx", F.col("v").alias("value"), "scan"))
    on_items("seq_scan_custom", "select idx, value, cast(max(value * 1000000 + idx) over (order by idx) as bigint) as scan from s")(custom_maximum)
    on_items("seq_scan_and", "select idx, value, coalesce(bool_and(value < 50) over (order by idx rows between unbounded preceding and 1 preceding), true) as scan from s")(lambda s: scan.scan(s.select("idx", (F.col("value") < 50).alias("value")), "and").join(s.select("idx", F.col("value").alias("v")), "idx").select("idx", F.col("v").alias("value"), "scan"))
    on_items("seq_scan_bit_or", "select idx, value, coalesce(bit_or(value) over (order by idx rows between unbounded preceding and 1 preceding), 0) as scan from s")(lambda s: scan.scan(s.select("idx", "value"), "bit_or"))
    on_items("seq_scan_bit_and", "select idx, value, coalesce(bit_and(value + 64) over (order by idx rows between unbounded preceding and 1 preceding), -1) as scan from s")(lambda s: scan.scan(s.select("idx", (F.col("value") + 64).alias("value")), "bit_and").select("idx", (F.col("value") - 64).alias("value"), "scan"))
    on_items("seq_iota", "select idx, idx as value from s")(lambda s: seq.iota(s.sparkSession, s.count()))
    on_items("seq_tabulate", "select idx, idx * idx as value from s")(lambda s: seq.tabulate(s.sparkSession, s.count(), "idx * idx"))
    on_items("seq_distinct_integers", "select distinct value from s where value < 40")(lambda s: agg.remove_duplicate_integers(s, 40))
    on_items("seq_scatter_min", "select value as idx, min(idx)::bigint as value from s group by value")(lambda s: s.groupBy("value").agg(F.min("idx").alias("m")).select(F.col("value").alias("idx"), F.col("m").alias("value")))
    on_items("seq_split_two", "select row_number() over (order by key > 3, idx) - 1 as idx, value from s")(lambda s: seq.split_two(s.select("idx", "value", "key"), "key > 3"))
    on_items("seq_resize", "select i as idx, value from range((select count(*) + 1000 from s)) q(i) left join s on s.idx = i")(lambda s: seq.resize(s.select("idx", "value"), s.count() + 1000))
    on_items("seq_insert", "select case when idx < 100 then idx else idx + 2 end as idx, value from s union all select 100, 7 union all select 101, 8")(lambda s: seq.insert(s.select("idx", "value"), 100, s.sparkSession.createDataFrame([(0, 7), (1, 8)], "idx long, value long")))
    on_items("seq_shuffle_is_permutation", "select value, count(*) as n from s group by value")(lambda s: sort.random_shuffle(s.select("idx", "value")).groupBy("value").agg(F.count("*").alias("n")))
    on_items("seq_kth_smallest_approximate", "select true as near from s limit 1")(lambda s: sort.kth_smallest_approximate(s, 12_345).join(sort.kth_smallest(s, 11_000).withColumnRenamed("value", "low")).join(sort.kth_smallest(s, 13_700).withColumnRenamed("value", "high")).select(F.col("value").between(F.col("low"), F.col("high")).alias("near")))


_register()
