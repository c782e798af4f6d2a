"""Queries on points, strings, numbers, generated graphs, files and streams, and their SQL; `catalog` registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog as base
from quillgraph.catalog import query
from quillgraph.functions.scalar import MIX_PRIME, mix_sql
from quillgraph.plans.cut import cut, shared_dir

POINT_SQL = "p as (select c_custkey::bigint as id, (c_custkey * 37 % 211)::double as x, (c_custkey * 61 % 223)::double as y, (c_custkey * 17 % 227)::double as z from customer)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z): customers on an integer lattice."""
    k = F.col("c_custkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), *((k * m % n).cast("double").alias(c) for c, m, n in (("x", 37, 211), ("y", 61, 223), ("z", 17, 227))))


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"


# --- points --------------------------------------------------------------------------------------------------------------

@query("knn", f"""
with {POINT_SQL}, d as (select a.id, b.id as neighbour, row_number() over (partition by a.id order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.id) as k from p a join p b on a.id <> b.id)
select id, 3 - k as pos, neighbour from d where k <= 3""")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest customers of each, furthest first."""
    from quillgraph.operators.numeric import knn as nearest

    p = points(spark, sf_dir).select("id", F.array("x", "y", "z").alias("v"))
    return nearest(p, 3).select("id", F.posexplode("neighbours").alias("pos", "neighbour")).select("id", F.col("pos").cast("long").alias("pos"), "neighbour")


@query("radius_join", f"with {POINT_SQL} select a.id as a, b.id as b from p a join p b on a.id <> b.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 400")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.geometry import radius_pairs

    return radius_pairs(points(spark, sf_dir), 20.0)


@query("box_join", f"""
with {POINT_SQL}, b as (select id, x as x0, x + 1 + id % 5 as x1, y as y0, y + 1 + id % 7 as y1 from p)
select l.id as a, r.id as b from b l join b r on l.id < r.id and l.x0 < r.x1 and r.x0 < l.x1 and l.y0 < r.y1 and r.y0 < l.y1""")
def box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.geometry import box_overlaps

    boxes = points(spark, sf_dir).select("id", F.col("x").alias("x0"), (F.col("x") + 1 + F.col("id") % 5).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 1 + F.col("id") % 7).alias("y1"))
    return box_overlaps(boxes, 8.0)


@query("upper_hull", """
with p as (select c_custkey::bigint as idx, c_custkey::double as x, (c_custkey * 7919 % 10007)::double as y from customer),
l as (select a.idx, min((a.y - b.y) / (a.x - b.x)) as s from p a join p b on b.x < a.x group by a.idx),
r as (select a.idx, max((b.y - a.y) / (b.x - a.x)) as s from p a join p b on b.x > a.x group by a.idx)
select p.idx, p.x, p.y from p left join l using (idx) left join r using (idx) where l.s is null or r.s is null or l.s > r.s""")
def upper_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.geometry import upper_hull as hull

    k = F.col("c_custkey").cast("long")
    return hull(spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("idx"), k.cast("double").alias("x"), (k * 7919 % 10007).cast("double").alias("y")))


def _kmeans_sql(k: int, rounds: int) -> str:
    """Centres drawn one by one, then so many rounds."""
    far = lambda c: f"((x - {c}.x) * (x - {c}.x) + (y - {c}.y) * (y - {c}.y) + (z - {c}.z) * (z - {c}.z))"
    q = f"with {POINT_SQL}, c0 as (select x, y, z from p order by {mix_sql('id')}, id limit 1)"
    for r in range(1, k):
        near = f"least({', '.join(far(f'c{i}') for i in range(r))}, 'infinity'::double)"
        q += f", c{r} as materialized (select p.x, p.y, p.z from p, {', '.join(f'c{i}' for i in range(r))} order by case when {near} > 0 then -ln(({mix_sql('id', r)} + 1) / {MIX_PRIME + 1}.0::double) / {near} else 'infinity'::double end, id limit 1)".replace("(x - ", "(p.x - ").replace("(y - ", "(p.y - ").replace("(z - ", "(p.z - ")
    q += ", r0 as (" + " union all ".join(f"select {i} as c, x, y, z from c{i}" for i in range(k)) + ")"
    for r in range(1, rounds + 1):
        q += f""", a{r} as (select p.x, p.y, p.z, arg_min(o.c, ((p.x - o.x) ** 2 + (p.y - o.y) ** 2 + (p.z - o.z) ** 2, o.c)) as c from p, r{r - 1} o group by p.id, p.x, p.y, p.z),
r{r} as materialized (select o.c, coalesce(avg(a.x), any_value(o.x)) as x, coalesce(avg(a.y), any_value(o.y)) as y, coalesce(avg(a.z), any_value(o.z)) as z from r{r - 1} o left join a{r} a on a.c = o.c group by o.c)"""
    return q + f" select c::bigint as centre, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from r{rounds}"


@query("kmeans", _kmeans_sql(5, 10))
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five centres of the customers."""
    from quillgraph.operators.numeric import kmeans as centres

    found, _ = centres(points(spark, sf_dir).select(F.col("id").alias("idx"), F.array("x", "y", "z").alias("v")), 5, rounds=10)
    return spark.createDataFrame([(k, *(round(x, 6) for x in c)) for k, c in enumerate(found)], "centre long, x double, y double, z double")


@query("mesh_neighbours", """
with t as (select r * 10 + c as v, r, c from range(10) a(r), range(10) b(c)),
m as (select (v * 2)::bigint as tid, v as a, v + 1 as b, v + 10 as c from t where r < 9 and t.c < 9 union all select (v * 2 + 1)::bigint, v + 1, v + 11, v + 10 from t where r < 9 and t.c < 9),
s as (select tid, 0::bigint as side, least(a, b) as p, greatest(a, b) as q from m union all select tid, 1, least(b, c), greatest(b, c) from m union all select tid, 2, least(a, c), greatest(a, c) from m)
select s.tid, s.side, coalesce(o.tid, -1) as neighbour from s left join s o on o.p = s.p and o.q = s.q and o.tid <> s.tid""")
def mesh_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle across each side, on a square cut into triangles."""
    from quillgraph.operators.geometry import triangle_neighbours

    v = spark.range(100).select("id", F.floor(F.col("id") / 10).alias("r"), (F.col("id") % 10).alias("c")).where("r < 9 and c < 9")
    mesh = v.selectExpr("id * 2 as tid", "id as a", "id + 1 as b", "id + 10 as c").unionAll(v.selectExpr("id * 2 + 1", "id + 1", "id + 11", "id + 10"))
    return triangle_neighbours(mesh).select("tid", F.col("side").cast("long").alias("side"), "neighbour")


# --- strings -------------------------------------------------------------------------------------------------------------

SUFFIX_SQL = """t as (select p_partkey::bigint as k, p_name as s from part),
f as (select k, s, i, substr(s, i + 1) as x from (select k, s, unnest(range(length(s))) as i from t)),
a as (select k, s, i, x, row_number() over (partition by k order by x) - 1 as pos from f),
n as (select k, s, i, pos, lead(i) over w as j, x, lead(x) over w as y from a window w as (partition by k order by pos)),
c as (select k, i, j, pos, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda m: substr(x, 1, m) = substr(y, 1, m))) as lcp from n where y is not null)"""


@query("suffix_arrays", f"with {SUFFIX_SQL} select k as partkey, pos, i as start from a")
def suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.functions.text import suffix_array

    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("partkey"), suffix_array("p_name").alias("sa"))
    return p.select("partkey", F.posexplode("sa").alias("pos", "start")).withColumn("pos", F.col("pos").cast("long"))


@query("lcp_arrays", f"with {SUFFIX_SQL} select k as partkey, pos, lcp from c")
def lcp_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.functions.text import lcp_array

    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("partkey"), lcp_array("p_name").alias("l"))
    return p.select("partkey", F.posexplode("l").alias("pos", "lcp")).withColumn("pos", F.col("pos").cast("long"))


@query("longest_repeats", f"with {SUFFIX_SQL}, b as (select k, lcp, least(i, j) as p, greatest(i, j) as q, row_number() over (partition by k order by lcp desc, pos) as o from c) select k as partkey, lcp as len, p as pos1, q as pos2 from b where o = 1")
def longest_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.functions.text import longest_repeat

    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("length(p_name) > 1").select(F.col("p_partkey").cast("long").alias("partkey"), longest_repeat("p_name").alias("r"))
    return p.select("partkey", "r.len", "r.pos1", "r.pos2")


@query("burrows_wheeler", f"""
with {SUFFIX_SQL} select t.k as partkey, right(t.s, 1) || coalesce(string_agg(case when a.i = 0 then '$' else substr(a.s, a.i, 1) end, '' order by a.pos), '') as coded from t left join a on a.k = t.k group by t.k, t.s""")
def burrows_wheeler(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.functions.text import burrows_wheeler as code

    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("partkey"), F.translate(code("p_name"), "\0", "$").alias("coded"))


@query("edit_distances", """
with recursive t as (select p_partkey as k, p_name as a, p_type as b from part),
r(k, i, j, x) as (select k, 0::bigint, j, j from t, range(length(b) + 1) q(j)
 union all select k, i + 1, j, min(y - j) over (partition by k order by j) + j
 from (select r.k, r.i, r.j, case when r.j > 0 and substr(t.a, r.i::int + 1, 1) = substr(t.b, r.j::int, 1) then least(r.x + 1, lag(r.x) over (partition by r.k order by r.j)) else r.x + 1 end as y from r join t using (k) where r.i < length(t.a)))
select k as p_partkey, x as distance from r join t using (k) where i = length(a) and j = length(b)""")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions and deletions between the name and the type of each part."""
    from quillgraph.functions.text import insert_delete_distance

    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", insert_delete_distance("p_name", "p_type").alias("distance"))


@query("token_bounds", """
with f as (select doc_id, unnest(regexp_extract_all(text, '[^ \\f\\n\\r\\t\\x0B]+|[ \\f\\n\\r\\t\\x0B]+')) as x, generate_subscripts(regexp_extract_all(text, '[^ \\f\\n\\r\\t\\x0B]+|[ \\f\\n\\r\\t\\x0B]+'), 1) as k from documents),
c as (select doc_id, x, sum(length(x)) over (partition by doc_id order by k)::bigint as e from f)
select doc_id, e - length(x) as "start", e as "end" from c where trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")
def token_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of all words of all documents."""
    from quillgraph.functions.text import token_bounds as bounds

    b = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(bounds(F.col("text"))).alias("b"))
    return b.select("doc_id", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))


# --- numbers -------------------------------------------------------------------------------------------------------------

@query("integrate", "select round(sum(((i + 0.5::double) * 0.001::double) ** 2) * 0.001::double, 9) as integral from range(1000) r(i)")
def integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.numeric import integrate as midpoint

    return midpoint(spark, "x * x", 0.0, 1.0, 1000).select(F.round("integral", 9).alias("integral"))


@query("fourier", """
with h as (select o_custkey::bigint as key, row_number() over (partition by o_custkey order by o_orderkey, o_totalprice) - 1 as idx, cast(o_totalprice as double) as re, (2 ** ceil(log2(count(*) over (partition by o_custkey))))::bigint as n from orders)
select key, k as idx, round(sum(re * cos(-2 * pi() * ((h.idx * k) % n) / n)), 3) + 0 as re, round(sum(re * sin(-2 * pi() * ((h.idx * k) % n) / n)), 3) + 0 as im from (select *, unnest(range(n)) as k from h) h group by key, k""")
def fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of all orders of each customer, padded with zeros to a power of two.

    A customer's sequence is transformed whole, in one task: splitting it would give another transform.
    """
    from pyspark.sql import Window

    from quillgraph.operators.numeric import fft

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("key"), "o_orderkey", F.col("o_totalprice").cast("double").alias("re"))
    t = o.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("o_orderkey", "re")).cast("long") - 1).select("key", "idx", "re")
    n = t.groupBy("key").agg(F.count("*").alias("n"))
    up = n.select("key", F.explode(F.expr("sequence(n, cast(shiftleft(1L, length(bin(n - 1))) as bigint))")).alias("idx"), "n").where("n > 1 and idx < shiftleft(1L, length(bin(n - 1)))")
    t = t.unionAll(up.select("key", "idx", F.lit(0.0)))
    return fft(t.withColumn("im", F.lit(0.0))).select("key", "idx", *((F.round(c, 3) + 0).alias(c) for c in ("re", "im")))


@query("big_integers", """
with n as (select c_custkey::bigint as k, c_custkey::hugeint * 1000003 * 1000033 * 1009 + 12345 as a, c_custkey::hugeint * 7919 * 104729 as b from customer),
v as (select k, 'add' as op, a + b as x from n union all select k, 'multiply', a * b from n union all select k, 'subtract', a - b from n)
select k, op, i as pos, ((x // (4294967296::hugeint ** 0 * case i when 0 then 1::hugeint when 1 then 4294967296::hugeint when 2 then 18446744073709551616::hugeint else 79228162514264337593543950336::hugeint end)) % 4294967296)::bigint as digit
from v, range(4) r(i) where i = 0 or x >= case i when 1 then 2147483648::hugeint when 2 then 9223372036854775808::hugeint else 39614081257132168796771975168::hugeint end""".replace("4294967296::hugeint ** 0 * ", ""))
def big_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, products and differences of numbers of as many digits as they take."""
    from quillgraph.operators.numeric import big_add, big_digits, big_multiply, big_subtract

    k = F.col("c_custkey").cast("decimal(20,0)")
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"), big_digits(k * 1000003 * 1000033 * 1009 + 12345).alias("a"), big_digits(k * 7919 * 104729).alias("b"))
    ops = {"add": big_add, "multiply": big_multiply, "subtract": big_subtract}
    rows = n.select("k", *(f("a", "b").alias(op) for op, f in ops.items())).select("k", F.explode(F.array(*(F.struct(F.lit(op).alias("op"), F.col(op).alias("d")) for op in ops))).alias("r"))
    return rows.select("k", "r.op", F.posexplode("r.d").alias("pos", "digit")).withColumn("pos", F.col("pos").cast("long"))


# --- graphs --------------------------------------------------------------------------------------------------------------

@query("grid_graph", "select r * 40 + c as src, (r + i) * 40 + c + j as dst from range(40) a(r), range(40) b(c), range(-1, 2) d(i), range(-1, 2) e(j) where (i <> 0 or j <> 0) and r + i between 0 and 39 and c + j between 0 and 39")
def grid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import grid

    return grid(spark, 40)


@query("heaviest_forest_edge", f"with recursive {base.NATION_SQL}{base.MSF_TAIL} select eid, w from f order by w desc, eid limit 1")
def heaviest_forest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.msf import heaviest_edge

    return heaviest_edge(base.msf_nations(spark, sf_dir)).select("eid", "w")


@query("set_cover", """
with n as (select count(distinct l_partkey) as parts from lineitem), m as (select max(k) as k from (select count(distinct l_partkey) as k from lineitem group by l_suppkey))
select parts as covered, true as few, true as chosen_are_sets from n, m""")
def set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of suppliers that together supply every part: how many parts they have, whether they are as few as 1.1 * (1 + ln n) times the least possible allows, and whether all are suppliers."""
    from quillgraph.operators.graph import set_cover as cover

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("element")).distinct()
    chosen = cut(cover(li))
    covered = li.join(chosen, "set").agg(F.countDistinct("element").alias("covered"))
    bound = li.groupBy("set").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest")).join(li.agg(F.countDistinct("element").alias("parts")))
    used = chosen.agg(F.count("*").alias("used"), F.countDistinct("set").alias("sets")).join(chosen.join(li, "set", "left_anti").agg(F.count("*").alias("strange")))
    few = F.col("used") <= F.ceil(F.col("parts") / F.col("largest")) * 1.1 * 1.1 * (1 + F.log("parts"))
    return covered.join(bound).join(used).select("covered", few.alias("few"), ((F.col("strange") == 0) & (F.col("used") == F.col("sets"))).alias("chosen_are_sets"))


# --- files and streams ---------------------------------------------------------------------------------------------------

@query("sequence_file", f"with {base.S_SQL} select idx, value from s")
def sequence_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.graphs import read_sequence, write_sequence

    path = folder(spark, "sequence")
    write_sequence(base.items(spark, sf_dir).select("idx", "value"), path)
    return read_sequence(spark, path)


@query("gap_adjacency_file", f"with {base.NATION_SQL} select u as src, v as dst from e union all select v, u from e")
def gap_adjacency_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.graphs import read_gap_adjacency, write_gap_adjacency

    path = folder(spark, "gaps")
    write_gap_adjacency(base.nations(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst")), 25, path, symmetric=True)
    return read_gap_adjacency(spark, path, symmetric=True)


def stream(edges: DataFrame, fold) -> None:
    """Feeds `edges`, in four files, through the fold."""
    spark, path = edges.sparkSession, folder(edges.sparkSession, "stream")
    edges.repartition(4, F.xxhash64(*edges.columns)).write.parquet(path)
    source = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(path)
    source.writeStream.foreachBatch(fold).option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()


@query("stream_forest", f"with recursive {base.NATION_SQL}{base.MSF_TAIL} select eid, u, v, w from f")
def stream_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.streaming.folds import ForestFold

    fold = ForestFold(spark, folder(spark, "forest"))
    stream(base.nations(spark, sf_dir).select("eid", "u", "v", "w"), fold)
    return fold.state().select("eid", "u", "v", "w")
