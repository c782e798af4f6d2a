"""Queries on graphs of all line items and all orders, and their SQL; `catalog` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog as base
from quillgraph.catalog import query
from quillgraph.catalog_more import folder, stream
from quillgraph.functions.scalar import MIX_PRIME, mix, mix_sql

# --- graphs: vertices of two kinds have even and odd numbers, weights are in cents ---------------------------------------


def _bipartite_sql(key: str) -> str:
    return f"g as (select 2 * l_suppkey as u, 2 * {key} + 1 as v, min(cast(round(l_extendedprice * 100) as bigint)) as w from lineitem group by 1, 2), e as (select row_number() over (order by u, v) - 1 as eid, u, v, w from g)"


SO_SQL, SP_SQL = _bipartite_sql("l_orderkey"), _bipartite_sql("l_partkey")
CO_SQL = """g as (select 2 * o_custkey as u, 2 * o_orderkey + 1 as v, cast(round(o_totalprice * 100) as bigint) as w from orders
 union all select * from (select 2 * lag(o_orderkey) over (partition by o_custkey order by o_orderkey) + 1 as u, 2 * o_orderkey + 1 as v, (cast(round(o_totalprice * 100) as bigint) + 1) // 2 as w from orders) where u is not null),
e as (select row_number() over (order by u, v) - 1 as eid, u, v, w from g)"""


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def bipartite(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """(u, v, w): suppliers and the orders or parts of their line items."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy((2 * F.col("l_suppkey")).alias("u"), (2 * F.col(key) + 1).alias("v")).agg(F.min(_cents("l_extendedprice")).alias("w"))


def supplier_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component at most scales, with many cycles."""
    return bipartite(spark, sf_dir, "l_orderkey")


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: about 25 edges a vertex."""
    return bipartite(spark, sf_dir, "l_partkey")


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, w): customers and their orders, and each order and the customer's next: a component a customer, of triangles side by side."""
    from quillgraph.operators.seq import with_index

    o = with_index(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderkey"])
    order = 2 * F.col("o_orderkey") + 1
    past = o.select((F.col("idx") + 1).alias("idx"), F.col("o_custkey").alias("_c"), order.alias("u"))
    chain = o.join(past, "idx").where("o_custkey = _c").select("u", order.alias("v"), F.floor((_cents("o_totalprice") + 1) / 2).cast("long").alias("w"))
    return o.select((2 * F.col("o_custkey")).alias("u"), order.alias("v"), _cents("o_totalprice").alias("w")).unionAll(chain)


def indexed(e: DataFrame) -> DataFrame:
    from quillgraph.operators.seq import with_index

    return with_index(e, ["u", "v"], "eid")


def both(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionAll(e.select("v", "u", "w"))


def least_vertex(e: DataFrame) -> int:
    return e.agg(F.min("u")).first()[0]


def vertices(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("u", "v")).alias("vid")).distinct()


# --- components and forests ----------------------------------------------------------------------------------------------

CC = ", ee as (select u as a, v as b from e union all select v, u from e), r(v, l) using key (v) as (select distinct a, a from ee union select n.b, n.x from (select ee.b, min(r.l) as x from r join ee on ee.a = r.v group by ee.b) n join recurring.r o on o.v = n.b where n.x < o.l)"


@query("cc_sizes", f"with recursive {CO_SQL}{CC} select l as label, count(*) as vertices from r group by l")
def cc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc_labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("vertices"))


@query("cc_labels", f"with recursive {CO_SQL}{CC} select v as vid, l as label from r")
def cc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.components import connected_components

    return connected_components(customer_orders(spark, sf_dir), src="u", dst="v")


@query("cc_supplier_orders", f"with recursive {SO_SQL}{CC} select v as vid, l as label from r")
def cc_supplier_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.components import connected_components

    return connected_components(supplier_orders(spark, sf_dir), src="u", dst="v")


@query("cc_count", f"with recursive {CO_SQL}{CC} select count(*) as components from r where v = l")
def cc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.components import component_count

    return component_count(cc_labels(spark, sf_dir))


@query("same_component", f"with recursive {CO_SQL}{CC} select v as vid, v + 2 as other, coalesce(r.l = b.l, false) as connected from r left join (select v as bv, l from r) b on bv = v + 2")
def same_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.components import same_component as same

    labels = cc_labels(spark, sf_dir)
    return same(labels, "vid", "other", labels.select("vid", (F.col("vid") + 2).alias("other")))


@query("stream_components", f"with recursive {CO_SQL}{CC} select v as vid, l as label from r where v <> l")
def stream_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of edges folds into: each vertex but the least of its component, and that."""
    from quillgraph.streaming.folds import ComponentsFold

    fold = ComponentsFold(spark, folder(spark, "components"))
    stream(customer_orders(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst")), fold)
    return fold.state().select(F.greatest("u", "v").alias("vid"), F.least("u", "v").alias("label"))


#: An edge is in no minimum forest if lighter edges join its ends; here every component is small.
CYCLES = """, ee as (select eid, u as a, v as b, w from e union all select eid, v, u, w from e),
r(x, xw, v) as (select eid, w, u from e union select r.x, r.xw, ee.b from r join ee on ee.a = r.v and (ee.w < r.xw or (ee.w = r.xw and ee.eid < r.x))),
bad as (select distinct e.eid from e join r on r.x = e.eid and r.v = e.v), f as (select e.* from e anti join bad using (eid))"""


def _bottlenecks(rounds: int = 7) -> str:
    """The forest by the lightest heaviest edge on the way between any two suppliers, for graphs of few suppliers: (rounds) squarings reach paths over 2 ** rounds of them."""
    q = ", k as (select *, row_number() over (order by w, eid) as rk from e), b0 as (select a.u as s, b.u as t, min(greatest(a.rk, b.rk)) as m from k a join k b on a.v = b.v and a.u <> b.u group by all union all select distinct u, u, 0 from k)"
    for i in range(rounds):
        q += f", b{i + 1} as materialized (select a.s, b.t, min(greatest(a.m, b.m)) as m from b{i} a join b{i} b on a.t = b.s group by all)"
    return q + f", bad as (select distinct k.eid from k join k o on o.v = k.v and o.rk < k.rk join b{rounds} b on b.s = k.u and b.t = o.u and b.m < k.rk), f as (select e.* from e anti join bad using (eid))"


def _forest(name: str, sql: str, edges, find) -> None:
    query(name, sql)(lambda spark, sf_dir: find(indexed(edges(spark, sf_dir))).select("eid", "u", "v", "w"))


def _register_forests() -> None:
    from quillgraph.operators import msf

    so, sp, co = f"with {SO_SQL}{_bottlenecks()}", f"with {SP_SQL}{_bottlenecks()}", f"with recursive {CO_SQL}{CYCLES}"
    _forest("msf_supplier_orders", f"{so} select eid, u, v, w from f", supplier_orders, msf.minimum_spanning_forest)
    _forest("msf_supplier_parts", f"{sp} select eid, u, v, w from f", supplier_parts, msf.minimum_spanning_forest)
    _forest("msf_customer_orders", f"{co} select eid, u, v, w from f", customer_orders, msf.minimum_spanning_forest)
    _forest("msf_filtered", f"{sp} select eid, u, v, w from f", supplier_parts, msf.filter_kruskal)
    _forest("msf_hybrid", f"{sp} select eid, u, v, w from f", supplier_parts, lambda e: msf.hybrid_msf(e, 3))
    query("msf_weight", f"{so} select cast(sum(w) as bigint) as total_weight, count(*) as edges from f")(lambda spark, sf_dir: msf.forest_weight(msf.minimum_spanning_forest(indexed(supplier_orders(spark, sf_dir)))))


_register_forests()


@query("spanning_forest", f"with recursive {CO_SQL}{CYCLES.replace('w from e', '0 as w from e').replace('eid, w, u', 'eid, 0, u')} select eid, u, v from f")
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.components import spanning_forest as forest

    return forest(indexed(customer_orders(spark, sf_dir)), src="u", dst="v")


@query("same_forest", "select true as equal_weight, true as equal_vertices")
def same_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two ways to the forest agree."""
    from quillgraph.operators import msf
    from quillgraph.plans.cut import cut

    e = cut(indexed(supplier_parts(spark, sf_dir)))
    return msf.same_forest(msf.minimum_spanning_forest(e), msf.chunked_msf(e, 2))


@query("bridges", f"""with recursive {CO_SQL}, ee as (select eid, u as a, v as b from e union all select eid, v, u from e),
r(x, v) as (select eid, u from e union select r.x, ee.b from r join ee on ee.a = r.v and ee.eid <> r.x)
select u as src, v as dst from e where eid not in (select e.eid from e join r on r.x = e.eid and r.v = e.v)""".replace("select u as src, v as dst", "select least(u, v) as src, greatest(u, v) as dst"))
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.biconnected import bridges as found

    return found(customer_orders(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst")))


# --- walks -----------------------------------------------------------------------------------------------------------------

BOTH = ", d as (select u as src, v as dst, w from e union all select v, u, w from e)"
LEVELS = ", lv(vid, level) using key (vid) as (select (select min(u) from e), 0::bigint union select n.dst, n.x from (select dst, min(level) + 1 as x from lv join d on src = vid group by dst) n left join recurring.lv o on o.vid = n.dst where o.vid is null)"
DISTANCES = """, r(vid, dist) using key (vid) as (select (select min(u) from e), 0::bigint union select n.dst, n.x from (select d.dst, min(r.dist + d.w)::bigint as x from r join d on d.src = r.vid group by d.dst) n left join recurring.r o on o.vid = n.dst where o.dist is null or n.x < o.dist)
select vid, dist from r"""


@query("bfs_levels", f"with recursive {SO_SQL}{BOTH}{LEVELS} select vid, level from lv")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import bfs

    e = supplier_orders(spark, sf_dir)
    return bfs(both(e), least_vertex(e), undirected=True)


@query("bfs_directed", f"with recursive {SP_SQL}, d as (select u as src, v as dst from e union all select v, u from e where w % 7 <> 0){LEVELS} select vid, level from lv")
def bfs_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From suppliers to all their parts, and back along most edges."""
    from quillgraph.operators.graph import bfs

    e = supplier_parts(spark, sf_dir)
    back = e.where("w % 7 <> 0").select(F.col("v").alias("src"), F.col("u").alias("dst"))
    return bfs(e.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionAll(back), least_vertex(e))


@query("shortest_paths", f"with recursive {SO_SQL}{BOTH}{DISTANCES}")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import bellman_ford

    e = supplier_orders(spark, sf_dir)
    return bellman_ford(both(e), least_vertex(e))


@query("bucketed_dijkstra", f"with recursive {SP_SQL}{BOTH}{DISTANCES}")
def bucketed_dijkstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import bucketed_dijkstra as settle

    e = supplier_parts(spark, sf_dir)
    return settle(both(e), least_vertex(e), 2_000_000)


def _dependencies(depth: int = 12) -> str:
    """Sums along shortest paths for graphs of at most `depth` levels."""
    q = ", g2 as materialized (select distinct d.src, d.dst, a.level as ls from d join lv a on a.vid = d.src join lv b on b.vid = d.dst and b.level = a.level + 1), s0 as (select vid, 1.0::double as sigma from lv where level = 0)"
    for k in range(depth):
        q += f", s{k + 1} as materialized (select dst as vid, sum(sigma) as sigma from g2 join s{k} on vid = src where ls = {k} group by dst)"
    q += ", sg as materialized (" + " union all ".join(f"select * from s{k}" for k in range(depth + 1)) + f"), t{depth} as (select vid, 0.0::double as delta from lv where level = {depth})"
    for k in range(depth - 1, -1, -1):
        q += f", t{k} as materialized (select lv.vid, coalesce(x, 0) as delta from lv left join (select g2.src, sum(a.sigma / b.sigma * (1 + t.delta)) as x from g2 join t{k + 1} t on t.vid = g2.dst join sg a on a.vid = g2.src join sg b on b.vid = g2.dst where ls = {k} group by g2.src) y on y.src = lv.vid where level = {k})"
    return q + " " + " union all ".join(f"select vid, round({'0.0::double' if k == 0 else 'delta'}, 6) as delta from t{k}" for k in range(depth + 1))


@query("betweenness", f"with recursive {SO_SQL}{BOTH}{LEVELS}{_dependencies()}")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import betweenness as delta

    e = supplier_orders(spark, sf_dir)
    return delta(both(e), least_vertex(e), undirected=True).select("vid", F.round("delta", 6).alias("delta"))


# --- choices: the pass over vertices or edges goes in the order of a hash -------------------------------------------------

NEIGHBOURS = f"""{BOTH}, p as (select vid, row_number() over (order by {mix_sql('vid')}, vid) as rk from (select distinct src as vid from d)),
n as (select d.src as v, d.dst as o, po.rk < pv.rk as before from (select distinct src, dst from d where src <> dst) d join p pv on pv.vid = d.src join p po on po.vid = d.dst)"""


@query("maximal_independent_set", f"""with recursive {CO_SQL}{NEIGHBOURS}, r(v, s) using key (v) as (select vid, 0 from p union
select * from (select a.v, case when bool_or(coalesce(b.s = 1, false)) then 2 when not bool_or(coalesce(b.s = 0 and n.before, false)) then 1 else 0 end as s
 from recurring.r a left join n on n.v = a.v left join recurring.r b on b.v = n.o where a.s = 0 and exists (select 1 from r) group by a.v) where s <> 0)
select v as vid from r where s = 1""")
def maximal_independent_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import maximal_independent_set as mis

    e = customer_orders(spark, sf_dir)
    return mis(both(e), vertices(e))


@query("maximal_matching", f"""with recursive {CO_SQL}, o as (select eid, u, v, row_number() over (order by {mix_sql('eid')}, eid) as rk from e where u <> v), r(eid, s) using key (eid) as (select eid, 0 from o union
select x.eid, x.s from (with l as (select o.* from o join recurring.r a on a.eid = o.eid where a.s = 0 and exists (select 1 from r)),
 b as (select v, min(rk) as rk from (select u as v, rk from l union all select v, rk from l) group by v),
 won as (select l.* from l join b x on x.v = l.u and x.rk = l.rk join b y on y.v = l.v and y.rk = l.rk), hit as (select u as v from won union select v from won)
 select eid, 1 as s from won union all select eid, 2 from l anti join won using (eid) where u in (select v from hit) or v in (select v from hit)) x)
select eid, u as src, v as dst from e join r using (eid) where s = 1""")
def maximal_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import maximal_matching as match

    return match(indexed(customer_orders(spark, sf_dir)).select("eid", F.col("u").alias("src"), F.col("v").alias("dst")))


@query("colouring", f"""with recursive {CO_SQL}{BOTH}, dd as (select distinct src, dst from d where src <> dst), deg as (select src as vid, count(*) as n from dd group by src),
p as (select vid, row_number() over (order by n desc, {mix_sql('vid')}, vid) as rk from deg),
n as (select dd.src as v, dd.dst as o from dd join p pv on pv.vid = dd.src join p po on po.vid = dd.dst where po.rk < pv.rk),
r(v, c) using key (v) as (select vid, 0::bigint from p where vid not in (select v from n) union
select v, list_min(list_filter(range(len(used) + 1), lambda x: not list_contains(used, x))) from (select n.v, list(distinct b.c) filter (b.c is not null) as used, count(*) filter (b.c is null) as open
 from n left join recurring.r b on b.v = n.o where exists (select 1 from r) and n.v not in (select v from recurring.r) group by n.v) where open = 0)
select v as vid, c as colour from r""")
def colouring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import colour

    e = customer_orders(spark, sf_dir)
    return colour(both(e), vertices(e))


@query("low_diameter_clusters", f"""with recursive {CO_SQL}{BOTH}, vs as (select distinct src as vid from d), sh as (select vid, -ln(({mix_sql('vid')} + 1) / {MIX_PRIME + 1}.0::double) / 0.2::double as s from vs),
st as (select vid, floor((select max(s) from sh) - s)::bigint as start from sh),
r(vid, centre, k) using key (vid) as (select -1, -1, -1::bigint union
select * from (with now as (select k + 1 as k from r where vid = -1), reached as (select d.dst as vid, min(r.centre) as centre from r join d on d.src = r.vid group by d.dst),
 new as (select vid, centre from reached union all select vid, vid from st where start = (select k from now) and vid not in (select vid from reached))
 select new.vid, new.centre, now.k from new, now where new.vid not in (select vid from recurring.r) union all select -1, -1, k from now where k <= (select max(start) from st)))
select vid::bigint as vid, centre::bigint as centre from r where vid >= 0""")
def low_diameter_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import low_diameter_decomposition

    e = customer_orders(spark, sf_dir)
    return low_diameter_decomposition(both(e), vertices(e))


#: Coreness is the fixed point of: the largest h such that h neighbours have h at least.
CORES = """, r(v, h) using key (v) as (select src, count(*) from (select distinct src, dst from d) group by src
union select n.v, n.h from (select v, max(least(val, pos)) as h from (select d.src as v, o.h as val, row_number() over (partition by d.src order by o.h desc) as pos from (select distinct src, dst from d) d join recurring.r o on o.v = d.dst) group by v) n
join recurring.r o on o.v = n.v where n.h < o.h and exists (select 1 from r)) select v as vid, h as core from r"""


@query("kcore", f"with recursive {SP_SQL}{BOTH}{CORES}")
def kcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import kcore as core

    return core(both(supplier_parts(spark, sf_dir)).select("src", "dst"))


@query("kcore_customer_orders", f"with recursive {CO_SQL}{BOTH}{CORES}")
def kcore_customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import kcore as core

    return core(both(customer_orders(spark, sf_dir)).select("src", "dst"))


@query("customer_triangles", f"with {CO_SQL}, d as (select least(u, v) as a, greatest(u, v) as b from e) select count(*) as triangles, 2 * count(*) as twice from d x join d y on y.a = x.b join d z on z.a = x.a and z.b = y.b")
def customer_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import triangles

    return triangles(customer_orders(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst")))


@query("cycle_count", f"with {base.S_SQL}, c0 as (select idx, row_number() over (order by value, idx) - 1 as nx, idx as m from s)" + "".join(f", c{k + 1} as materialized (select a.idx, b.nx, least(a.m, b.m) as m from c{k} a join c{k} b on b.idx = a.nx)" for k in range(20)) + " select count(*) filter (idx = m) as cycles from c20")
def cycle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import cycle_count as cycles
    from quillgraph.operators.scan import rank

    return cycles(rank(base.items(spark, sf_dir)).select("idx", F.col("rank").alias("value")))


# --- edge tables -----------------------------------------------------------------------------------------------------------

@query("edge_degrees", f"with {SO_SQL}{BOTH} select src as vid, count(*) as degree from d group by src")
def edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import degrees

    return degrees(both(supplier_orders(spark, sf_dir)))


@query("graph_stats", f"with {SO_SQL}{BOTH}, g2 as (select src, count(*) as n from d group by src) select cast(sum(n) as bigint) as edges, count(*) as vertices, max(n) as max_degree from g2")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import graph_stats as stats

    return stats(both(supplier_orders(spark, sf_dir)))


@query("normalised_matrix", f"with {SO_SQL}{BOTH} select src, dst, 1.0::double / count(*) over (partition by src) as x from d")
def normalised_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import normalised

    return normalised(both(supplier_orders(spark, sf_dir)).select("src", "dst"))


@query("matrix_transpose", f"with {SP_SQL} select v as row, u as col, w as value from e")
def matrix_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.numeric import transpose

    return transpose(supplier_parts(spark, sf_dir).select(F.col("u").alias("row"), F.col("v").alias("col"), F.col("w").alias("value")))


@query("vertex_hashes", f"with {SP_SQL}, x as (select distinct u as v from e union select v from e) select v as vid, {mix_sql('v', 3)} as h from x")
def vertex_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(supplier_parts(spark, sf_dir)).select("vid", mix(F.col("vid"), 3).alias("h"))


def _rmat_sql(scale: int, edges: int, a: float = 0.5, b: float = 0.15, c: float = 0.15) -> str:
    bits = ", ".join(f"{mix_sql(f'i * 64 + {k}')} / {MIX_PRIME}.0::double as u{k}" for k in range(scale))
    src = " + ".join(f"case when u{k} >= {a + b} then {1 << (scale - 1 - k)} else 0 end" for k in range(scale))
    dst = " + ".join(f"case when (u{k} >= {a} and u{k} < {a + b}) or u{k} >= {a + b + c} then {1 << (scale - 1 - k)} else 0 end" for k in range(scale))
    return f"rm as (select {bits} from range({edges}) t(i)), e as (select distinct ({src})::bigint as u, ({dst})::bigint as v from rm where ({src}) <> ({dst}))"


@query("rmat_components", f"with recursive {_rmat_sql(12, 20_000)}{CC} select coalesce(l, i) as label, count(*) as n from range({1 << 12}) q(i) left join r on v = i group by 1")
def rmat_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the components of a recursive-matrix graph."""
    from quillgraph.operators.components import connected_components
    from quillgraph.operators.graph import rmat

    return connected_components(rmat(spark, 12, 20_000), spark.range(1 << 12).select(F.col("id").alias("vid"))).groupBy("label").agg(F.count("*").alias("n"))
