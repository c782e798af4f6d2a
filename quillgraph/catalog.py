"""All registered queries and their SQL, but for those of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- sequences: line items in order ------------------------------------------------------------------------------

S_SQL = "s as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as idx, cast(l_quantity as bigint) as value, l_linenumber as key from lineitem)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.seq import with_index

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return with_index(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("idx", F.col("l_quantity").cast("long").alias("value"), F.col("l_linenumber").alias("key"))


def on_items(name: str, sql: str):
    """Registers a query on the sequence of quantities; the SQL reads s(idx, value, key)."""
    def add(f):
        query(name, f"with {S_SQL} {sql}")(lambda spark, sf_dir: f(items(spark, sf_dir)))
        return f

    return add


def _register_sequences() -> None:
    from quillgraph.operators import agg, scan, seq, sort

    on_items("seq_scan_exclusive", "select idx, value, coalesce(cast(sum(value) over (order by idx rows between unbounded preceding and 1 preceding) as bigint), 0) as scan from s")(lambda s: scan.scan(s.select("idx", "value")))
    on_items("seq_scan_inclusive", "select idx, value, cast(sum(value) over (order by idx) as bigint) as scan from s")(lambda s: scan.scan(s.select("idx", "value"), inclusive=True))
    on_items("seq_scan_max", "select idx, value, max(value) over (order by idx rows between unbounded preceding and 1 preceding) as scan from s")(lambda s: scan.scan(s.select("idx", "value"), "max"))
    on_items("seq_scan_segmented", "select idx, value, key, coalesce(cast(sum(value) over (partition by key order by idx rows between unbounded preceding and 1 preceding) as bigint), 0) as scan from s")(lambda s: scan.scan(s, by=["key"]))
    on_items("seq_rank", "select idx, row_number() over (order by value, idx) - 1 as rank from s")(lambda s: scan.rank(s))
    on_items("seq_mcss", "select max(t - least(l, 0)) as mcss from (select t, coalesce(min(t) over (order by idx rows between unbounded preceding and 1 preceding), 0) as l from (select idx, cast(sum(value - 25) over (order by idx) as bigint) as t from s))")(lambda s: scan.max_contiguous_sum(s.select("idx", (F.col("value") - 25).alias("value"))))
    on_items("seq_reduce", "select cast(sum(value) as bigint) as value from s")(lambda s: agg.reduce(s))
    on_items("seq_reduce_xor", "select bit_xor(value) as value from s")(lambda s: agg.reduce(s, "bit_xor"))
    on_items("seq_minmax_element", "select min(idx) filter (value = lo) as min_pos, min(idx) filter (value = hi) as max_pos from s, (select min(value) as lo, max(value) as hi from s)")(lambda s: agg.minmax_element(s))
    on_items("seq_map", "select idx, value * value + 1 as value from s")(lambda s: seq.map_values(s, "value * value + 1"))
    on_items("seq_filter", "select idx, value from s where value % 3 = 0")(lambda s: seq.filter_values(s.select("idx", "value"), "value % 3 = 0"))
    on_items("seq_remove_if", "select idx, value from s where not value > 10")(lambda s: seq.remove_if(s.select("idx", "value"), "value > 10"))
    on_items("seq_pack", "select idx, value from s where key = 1")(lambda s: seq.pack(s.select("idx", "value"), s.select("idx", (F.col("key") == 1).alias("value"))))
    on_items("seq_pack_index", "select idx from s where value = 50")(lambda s: seq.pack_index(seq.map_values(s, "value = 50")))
    on_items("seq_map_maybe", "select idx, value // 2 as value from s where value % 2 = 0")(lambda s: seq.map_maybe(s, "if(value % 2 = 0, value div 2, null)"))
    on_items("seq_zip_with", "select idx, value * key as value from s")(lambda s: seq.zip_with(s.select("idx", "value"), s.select("idx", F.col("key").alias("value")), "a * b"))
    on_items("seq_count_if", "select count(*) as n from s where value > 40")(lambda s: seq.count_if(s, "value > 40"))
    on_items("seq_quantify", "select bool_and(value > 0) as all_of, bool_or(value > 50) as any_of, not bool_or(value > 50) as none_of from s")(lambda s: s.agg(F.bool_and(F.expr("value > 0")).alias("all_of")).join(seq.quantify(s, "value > 50").drop("all_of")))
    on_items("seq_find_if", "select coalesce(min(idx) filter (value = 37), count(*)) as pos from s")(lambda s: seq.find_if(s, "value = 37"))
    on_items("seq_find_first_of", "select coalesce(min(idx) filter (value in (48, 49)), count(*)) as pos from s")(lambda s: seq.find_first_of(s, s.sparkSession.createDataFrame([(48,), (49,)], "value long")))
    on_items("seq_adjacent_find", "select coalesce(min(idx) filter (value = n), count(*)) as pos from (select idx, value, lead(value) over (order by idx) as n from s)")(lambda s: seq.adjacent_find(s.select("idx", "value")))
    on_items("seq_mismatch", "select coalesce(min(idx) filter (value <> least(value, 49)), count(*)) as pos from s")(lambda s: seq.mismatch(s.select("idx", "value"), seq.map_values(s, "least(value, 49L)")))
    on_items("seq_equal", "select bool_and(value = least(value, 49)) as equal from s")(lambda s: seq.equal(s.select("idx", "value"), seq.map_values(s, "least(value, 49L)")))
    on_items("seq_lexicographical", "select coalesce(arg_min(a < b, idx) filter (a <> b), false) as less from (select idx, value as a, least(value, 49) + case when key = 7 then 1 else 0 end as b from s)")(lambda s: seq.lexicographical_compare(s.select("idx", "value"), s.select("idx", F.expr("least(value, 49L) + if(key = 7, 1, 0)").alias("value"))))
    on_items("seq_search", "select coalesce(min(idx), (select count(*) from s)) as first, coalesce(max(idx), (select count(*) from s)) as last, count(*) as n from (select idx, value, lead(value) over (order by idx) as b from s) where value = 12 and b = 30")(lambda s: seq.search(s.select("idx", "value"), s.sparkSession.createDataFrame([(0, 12), (1, 30)], "idx long, value long")))
    on_items("seq_is_sorted_until", "select coalesce(min(idx) filter (value < p), count(*)) as until, min(idx) filter (value < p) is null as sorted from (select idx, value, lag(value) over (order by idx) as p from s)")(lambda s: seq.is_sorted_until(s.select("idx", "value")))
    on_items("seq_is_partitioned", "select coalesce(max(idx) filter (value > 10) < min(idx) filter (not value > 10), true) as partitioned from s")(lambda s: seq.is_partitioned(s, "value > 10"))
    on_items("seq_reverse", "select (select count(*) from s) - 1 - idx as idx, value from s")(lambda s: seq.reverse(s.select("idx", "value")))
    on_items("seq_rotate", "select (idx - 1000 + (select count(*) from s)) % (select count(*) from s) as idx, value from s")(lambda s: seq.rotate(s.select("idx", "value"), 1000))
    on_items("seq_append", "select idx, value from s union all select idx + (select count(*) from s), key from s")(lambda s: seq.append(s.select("idx", "value"), s.select("idx", F.col("key").cast("long").alias("value"))))
    on_items("seq_erase", "select case when idx < 100 then idx else idx - 400 end as idx, value from s where idx < 100 or idx >= 500")(lambda s: seq.erase(s.select("idx", "value"), 100, 500))
    on_items("seq_cut", "select idx - 100 as idx, value from s where idx >= 100 and idx < 500")(lambda s: seq.cut_between(s, 100, 500))
    on_items("seq_unique", "select idx, value from (select idx, value, lag(value) over (order by idx) as p from s) where p is null or p <> value")(lambda s: agg.unique(s.select("idx", "value")))
    on_items("seq_split_at", "select piece, array_to_string(list(value order by idx), ',') as items from (select idx, value, coalesce(sum(case when value = 50 then 1 else 0 end) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as piece from s) group by piece union all select count(*) filter (value = 50), '' from s having arg_max(value, idx) = 50")(lambda s: seq.split_at(s.select("idx", "value"), "value = 50").select("piece", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items")))
    on_items("seq_gather", "select s.idx, t.value from s join s t on t.idx = s.value * 7")(lambda s: seq.gather(s.select("idx", "value"), seq.map_values(s, "value * 7")))
    on_items("seq_scatter", "select value as idx, arg_max(key, s.idx)::bigint as value from s group by s.value")(lambda s: seq.scatter(s.select("idx", F.col("key").cast("long").alias("value")), s.select("idx", "value")))
    on_items("seq_flatten", "select row_number() over (order by idx, k) - 1 as idx, idx * 10 + k as value from (select idx, unnest(range(value % 3)) as k from s)")(lambda s: seq.flatten(s.select("idx", F.expr("if(value % 3 = 0, cast(array() as array<long>), transform(sequence(0L, value % 3 - 1), k -> idx * 10 + k))").alias("value"))))
    on_items("seq_sort", "select row_number() over (order by value, idx) - 1 as idx, value, idx as source from s")(lambda s: sort.stable_sort(s.select("idx", "value")))
    on_items("seq_counting_sort_offsets", "select k as key, coalesce(cast(sum(n) over (order by k rows between unbounded preceding and 1 preceding) as bigint), 0) as offset, n as value from (select k, count(s.idx) as n from range(8) r(k) left join s on s.key = k group by k)")(lambda s: sort.counting_sort(s, 8)[1].join(agg.histogram_by_index(s, 8), "key"))
    on_items("seq_kth_smallest", "select value from s order by value limit 1 offset 12345")(lambda s: sort.kth_smallest(s, 12345))
    on_items("seq_merge", "select row_number() over (order by value, h, idx) - 1 as idx, value from (select idx, value, case when key <= 3 then 0 else 1 end as h from s)")(lambda s: sort.merge(s.where("key <= 3").select("idx", "value"), s.where("key > 3").select("idx", "value")))
    on_items("seq_reduce_by_key", "select key, cast(sum(value) as bigint) as value from s group by key")(lambda s: agg.reduce_by_key(s))
    on_items("seq_group_by_key", "select key, md5(array_to_string(list(value order by idx), ',')) as items from s group by key")(lambda s: agg.group_by_key(s).select("key", F.md5(F.concat_ws(",", F.col("items").cast("array<string>")).cast("binary")).alias("items")))
    on_items("seq_histogram_by_key", "select value as key, count(*) as n from s group by value")(lambda s: agg.histogram_by_key(s.select(F.col("value").alias("key"))))
    on_items("seq_histogram_by_index", "select k as key, count(s.idx) as value from range(64) r(k) left join s on s.value = k group by k")(lambda s: agg.histogram_by_index(s.select(F.col("value").alias("key")), 64))
    on_items("seq_reduce_by_index", "select k as key, coalesce(cast(sum(s.key) as bigint), 0) as value from range(64) r(k) left join s on s.value = k group by k")(lambda s: agg.reduce_by_index(s.select(F.col("value").alias("key"), F.col("key").alias("value")), 64))
    on_items("seq_group_by_index", "select k as key, coalesce(md5(array_to_string(list(s.key order by s.idx) filter (s.idx is not null), ',')), md5('')) as value from range(64) r(k) left join s on s.value = k group by k")(lambda s: agg.group_by_index(s.select("idx", F.col("value").alias("key"), F.col("key").alias("value")), 64).select("key", F.md5(F.concat_ws(",", F.col("value").cast("array<string>")).cast("binary")).alias("value")))
    on_items("seq_remove_duplicates", "select distinct value from s")(lambda s: agg.remove_duplicates(s))
    query("text_counts", "select cast(sum(length(text) - length(replace(text, chr(10), ''))) as bigint) as lines, cast(sum(len(regexp_extract_all(text, '[^ \\f\\n\\r\\t\\x0B]+'))) as bigint) as words, cast(sum(strlen(text)) as bigint) as bytes from documents")(lambda spark, d: agg.text_counts(spark.read.parquet(f"{d}/documents.parquet")))


_register_sequences()


# --- text and numbers ----------------------------------------------------------------------------------------------

@query("word_counts", "select word, count(*) as n from (select unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+')) as word from documents) group by word")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.functions.text import word_counts as count

    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("word_counts_top", "select word, count(*) as n from (select unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+')) as word from documents) group by word order by n desc, word limit 20")
def word_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(spark, sf_dir).orderBy(F.col("n").desc(), "word").limit(20)


@query("match_positions", "select doc_id, p - 1 as pos from (select doc_id, text, unnest(range(1, length(text) - 3)) as p from documents) where substr(text, p, 4) = 'tion'")
def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.functions.text import match_positions as positions

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(positions(F.col("text"), "tion")).alias("pos")).select("doc_id", F.col("pos").cast("long"))


@query("linefit", "select round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_slope(l_extendedprice, l_quantity), 6) as slope from lineitem")
def linefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.numeric import linefit as fit

    out = fit(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", "l_extendedprice")
    return out.select(F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


@query("primes", "select n as value from range(2, 10001) r(n) where not exists (select 1 from range(2, 101) q(p) where n > p and n % p = 0)")
def primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.numeric import primes as upto

    return upto(spark, 10_000)


# --- graphs -----------------------------------------------------------------------------------------------------------

NATION_SQL = """
g as (select least(c.c_nationkey, s.s_nationkey)::bigint as u, greatest(c.c_nationkey, s.s_nationkey)::bigint as v, min(cast(round(o_totalprice * 100) as bigint)) as w
      from lineitem join orders o on l_orderkey = o_orderkey join customer c on o_custkey = c_custkey join supplier s on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2),
e as (select row_number() over (order by u, v) - 1 as eid, u, v, w from g)"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between nations of customers and suppliers that trade: at most 300 rows."""
    from quillgraph.operators.seq import with_index

    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "supplier")}
    j = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["orders"].select("o_orderkey", "o_custkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    g = j.groupBy(F.least("c_nationkey", "s_nationkey").cast("long").alias("u"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("v")).agg(F.min(F.round(F.col("o_totalprice") * 100).cast("long")).alias("w"))
    return with_index(g, ["u", "v"], "eid")


MSF_TAIL = """
, ee as (select eid, u as a, v as b, w from e union all select eid, v, u, w from e),
r(x, xw, v) as (select eid, w, u from e union select r.x, r.xw, ee.b from r join ee on ee.a = r.v and (ee.w < r.xw or (ee.w = r.xw and ee.eid < r.x))),
bad as (select distinct e.eid from e join r on r.x = e.eid and r.v = e.v),
f as (select e.* from e anti join bad using (eid))"""


@query("msf_nations", f"with recursive {NATION_SQL}{MSF_TAIL} select eid, u, v, w from f")
def msf_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.msf import minimum_spanning_forest

    return minimum_spanning_forest(nations(spark, sf_dir)).select("eid", "u", "v", "w")


@query("msf_chunked", f"with recursive {NATION_SQL}{MSF_TAIL} select eid, u, v, w from f")
def msf_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.msf import chunked_msf

    return chunked_msf(nations(spark, sf_dir), 4).select("eid", "u", "v", "w")


@query("msf_maximum", f"with recursive {NATION_SQL.replace('min(cast', '-min(cast')}{MSF_TAIL} select eid, u, v, -w as w from f")
def msf_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.msf import minimum_spanning_forest

    return minimum_spanning_forest(nations(spark, sf_dir), maximum=True).select("eid", "u", "v", "w")


@query("triangles", f"with {NATION_SQL} select count(*) as triangles, 2 * count(*) as twice from e a join e b on a.v = b.u join e c on c.u = a.u and c.v = b.v")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import triangles as count

    return count(nations(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst")))


PR_SQL = f"""with {NATION_SQL}, d as (select u as src, v as dst from e union all select v, u from e), m as (select src, dst, 1.0::double / count(*) over (partition by src) as x from d),
r0 as (select n as vid, 1.0::double / 25 as rank from range(25) t(n))""" + "".join(f", r{k} as (select a.vid, 0.15::double / 25 + 0.85::double * coalesce(g, 0) as rank from r{k - 1} a left join (select dst, sum(rank * x) as g from r{k - 1} join m on vid = src group by dst) on dst = a.vid)" for k in range(1, 11)) + " select vid, round(rank, 9) as rank from r10"


@query("pagerank", PR_SQL)
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import pagerank as rank, symmetrise

    return rank(symmetrise(nations(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"))), 25).select("vid", F.round("rank", 9).alias("rank"))


# --- trees, learning, bounded graphs -----------------------------------------------------------------------------------

@query("range_min", f"with {S_SQL}, m as (select idx, min(value * 1000000000 + idx) over (order by idx rows between current row and cast((idx * 7919 + value * 104729) % ((select count(*) from s) - idx) as bigint) following) as x from s) select idx as qid, x % 1000000000 as pos, x // 1000000000 as value from m")
def range_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each line item, with ranges of all lengths up to that of the sequence."""
    from quillgraph.operators.trees import range_min as least

    s = items(spark, sf_dir).select("idx", "value")
    n = s.count()
    return least(s, s.select(F.col("idx").alias("qid"), F.col("idx").alias("i"), (F.col("idx") + F.pmod(F.col("idx") * 7919 + F.col("value") * 104_729, F.lit(n) - F.col("idx"))).alias("j")))


@query("cartesian_tree", """
with t as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as p, cast(l_quantity as bigint) as v from lineitem),
l as (select a.o, a.p, max(b.p) as x from t a join t b on a.o = b.o and b.p < a.p and b.v <= a.v group by all),
r as (select a.o, a.p, min(b.p) as x from t a join t b on a.o = b.o and b.p > a.p and b.v < a.v group by all)
select t.o as orderkey, t.p as pos, coalesce(case when lv.v > rv.v then l.x when rv.v is not null then r.x else l.x end, t.p) as parent
from t left join l using (o, p) left join r using (o, p) left join t lv on lv.o = t.o and lv.p = l.x left join t rv on rv.o = t.o and rv.p = r.x""")
def cartesian_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.trees import cartesian_tree as parents

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("x"))
    rows = li.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l_quantity"].cast("long")).alias("v"))
    return rows.select("orderkey", F.posexplode(parents("v")).alias("pos", "parent")).select("orderkey", F.col("pos").cast("long").alias("pos"), "parent")


@query("huffman_codes", """
with recursive l as (select c, count(*) as n from (select unnest(string_split(text, '')) as c from documents) group by c),
h(a, bits) as (select list(n order by n), 0::bigint from l union all select list_sort(list_append(a[3:], a[1] + a[2])), bits + a[1] + a[2] from h where len(a) > 1)
select (select count(*) from l) as symbols, max(bits) as bits, true as complete from h""")
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of codes for all characters of the documents: the symbols, the bits of all texts, which no other codes make fewer, and whether the lengths fill a binary tree."""
    from quillgraph.operators.trees import huffman_tree

    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "")).alias("symbol")).where("symbol <> ''")
    codes = huffman_tree(chars.groupBy("symbol").agg(F.count("*").alias("weight"))).where("symbol is not null")
    return codes.agg(F.count("*").alias("symbols"), F.sum(F.col("weight") * F.col("depth")).cast("long").alias("bits"), (F.sum(F.pow(F.lit(2.0), -F.col("depth"))) == 1).alias("complete"))


@query("suffix_tree_nodes", """
with t as (select p_partkey as k, p_name as s from part), i as (select k, s, unnest(range(length(s)))::bigint as i from t),
u as (select k, s, i, unnest(range(0, (length(s) - i + 1)::bigint)) as n from i),
b as (select k, substr(s, i::int + 1, n::int) as x from u group by all having count(distinct substr(s, i::int + n::int + 1, 1)) > 1 union select k, '' from t),
p as (select a.k, a.x, max(length(b.x)) as above from b a join b on a.k = b.k and length(b.x) < length(a.x) and starts_with(a.x, b.x) group by a.k, a.x),
l as (select i.k, i.i, substr(s, i.i::int + 1) as x, max(length(b.x)) as above from i join b on i.k = b.k and starts_with(substr(s, i.i::int + 1), b.x) group by i.k, i.i, s)
select k as p_partkey, 'branch' as kind, null::bigint as start, b.x as text, coalesce(above, 0) as above from b left join p using (k, x)
union all select k, 'leaf', i, x, above from l""")
def suffix_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the suffix trees of all parts' names: their text, for leaves their start, and the length of the text of the branch above."""
    from quillgraph.operators.trees import suffix_tree

    n = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", suffix_tree("p_name").alias("t")).select("p_partkey", "p_name", F.explode("t").alias("n"), F.map_from_entries(F.transform("t", lambda x: F.struct(x["node"], x["depth"]))).alias("depths"))
    leaf = F.col("n.node") % 2 == 0
    text = F.substring("p_name", F.col("n.start") + 1, F.col("n.depth"))
    return n.select("p_partkey", F.when(leaf, "leaf").otherwise("branch").alias("kind"), F.when(leaf, F.col("n.start")).alias("start"), text.alias("text"), F.element_at("depths", F.col("n.parent")).alias("above"))


@query("suffix_tree_find", """
with p as (select p_partkey, p_name, substr(p_name, cast(1 + p_partkey % greatest(length(p_name), 1) as int), cast(p_partkey % 7 as int)) as x from part),
q as (select p_partkey, p_name, case when p_partkey % 3 = 0 then reverse(x) else x end as pattern from p),
i as (select p_partkey, p_name, pattern, unnest(range(length(p_name))) as i from q),
f as (select p_partkey, min(i) as start, count(*) as n from i where starts_with(substr(p_name, cast(i + 1 as int)), pattern) group by p_partkey)
select p_partkey, pattern, start, n from q left join f using (p_partkey)""")
def suffix_tree_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the suffix tree of each part's name: the first position and the occurrences of a piece of the name, of up to six characters, for every third part backwards."""
    from quillgraph.operators.trees import suffix_tree
    from quillgraph.operators.trees import suffix_tree_find as find

    piece = F.substring("p_name", (1 + F.col("p_partkey") % F.greatest(F.length("p_name"), F.lit(1))).cast("int"), (F.col("p_partkey") % 7).cast("int"))
    pattern = F.when(F.col("p_partkey") % 3 == 0, F.reverse(piece)).otherwise(piece)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", pattern.alias("pattern"), suffix_tree("p_name").alias("t"))
    return parts.select("p_partkey", "pattern", find(F.col("p_name"), F.col("t"), F.col("pattern")).alias("f")).select("p_partkey", "pattern", "f.start", "f.n")


@query("c45_classify")
def c45_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tree for the return flag predicts, in counts."""
    from quillgraph.operators.learning import c45, classify

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.ascii("l_returnflag") - 65).alias("y"), "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"), (F.ascii("l_linestatus") - 65).alias("status"))
    return classify(li, c45(li, "y", ["l_linenumber", "status"], ["quantity"])).groupBy("y", "predicted").agg(F.count("*").alias("n"))


@query("lasso", """
with recursive x as (select l_quantity::double as a, l_discount::double as b, l_tax::double as c, (l_extendedprice / 1000)::double as y from lineitem),
g as (select sum(a*a) as aa, sum(a*b) as ab, sum(a*c) as ac, sum(b*b) as bb, sum(b*c) as bc, sum(c*c) as cc, sum(a*y) as ay, sum(b*y) as yb, sum(c*y) as cy from x),
w(k, p, q, r) as (select 0, 0.0::double, 0.0::double, 0.0::double
 union all select k + 1, p1, q1, sign(pc) * greatest(abs(pc) - 10, 0) / (2 * cc) from (select *, 2 * (cy - ac * p1 - bc * q1) as pc from (select *, sign(pb) * greatest(abs(pb) - 10, 0) / (2 * bb) as q1 from (select *, 2 * (yb - ab * p1 - bc * r) as pb from (select *, sign(pa) * greatest(abs(pa) - 10, 0) / (2 * aa) as p1 from (select *, 2 * (ay - ab * q - ac * r) as pa from w, g where k < 2000)))))),
e as (select p, q, r from w where k = 2000)
select 0::bigint as feature, round(p, 6) as weight from e union all select 1, round(q, 6) from e union all select 2, round(r, 6) from e""")
def lasso_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.learning import lasso

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))).alias("v"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))
    w, _ = lasso(li, 10.0)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "feature long, weight double")


@query("linear_program", """
with h as (select cos(c_custkey * 0.7) as a, sin(c_custkey * 0.7) as b, 1 + (c_custkey % 97) / 100.0::double as c from customer),
l as (select * from h where a + 0.5 * b > 0 and a * 0.5 - b < 0), r as (select * from h where a + 0.5 * b > 0 and a * 0.5 - b > 0)
select round(min(((r.b * l.c - l.b * r.c) + 0.5 * (l.a * r.c - r.a * l.c)) / (l.a * r.b - l.b * r.a)), 6) as best from l cross join r""")
def linear_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.learning import linear_program_2d

    angle = F.col("c_custkey") * 0.7
    h = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.cos(angle).alias("a"), F.sin(angle).alias("b"), (1 + (F.col("c_custkey") % 97) / 100).alias("c"))
    x, y = linear_program_2d(h, 1.0, 0.5)
    return spark.createDataFrame([(round(x + 0.5 * y, 6),)], "best double")


@query("le_lists", f"""
with recursive {NATION_SQL}, d as (select u as src, v as dst from e union all select v, u from e), v as (select distinct src as x from d),
r(root, vid, dist) as (select x, x, 0 from v union select root, dst, dist + 1 from r join d on src = vid where dist < 8),
m as (select root, vid, min(dist) as dist from r group by root, vid)
select vid, root, dist from m where not exists (select 1 from m o where o.vid = m.vid and o.root < m.root and o.dist <= m.dist)""")
def le_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import le_lists as lists, symmetrise

    from quillgraph.operators.seq import with_index

    e = symmetrise(nations(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    return lists(e, with_index(e.select(F.col("src").alias("vid")).distinct(), ["vid"], "ord"))


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    return e.select(F.lit(0).alias("graph"), F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("cap")).unionAll(e.select(F.lit(0), "v", "u", "w"))


@query("max_flow", f"with {NATION_SQL} select 0::int as graph, least(cast(sum(w) filter (u = 0 or v = 0) as bigint), cast(sum(w) filter (u = 24 or v = 24) as bigint)) as flow from e")
def max_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.bounded import max_flow as flow

    return flow(nation_graph(spark, sf_dir), 0, 24)


@query("spectral_partition")
def spectral_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.bounded import spectral_partition as parts

    return parts(nation_graph(spark, sf_dir))


@query("ray_cast", """
with r as (select s_suppkey::bigint as rid, s_suppkey * 0.37::double % 1 as x, s_suppkey * 0.61::double % 1 as y from supplier),
t as (select c_custkey::bigint as tid, c_custkey * 0.37::double % 1 as x, c_custkey * 0.61::double % 1 as y, (1 + c_custkey % 13)::double as z from customer),
m as (select rid, tid, z, (r.x + 0.01 * z - t.x) / 0.2 as a, (r.y + 0.02 * z - t.y) / 0.2 as b from r cross join t),
h as (select rid, arg_min(tid, z * 1000000000 + tid) as tid from m where a >= 0 and b >= 0 and a + b <= 1 group by rid)
select rid, coalesce(h.tid, -1) as tid from r left join h using (rid)""")
def ray_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays upwards from suppliers, and a small triangle for each customer."""
    from quillgraph.operators.geometry import ray_cast as cast

    def at(key: str):
        return (F.col(key) * 0.37) % 1, (F.col(key) * 0.61) % 1

    x, y = at("s_suppkey")
    rays = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("rid"), F.array(x, y, F.lit(0.0)).alias("o"), F.array(F.lit(0.01), F.lit(0.02), F.lit(1.0)).alias("d"))
    x, y = at("c_custkey")
    z = 1 + F.col("c_custkey") % 13
    tri = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("tid"), F.array(x, y, z).alias("a"), F.array(F.lit(0.2), F.lit(0.0), F.lit(0.0)).alias("ab"), F.array(F.lit(0.0), F.lit(0.2), F.lit(0.0)).alias("ac"))
    return cast(rays, tri)


from quillgraph import catalog_files, catalog_graphs, catalog_more  # noqa: E402, F401  (they add their queries)
