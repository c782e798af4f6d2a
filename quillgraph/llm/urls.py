"""URL filters, with DataFrame and SQL functions alone.

A list holds canonical (host, path) rules. The keys under which a url could be listed, each of its host's suffixes with each of its path's
prefixes of a length that some rule has, are probed in a blocked Bloom filter of the listed keys; those that pass go to an exact hash
join with the list, which removes false positives; the longest rule wins.

Only distinct (host, head of the path) pairs are probed, so a hot host costs what its distinct heads cost. Filter, list and the rules found for
pairs are broadcast only where their counted bytes allow (`BROADCAST_BYTES`), and are joined by key otherwise; then the rules of hot
pairs, fewer than `HOT_SHARE`, are broadcast to their pages all the same, so that no pair's pages meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.plans.cut import cut

BROADCAST_BYTES = 8_000_000
#: A pair is hot if more than one in so many pages have it.
HOT_SHARE = 1000
#: A block has 8 words of 64 bits, and a key sets a bit in each.
WORDS, BITS_A_KEY = 8, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, in lower case; path: from there to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _block(h: str, p: str, n: int) -> Column:
    return F.pmod(F.xxhash64(h, p), F.lit(n))


def _bit(h: str, p: str, word: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(p, h, F.lit(7)), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0, ..., w7) from distinct or repeated keys (rh, rp): one row for each block that has a key."""
    masks = [F.bit_or(F.expr(f"shiftleft(1L, b{w})")).alias(f"w{w}") for w in range(WORDS)]
    bits = [_bit("rh", "rp", w).alias(f"b{w}") for w in range(WORDS)]
    return keys.select(_block("rh", "rp", n_blocks).alias("block"), *bits).groupBy("block").agg(*masks)


def _maybe_broadcast(df: DataFrame, most_bytes: int) -> DataFrame:
    return F.broadcast(df) if most_bytes <= BROADCAST_BYTES else df


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    `rules` is (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the rule's path; of
    those that fit the one with the longest host and path together wins, then that with the longer host, then the verdict that
    sorts last. `rule` is its host and path. Where none fits, `rule` is null and `verdict` is `default`, as for null urls, empty
    ones and those without ://, whose host and path are empty. Repeated rows have a row each; an empty table or an empty list of rules
    gives no row and no rule.
    """
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    src = src.select("_id", host.alias("host"), path.alias("path"))
    listed = rules.where("host is not null and path is not null").select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv"))
    listed = listed.groupBy("rh", "rp").agg(F.max("rv").alias("rv"))
    n, longest, most_chars = listed.agg(F.count("*"), F.max(F.length("rp")), F.sum(F.octet_length("rh") + F.octet_length("rp"))).first()
    if not n:
        return src.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = [r[0] for r in listed.select(F.length("rp")).distinct().orderBy(F.length("rp")).collect()]  # at most `longest` + 1
    n_blocks = max(1, math.ceil(n * BITS_A_KEY / (64 * WORDS)))
    bloom = _maybe_broadcast(bloom_filter(listed, n_blocks), n_blocks * (8 * WORDS + 16))

    head = F.substring("path", 1, longest) if longest else F.lit("")
    sites = cut(src.where("host <> ''").groupBy("host", head.alias("head")).agg(F.count("*").alias("pages")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice(F.col("labels"), i, F.size("labels")), "."))
    keys = sites.withColumn("labels", labels).select("host", "head", F.explode(suffixes).alias("kh"))
    keys = keys.select("host", "head", "kh", F.explode(F.array(*(F.lit(x) for x in lengths))).alias("n")).where("length(head) >= n")
    keys = keys.select("host", "head", "kh", F.expr("substring(head, 1, n)").alias("kp"))
    keys = keys.select("*", _block("kh", "kp", n_blocks).alias("kb"), *(_bit("kh", "kp", w).alias(f"b{w}") for w in range(WORDS)))
    passed = " and ".join(f"(shiftrightunsigned(w{w}, b{w}) & 1) = 1" for w in range(WORDS))
    possible = keys.join(bloom, F.col("kb") == F.col("block")).where(passed).select("host", "head", "kh", "kp")
    exact = possible.join(_maybe_broadcast(listed, most_chars + 64 * n), (F.col("kh") == F.col("rh")) & (F.col("kp") == F.col("rp")))
    order = F.struct(F.length("rh") + F.length("rp"), F.length("rh"))
    best = exact.groupBy("host", "head").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict")), order).alias("best"))
    best = cut(best.select(F.col("host").alias("bh"), F.col("head").alias("bp"), "best.*"))
    here = (F.col("host") == F.col("bh")) & (head == F.col("bp"))
    if (best.agg(F.sum(64 + sum(F.octet_length(c) for c in best.columns))).first()[0] or 0) <= BROADCAST_BYTES:
        out = src.join(F.broadcast(best), here, "left")
    else:
        bar = sites.agg(F.sum("pages")).first()[0] // HOT_SHARE
        hot = cut(sites.where(F.col("pages") > bar).select(F.col("host").alias("hh"), F.col("head").alias("hp")))
        mine = (F.col("bh") == F.col("hh")) & (F.col("bp") == F.col("hp"))
        there = (F.col("host") == F.col("hh")) & (head == F.col("hp"))
        rules_of_hot = hot.join(best, mine, "left").select("hh", "hp", "rule", "verdict")
        few = src.join(F.broadcast(hot), there, "left_anti").join(best, here, "left")
        out = src.join(F.broadcast(rules_of_hot), there).select("_id", "host", "path", "rule", "verdict").unionAll(few.select("_id", "host", "path", "rule", "verdict"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict for every page's url. Null urls have empty hosts and paths and no rule."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True))) for r in RULES))
    rules = spark.range(1).select(F.inline(rows))
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def _oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
with rules(rh, rp, rv) as (values {values}),
r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest, row_number() over () as row from pages),
p as (select row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
fits as (select row, max_by(rh || rp, length(rh) + length(rp)) as rule, max_by(rv, length(rh) + length(rp)) as verdict
         from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by row)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join fits using (row)"""


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {"op5_url_filter": _oracle()}
