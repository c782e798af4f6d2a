"""Mixing sources to target weights, with DataFrame and SQL functions alone.

Documents are dealt by a hash of their id into `blocks` blocks a source; a block's words are pre-aggregated. A source's
target is drawn as whole epochs of all its blocks, then blocks in the permuted order of one more epoch, the last of them
cut at a document. That fixes each source's exact quota of block draws. A splitting tree then shares the quotas among
2 ** `levels` output shards: in each node the draws are ranked by a hash, and the first half goes left, so the counts of
sources on the left are a multivariate hypergeometric sample of the node's. A shard takes the next disjoint run of each
source's permuted draws, as long as its quota, and is shuffled on its own.

All tables but the documents have at most sources x blocks x `cap` rows, and that of key prefixes in the blocks that are cut,
16 ** `CUT_DIGITS` / `blocks` a source; no step holds one source's, block's or shard's documents together. The block that is cut is
pre-aggregated by prefixes of the keys, and only the documents of two prefixes are sorted as (key, size). A shard of more
than `task_words` words is shuffled and written in several tasks, each with a range of its random order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.plans.cut import cut

BLOCKS = 64
LEVELS = 4
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = "mix1"
#: Leading hexadecimal digits of a key by which the documents of a cut block are pre-aggregated.
CUT_DIGITS = 6
#: Words that one task of the mixture shuffles and writes, about.
TASK_WORDS = 8_000_000
WORD = r"[^\x20\x09-\x0D]+"


def _weight(weights: tuple[int, ...], n: str) -> str:
    return f"element_at(array({', '.join(map(str, weights))}), cast(pmod({n} - 1, {len(weights)}) + 1 as int))"


def keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, blocks: int, seed: str) -> DataFrame:
    """`docs` with _size (words), _sk (the source as a key), _k (a hash of the id, of the text where there is no id) and _block."""
    i, t = F.col(id_col).cast("string"), F.col(text_col)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(i, F.concat(F.lit("t"), F.md5(t.cast("binary"))), F.lit("none"))).cast("binary"))
    out = docs.withColumns({"_size": F.coalesce(F.regexp_count(t, F.lit(WORD)).cast("long"), F.lit(0).cast("long")), "_sk": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")), "_k": key})
    return out.withColumn("_block", F.pmod(F.conv(F.substring("_k", 1, 4), 16, 10).cast("long"), F.lit(blocks)))


def _source_targets(block_words: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(sk, source_size, target): weighted shares of all words, each at most `cap` times its source's size.

    The final shares are min(cap * size, level * weight) for one level. Sources reach their caps in order of
    cap * size / weight; with the first k of them at their caps, what is left over the other weights rises with k until the
    next source is not reached, and falls from there on, so the level is the largest of these.
    """
    v = block_words.groupBy("_sk").agg(F.sum("words").alias("source_size"))
    return v.sparkSession.sql(
        f"""
        with w as (select *, {_weight(weights, "row_number() over (order by _sk = 'n', _sk)")} as weight from {{v}}),
        r as (select *, {cap} * source_size as most, sum(source_size) over () as total from w),
        c as (select *, coalesce(sum(most) over (order by most / weight, _sk rows between unbounded preceding and 1 preceding), 0) as capped,
              sum(weight) over (order by most / weight, _sk rows between current row and unbounded following) as rest from r),
        l as (select max(cast(total - capped as double) / rest) as level from c)
        select _sk, source_size, least(cast(most as double), level * weight) as target from r cross join l
        """,
        v=v,
    )


def _tree(draws: DataFrame, levels: int, seed: str) -> DataFrame:
    """(sk, shard, quota) from draws (sk, pos): each node's draws are split in half at random, `levels` times."""
    q = "select _sk, pos, 0 as node from {draws}"
    for level in range(levels):
        q = f"""select _sk, pos, 2 * node + if(2 * rank > n + 1, 1, 0) as node from (
            select *, row_number() over (partition by node order by md5(cast(concat('{seed}:{level}:', _sk, ':', pos) as binary)), _sk, pos) as rank,
                   count(*) over (partition by node) as n from ({q}))"""
    return draws.sparkSession.sql(f"select _sk, node as shard, count(*) as quota from ({q}) group by _sk, node", draws=draws)


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """What becomes of each block, from keyed rows: (_sk, _block, source_size, target, whole_shards, part_shard, cut_k, cut_size).

    `whole_shards` lists the shards that take the whole block, one entry for each draw; `part_shard` takes its documents
    up to (cut_k, cut_size) in order of key and size.
    """
    spark = rows.sparkSession
    words = cut(rows.groupBy("_sk", "_block").agg(F.sum("_size").alias("words")))
    targets = _source_targets(words, weights, cap)
    laid = cut(
        spark.sql(
            f"""
            with t as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as long) as epochs from {{targets}}),
            b as (select w._sk, w._block, w.words, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size as rest,
                  md5(cast(concat('{seed}:', t.epochs, ':', w._sk, ':', w._block) as binary)) as o from {{words}} w join t on w._sk = t._sk)
            select *, coalesce(sum(words) over (partition by _sk order by o, _block rows between unbounded preceding and 1 preceding), 0) as before from b
            """,
            targets=targets,
            words=words,
        )
    )
    draws = cut(
        spark.sql(
            f"""
            with whole as (select _sk, _block, epoch, false as part, md5(cast(concat('{seed}:', epoch, ':', _sk, ':', _block) as binary)) as o
                           from (select *, explode(sequence(0L, epochs)) as epoch from {{laid}})
                           where epoch < epochs or (words > 0 and before + words <= rest)),
            part as (select _sk, _block, epochs as epoch, true as part, o from {{laid}} where before < rest and before + words > rest)
            select *, row_number() over (partition by _sk order by epoch, part, o, _block) - 1 as pos from (select * from whole union all select * from part)
            """,
            laid=laid,
        )
    )
    quotas = _tree(draws.select("_sk", "pos"), levels, seed)
    dealt = spark.sql(
        """
        with r as (select *, coalesce(sum(quota) over (partition by _sk order by shard rows between unbounded preceding and 1 preceding), 0) as at from {quotas})
        select d._sk, d._block, sort_array(collect_list(if(not part, shard, null))) as whole_shards, max(if(part, shard, null)) as part_shard
        from {draws} d join r on d._sk = r._sk and d.pos >= r.at and d.pos < r.at + r.quota group by d._sk, d._block
        """,
        quotas=quotas,
        draws=draws,
    )
    edge = laid.where("before < rest and before + words > rest").select(F.col("_sk").alias("sk"), F.col("_block").alias("bl"), (F.col("rest") - F.col("before")).alias("room"))
    at_edge = cut(
        spark.sql(
            f"""
            select _sk, substring(_k, 1, {CUT_DIGITS}) as prefix, room, sum(_size) as words
            from {{rows}} join {{edge}} on _sk = sk and _block = bl group by _sk, substring(_k, 1, {CUT_DIGITS}), room
            """,
            rows=rows.select("_sk", "_block", "_k", "_size"),
            edge=edge,
        )
    )
    # The cut lies in the last prefix that begins within the room, or at the end of the one before it.
    near = spark.sql(
        """
        with c as (select *, coalesce(sum(words) over (partition by _sk order by prefix rows between unbounded preceding and 1 preceding), 0) as begin from {at_edge})
        select _sk as sk, prefix, room, begin from (select *, row_number() over (partition by _sk order by prefix desc) as back from c where begin <= room) where back <= 2
        """,
        at_edge=at_edge,
    )
    cuts = spark.sql(
        f"""
        with g as (select _sk, prefix, begin, _k, _size, room, count(*) * _size as words
                   from {{rows}} join {{edge}} e on _sk = e.sk and _block = bl join {{near}} n on _sk = n.sk and substring(_k, 1, {CUT_DIGITS}) = prefix
                   group by _sk, prefix, begin, _k, _size, room),
        c as (select *, begin + coalesce(sum(words) over (partition by _sk, prefix order by _k, _size rows between unbounded preceding and 1 preceding), 0) as before from g)
        select _sk, max(struct(_k, _size)) as last from c where before + words / 2 <= room group by _sk
        """,
        rows=rows.select("_sk", "_block", "_k", "_size"),
        edge=edge.select("sk", "bl"),
        near=near,
    )
    return cut(
        spark.sql(
            """
            select l._sk, l._block, source_size, target, coalesce(whole_shards, cast(array() as array<int>)) as whole_shards, part_shard, last._k as cut_k, last._size as cut_size
            from {laid} l left join {dealt} d on l._sk = d._sk and l._block = d._block left join {cuts} c on l._sk = c._sk
            """,
            laid=laid,
            dealt=dealt,
            cuts=cuts,
        )
    )


def _join_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnsRenamed({c: f"_p_{c}" for c in plan.columns})
    joined = rows.join(p, (F.col("_sk") == F.col("_p__sk")) & (F.col("_block") == F.col("_p__block")))
    part = F.expr("_p_part_shard is not null and coalesce((_k, _size) <= (_p_cut_k, _p_cut_size), false)")
    return joined.withColumn("_shards", F.expr("_p_whole_shards")).withColumn("_shards", F.when(part, F.concat("_shards", F.array("_p_part_shard"))).otherwise(F.col("_shards")))


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, blocks: int = BLOCKS, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, shards) for each row of `docs`.

    Size counts words (null and empty texts: 0). Sources in order of code points, null last, take the weights in turn and
    share all words; a share stops at `cap` times its source's words, and the excess is shared anew by weight. The mixture is drawn,
    dealt to shards and shuffled, by the rows' numbers without their texts; `taken` adds up what was drawn of a row, at most `cap` times its size; `shards` lists the shards that take the row, in order. Repeated rows are rows of their own and share a fate; where ids are null
    the text takes the id's place. Each source's taken words are within half a document of its target (with repeated ids, half the rows
    that share one). An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = cut(keyed(d, "doc_id", "source", "text", blocks, seed).select("doc_id", "_size", "_sk", "_k", "_block", F.monotonically_increasing_id().alias("_n")))
    planned = cut(_join_plan(rows, plan_mix(rows, weights, cap, levels, seed)))
    drawn = _dealt(planned.select("_n", "_size", "_k", F.posexplode("_shards").alias("_epoch", "_shard")), rows, levels, seed, TASK_WORDS)
    drawn = cut(drawn.select("_n", "_shard", "_size"))  # the mixture, by rows' numbers, in its order
    took = drawn.groupBy(F.col("_n").alias("_d")).agg(F.sum("_size").alias("taken"), F.array_sort(F.collect_list("_shard")).alias("shards"))  # at most `cap` draws a row
    shards = F.coalesce(F.concat_ws(",", F.col("shards").cast("array<string>")), F.lit(""))
    out = planned.join(took, F.col("_n") == F.col("_d"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("_size").alias("size"), F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), shards.alias("shards"))


def _dealt(out: DataFrame, sized: DataFrame, levels: int, seed: str, task_words: int) -> DataFrame:
    """Draws (..., _k, _epoch, _shard), each shard in partitions of its own, about `task_words` words in each, in its random order."""
    local = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_shard"), F.lit(":"), F.col("_k"), F.lit(":"), F.col("_epoch")).cast("binary"))
    words = sized.agg(F.sum("_size")).first()[0] or 0
    parts = 1 + words // (task_words << levels)
    part = F.floor(F.conv(F.substring("_o", 1, 8), 16, 10).cast("long") * parts / (1 << 32))
    return out.withColumn("_o", local).repartitionById(parts << levels, (F.col("_shard") * parts + part).cast("int")).sortWithinPartitions("_shard", "_o")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, blocks: int = BLOCKS, levels: int = LEVELS, seed: str = SEED, shard_col: str | None = None, task_words: int = TASK_WORDS) -> DataFrame:
    """The mixture: rows of `docs`, each as often as it was drawn, dealt to shards and shuffled within each.

    A shard is one partition, or as many consecutive ones as keep it at about `task_words` words in each.

    Columns are those of `docs`, whatever their names, and `shard_col` if given. A row without words is drawn with its block like any other; null ids, texts
    and sources and repeated rows are as in `mix_report`. An empty table gives an empty result.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = keyed(docs.toDF(*names), at[id_col], at[source_col], at[text_col], blocks, seed)
    sized = cut(rows.select("_size", "_sk", "_k", "_block"))
    taken = _join_plan(rows, plan_mix(sized, weights, cap, levels, seed))
    out = taken.select(*names, "_k", F.posexplode("_shards").alias("_epoch", "_shard"))
    out = _dealt(out, sized, levels, seed, task_words)
    out = out.select(*names, "_shard").toDF(*docs.columns, shard_col or "_shard")
    return out if shard_col else out.drop("_shard")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document. Null texts have size 0, a null source is a source of its own, the last."""
    return mix_report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    tree = "select sk, pos, 0 as node from draws"
    for level in range(LEVELS):
        tree = f"""select sk, pos, 2 * node + case when 2 * rank > n + 1 then 1 else 0 end as node from (
            select *, row_number() over (partition by node order by md5('{SEED}:{level}:' || sk || ':' || pos), sk, pos) as rank, count(*) over (partition by node) as n from ({tree}) t{level}) u{level}"""
    hexa = " + ".join(f"(strpos('0123456789abcdef', substr(k, {i + 1}, 1)) - 1) * {16 ** (3 - i)}" for i in range(4))
    return rf"""
with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, coalesce('s' || source, 'n') as sk,
           md5('{SEED}:' || coalesce(cast(doc_id as varchar), 't' || md5(text), 'none')) as k from documents),
d2 as (select *, ({hexa}) % {BLOCKS} as block from d),
words as (select sk, block, cast(sum(size) as bigint) as words from d2 group by all),
s as (select sk, cast(sum(words) as bigint) as source_size from words group by all),
w as (select *, 1 + (row_number() over (order by sk = 'n', sk) - 1) % 3 as weight from s),
r as (select *, {CAP} * source_size as most, cast(sum(source_size) over () as bigint) as total from w),
c as (select *, coalesce(cast(sum(most) over (order by most / weight, sk rows between unbounded preceding and 1 preceding) as bigint), 0) as capped,
      cast(sum(weight) over (order by most / weight, sk rows between current row and unbounded following) as bigint) as rest from r),
l as (select max(cast(total - capped as double) / rest) as level from c),
t as (select sk, source_size, least(cast(most as double), level * weight) as target from r cross join l),
t2 as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
b as (select words.sk, block, words, source_size, target, epochs, target - epochs * source_size as rest, md5('{SEED}:' || epochs || ':' || words.sk || ':' || block) as o from words join t2 using (sk)),
laid as (select *, coalesce(cast(sum(words) over (partition by sk order by o, block rows between unbounded preceding and 1 preceding) as bigint), 0) as before from b),
draws0 as (select sk, block, epoch, false as part, md5('{SEED}:' || epoch || ':' || sk || ':' || block) as o from (select *, unnest(range(epochs + 1)) as epoch from laid) x where epoch < epochs or (words > 0 and before + words <= rest)
           union all select sk, block, epochs, true, o from laid where before < rest and before + words > rest),
draws as (select *, row_number() over (partition by sk order by epoch, part, o, block) - 1 as pos from draws0),
quotas as (select sk, node as shard, count(*) as quota from ({tree}) tt group by all),
q as (select *, coalesce(cast(sum(quota) over (partition by sk order by shard rows between unbounded preceding and 1 preceding) as bigint), 0) as first_pos from quotas),
dealt as (select draws.sk, block, part, shard from draws join q on draws.sk = q.sk and pos >= first_pos and pos < first_pos + quota),
g as (select d2.sk, k, size, rest - before as room, count(*) * size as words from d2 join laid on d2.sk = laid.sk and d2.block = laid.block where before < rest and before + words > rest group by d2.sk, k, size, rest - before),
g2 as (select *, coalesce(cast(sum(words) over (partition by sk order by k, size rows between unbounded preceding and 1 preceding) as bigint), 0) as before from g),
cuts as (select sk, max(k) as cut_k, max_by(size, (k, size)) as cut_size from g2 where before + words / 2.0 <= room group by all),
whole as (select sk, block, list(shard) as shards from dealt where not part group by all),
part as (select sk, block, shard from dealt where part),
e as (select doc_id, size, source_size, target, list_sort(coalesce(whole.shards, []) || case when part.shard is not null and (k < cut_k or (k = cut_k and size <= cut_size)) then [part.shard] else [] end) as shards
      from d2 join t2 using (sk) left join whole on d2.sk = whole.sk and d2.block = whole.block left join part on d2.sk = part.sk and d2.block = part.block left join cuts on d2.sk = cuts.sk)
select doc_id, cast(size as bigint) as size, source_size, target, cast(size * len(shards) as bigint) as taken, array_to_string(shards, ',') as shards from e"""


QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES = {"op4_mix_sources": _oracle()}
