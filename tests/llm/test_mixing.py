import re
from collections import defaultdict

import duckdb
import pytest

from quillgraph.llm import mixing as M
from quillgraph.llm.tables import table

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, cap=3, weights=(1, 2, 3)):
    """Targets by sharing the excess anew until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        rest = sum(w[s] for s in order if s not in capped)
        target = {s: cap * sizes[s] if s in capped else left * w[s] / rest for s in order}
        over = {s for s in order if target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        capped |= over


def check(docs, got):
    """docs: [(id, text, source)] with distinct ids."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sizes = defaultdict(int)
    for d, _, s in docs:
        sizes[s] += size[d]
    target = plain_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _, _ in docs)
    source = {d: s for d, _, s in docs}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s])
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_documents(spark):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    got = M.op4_mix_sources(spark, SF).collect()
    check(docs, got)
    again = M.mix_report(table(spark, SF, "documents").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(M.ORACLES["op4_mix_sources"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in M.op4_mix_sources(spark, SF).collect()) == want


ODD = [(i, "word " * (i % 7), "abc"[i % 3]) for i in range(60)] + [(100, None, "b"), (101, "", None), (102, "few words here", None), (103, "x " * 3000, "hot"), (104, "\x0b\x1c\xa0", "é")] + [(200 + i, "same words", "hot") for i in range(50)] + [(300, None, "empty")]


def test_odd_sources_and_the_mixture(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in ODD], "doc_id long, text string, source string, _size int, _k string").repartition(3)
    got = M.mix_report(df, blocks=4, levels=2).collect()
    check(ODD, got)
    shards = defaultdict(list)
    for r in got:
        for s in filter(None, r.shards.split(",")):
            shards[r.doc_id].append(int(s))
    out = M.mix(df, blocks=4, levels=2, shard_col="shard")
    assert out.columns == [*df.columns, "shard"]
    drawn = defaultdict(list)
    for r in out.collect():
        drawn[r.doc_id].append(r.shard)
    assert {d: sorted(v) for d, v in drawn.items()} == {d: sorted(v) for d, v in shards.items()}
    small = M.mix(df, blocks=4, levels=2, shard_col="shard", task_words=300)
    parts = small.rdd.getNumPartitions()
    assert parts > 4 and parts % 4 == 0
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, out.collect()))
    assert [r.shard for r in small.collect()] == sorted(r.shard for r in out.collect())
    assert [r.doc_id for r in small.collect() if r.shard == 1] == [r.doc_id for r in out.collect() if r.shard == 1]
    assert M.mix(df).columns == df.columns
    assert M.mix_report(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, f"text {i} of many", "a") for i in range(30)] + [(1, "one", "b")] * 5 + [(None, None, None)] * 3
    got = M.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 3 * r.size for r in got)


def test_quotas_are_split_exactly(spark):
    draws = spark.createDataFrame([("a", i) for i in range(700)] + [("b", i) for i in range(300)], "_sk string, pos long")
    q = {(r._sk, r.shard): r.quota for r in M._tree(draws, 3, "s").collect()}
    assert sum(v for (s, _), v in q.items() if s == "a") == 700 and sum(v for (s, _), v in q.items() if s == "b") == 300
    for shard in range(8):
        assert q["a", shard] + q["b", shard] == 125
        assert 70 <= q["a", shard] <= 105  # expected 87.5, standard deviation under 5
