"""The chain of stages, each on its own input, against plain ones."""

import re
from collections import Counter, defaultdict

from test_mixing import plain_targets
from test_packing import check_packing
from test_simhash import plain_groups

import corpus_pipeline as C
from quillgraph.llm.quality import quality_scores
from quillgraph.llm.tables import table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(name, spark, before, sf):
    """What a stage is to return of `before`; of mixing, only how often each document may be there."""
    if name == "quality":
        good = {r.doc_id for r in quality_scores(before, table(spark, sf, "labels")).collect() if r.predicted}
        return [r for r in rows(before) if r[0] in good]
    docs = rows(before.select("doc_id", "text"))
    kept = {d for d, _, c in plain_groups(docs) if d == c}
    return [r for r in rows(before) if r[0] in kept]


def check_mix(before, after):
    size, sizes, taken, largest = {}, Counter(), Counter(), defaultdict(int)
    source = {r.doc_id: r.source for r in before}
    for r in before:
        size[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    copies = Counter(r.doc_id for r in after)
    assert set(map(tuple, after)) <= set(map(tuple, before)) and max(copies.values()) <= 3
    for d, n in copies.items():
        taken[source[d]] += n * size[d]
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_stages_and_run(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    assert docs.count() == docs.select("doc_id").distinct().count() and docs.columns[0] == "doc_id"
    for name, stage in C.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            check_packing(out.collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)
        else:
            assert out.columns == docs.columns
            if name == "mixing":
                check_mix(docs.collect(), out.collect())
            else:
                assert rows(out) == plain(name, spark, docs, sf) and 0 < out.count() < docs.count()
        docs = out
    assert rows(C.run(spark, sf)) == rows(docs)
