import zlib

import numpy as np

from quillgraph.llm import quality as Q
from quillgraph.llm.tables import table

SF = "/root/testdata/sf0.01"


def plain_margin(forest, v):
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        i = 0
        while i < len(feature):
            i = 2 * i + (2 if v[feature[i]] > threshold[i] else 1)
        total += leaf[i - len(feature)]
    return total


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    forest = Q.fit(x, y, trees=20)
    assert np.allclose(forest.margin(x), [plain_margin(forest, v) for v in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    assert len(forest.margin(x[:0])) == 0


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r.doc_id: r for r in Q.op6_quality_classifier(spark, SF).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([(r.score >= 0.5) == q for r, q in held]) >= 0.95
    assert np.mean([r.predicted for r, q in held if q]) >= 0.98


def test_edges(spark):
    docs = [(None, None), (1, ""), (1, "again and again " * 40), (2, "x" * 300_000), (2, "Good text, as it was."), (3, "!!! ### $$$\n" * 5), (None, "!!! ### $$$\n" * 5)]
    df = spark.createDataFrame([(*d, "en", 7) for d in docs], "doc_id long, text string, lang string, _score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = Q.quality_scores(df, labels).collect()
    assert len(got) == len(docs)
    assert len({r.score for r in got if r.doc_id in (3, None)} ) <= 2
    none = Q.quality_scores(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.quality_scores(df.limit(0), labels).count() == 0
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns
    by = {(r.doc_id, r.score) for r in got}
    assert kept.count() == sum(r.predicted for r in got), by
    assert Q.keep_good(df.limit(0), labels).count() == 0


def test_bounded_sample_is_the_same_for_any_partitioning(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a, b = ({r.doc_id: r.score for r in Q.quality_scores(docs.repartition(n), labels, max_train=60).collect()} for n in (2, 5))
    assert a == b
