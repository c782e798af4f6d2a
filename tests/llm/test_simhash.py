import hashlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import simhash as S
from quillgraph.llm.tables import table


def plain_fp(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    """[(id, fp, component)] by comparing all pairs."""
    fps = [plain_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def key(r):
    return tuple((x is None, x) if x is not None else (True, 0) for x in r)


def test_anchors_cover_all_pairs_at_one_bit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, 300, dtype=np.uint64).astype(np.uint32)
    x[:3] = [0, 2**32 - 1, 1 << 31]
    mine = {i: set() for i in range(len(x))}
    for r, a in zip(*S.half_anchors(x)):
        mine[int(r)].add(int(a))
        assert int(np.bitwise_count(np.uint32(a) ^ x[r])) <= 2
    for bit in range(32):
        y = x ^ np.uint32(1 << bit)
        theirs = {i: set() for i in range(len(x))}
        for r, a in zip(*S.half_anchors(y)):
            theirs[int(r)].add(int(a))
        assert all(mine[i] & theirs[i] for i in range(len(x)))


def test_documents_against_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in S.op8_simhash_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(plain_groups(rows))


CASES = [(1, None), (2, ""), (3, "  \t"), (4, "Alpha Beta"), (4, "alpha beta"), (None, "alpha\nBETA"), (7, "Ä ä é"), (8, "ä ä é"), (None, "lonely words here indeed"), (None, "lonely words here indeed"), (9, "w " * 50_000), (10, "a b c d"), (10, "zz yy xx ww")]


def test_edges_and_extra_columns(spark):
    df = spark.createDataFrame([(*r, "x", 5) for r in CASES], "doc_id long, text string, _fp string, label int")
    got = [tuple(r) for r in S.simhash_dedup(df).collect()]
    assert sorted(got, key=key) == sorted(plain_groups(CASES), key=key)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    first = min("Alpha Beta", "alpha beta", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted([(r.doc_id, r.text and r.text[:12]) for r in kept.collect()], key=key) == sorted([(1, None), (4, first), (7, "Ä ä é"), (8, "ä ä é"), (9, "w w w w w w "), (10, "a b c d"), (10, "zz yy xx ww"), (None, "lonely words")], key=key)


def test_repeated_id_with_a_near_copy_of_another(spark):
    rows = [(5, "alpha beta"), (10, "Alpha Beta"), (10, "zz yy xx ww"), (11, "own words"), (11, "own words"), (12, "ALPHA beta")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(5, "alpha beta"), (10, "zz yy xx ww"), (11, "own words")]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_dedup(df).count() == 0
    assert S.keep_one(df).count() == 0


@pytest.mark.parametrize("heavy", [4, 40, 65_536])
def test_dense_groups_and_split_anchors(spark, heavy):
    """Chains of near fingerprints, in groups large enough for every way of comparing."""
    rng = np.random.default_rng(heavy)
    fps = set()
    for _ in range(3):
        x = int(rng.integers(0, 2**63))
        for _ in range(150):
            fps.add(x)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
    fps = sorted(fps)
    prints = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "doc_id long, _fp long").repartition(3)
    got = {r.doc_id: r.component_id for r in S.near_groups(prints, heavy=heavy).collect()}
    left, want = set(range(len(fps))), {}
    while left:
        todo = [min(left)]
        root = todo[0]
        left.discard(root)
        while todo:
            i = todo.pop()
            want[i] = root
            near = [j for j in left if (fps[i] ^ fps[j]).bit_count() <= 3]
            left.difference_update(near)
            todo += near
    assert got == want


def test_files_of_state(spark, monkeypatch):
    """Each file that an executor writes to the shared folder starts processes: what is small or read once takes few of them, whatever the shuffle partitions."""
    files = []
    monkeypatch.setattr(S, "cut", lambda df, cut=S.cut: files.append((kept := cut(df)).rdd.getNumPartitions()) or kept)
    how = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in how}
    rows = [(1, 0b0000), (2, 0b0111), (3, 0b111111000000), (4, 2**40), (5, 2**50 - 1), (None, 2**50 - 1)]
    try:
        for k, v in how.items():
            spark.conf.set(k, v)
        prints = spark.createDataFrame(rows, "doc_id long, _fp long")
        for heavy in (2, 65_536):
            files.clear()
            got = {(r.doc_id, r._fp): r.component_id for r in S.near_groups(prints, heavy=heavy).collect()}
            assert got == {(1, 0): 1, (2, 7): 1, (3, 0b111111000000): 3, (4, 2**40): 1, (5, 2**50 - 1): 5, (None, 2**50 - 1): 5}
            assert sorted(files) == [1, 24, 24]  # anchors with many fingerprints; distinct fingerprints; links
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
