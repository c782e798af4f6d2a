import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import embeddings as V
from quillgraph.llm.tables import table


def plain(rows, threshold=0.9):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        component = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8, 100, 4096])
def test_clusters(spark, block, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 16)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 6))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + rng.normal(size=(150, 6)) * 0.25, rng.normal(size=(60, 6)), np.repeat(centres[:1], 40, axis=0)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted((tuple(r) for r in V.embedding_dedup(df, block=block).collect()), key=str) == plain(rows)


def test_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted((tuple(r) for r in V.op9_embedding_dedup(spark, sf).collect()), key=str) == plain(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (None, [2.0, 0.0]), (8, [1e-30, 0.0]), (8, [1e-30, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (11, [3e38, 1e37]), (12, [-0.0, -1.0]), (13, [0.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, "e") for r in rows], "vec_id long, embedding array<float>, uid int, e string")
    assert sorted((tuple(r) for r in V.embedding_dedup(df).collect()), key=str) == plain([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert V.embedding_dedup(df.limit(0)).count() == 0
    assert V.embedding_dedup(df.limit(3)).count() == 3
