import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.scalar import generated_weight
from quillgraph.operators import agg, components, geometry, graph, msf, numeric, scan, seq, sort
from quillgraph.sources import graphs
from quillgraph.streaming.folds import ComponentsFold, ForestFold


def seq_of(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"idx long, value {kind}").repartition(3)


def values(df, name="value"):
    return [r[name] for r in df.orderBy("idx").collect()]


EDGES = [(0, 0, 1, 4), (1, 1, 2, 1), (2, 2, 0, 1), (3, 2, 3, 7), (4, 4, 5, 2), (5, 4, 4, 0)]
K = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]


def test_components_and_forest(spark):
    e = spark.createDataFrame(EDGES, "eid long, u long, v long, w long")
    labels = components.connected_components(e, spark.range(7).withColumnRenamed("id", "vid"), "u", "v")
    assert [r.label for r in labels.orderBy("vid").collect()] == [0, 0, 0, 0, 4, 4, 6]
    assert components.component_count(labels).first().components == 3
    for bound in (0, 100):
        f = msf.minimum_spanning_forest(e, finish_edges=bound)
        assert sorted(r.eid for r in f.collect()) == [1, 2, 3, 4]
    assert msf.forest_weight(f).first().total_weight == 11
    assert msf.heaviest_edge(f).first().eid == 3


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_random_graphs_without_the_last_task(spark, parts):
    rng = random.Random(parts)
    edges = [(i, rng.randrange(60), rng.randrange(60), rng.randrange(5)) for i in range(90)] + [(1000 + i, 100 + i, 101 + i, 1) for i in range(40)]
    e = spark.createDataFrame(edges, "eid long, u long, v long, w long").repartition(parts)
    sets, chosen = components.UnionFind(), []
    for eid, u, v, w in sorted(edges, key=lambda x: (x[3], x[0])):
        if u != v and sets.union(u, v):
            chosen.append(eid)
    assert sorted(r.eid for r in msf.minimum_spanning_forest(e, finish_edges=0).collect()) == sorted(chosen)
    got = {r.vid: r.label for r in components.connected_components(e, src="u", dst="v", finish_edges=0).collect()}
    assert got == {v: sets.find(v) for _, a, b, _ in edges for v in (a, b)}


def test_graph_k(spark):
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(K)], "eid long, src long, dst long")
    v = spark.range(6).withColumnRenamed("id", "vid")
    assert graph.triangles(e).first().triangles == 4
    assert [r.core for r in graph.kcore(e).orderBy("vid").collect()] == [3, 3, 3, 3, 1, 1]
    assert sorted(r.vid for r in graph.maximal_independent_set(e, v, hashed=False).collect()) == [0, 4]
    assert sorted(r.eid for r in graph.maximal_matching(e, hashed=False).collect()) == [0, 5, 7]
    assert [r.colour for r in graph.colour(e, v, hashed=False).orderBy("vid").collect()] == [1, 2, 3, 0, 1, 0]
    ranks = [r["rank"] for r in graph.pagerank(graph.symmetrise(e), 6).orderBy("vid").collect()]
    assert ranks == pytest.approx([0.173796] * 3 + [0.237717, 0.150987, 0.089908], abs=1e-6)
    assert [r.level for r in graph.bfs(graph.symmetrise(e), 5).orderBy("vid").collect()] == [3, 3, 3, 2, 1, 0]
    w = graph.symmetrise(e).withColumn("w", F.lit(2))
    assert [r.dist for r in graph.bellman_ford(w, 5).orderBy("vid").collect()] == [6, 6, 6, 4, 2, 0]
    assert graph.bellman_ford(spark.createDataFrame([(0, 1, -1), (1, 0, 0)], "src long, dst long, w long"), 0) is None


def test_other_graph_algorithms(spark):
    diamond = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "src long, dst long")
    assert {r.vid: r.delta for r in graph.betweenness(diamond, 0).collect()} == {0: 0.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0}
    assert graph.cycle_count(seq_of(spark, [1, 2, 0, 4, 3, 5])).first().cycles == 3
    cover = graph.set_cover(spark.createDataFrame([(0, x) for x in range(6)] + [(1, 0), (2, 6), (3, 6)], "set long, element long"))
    assert sorted(r.set for r in cover.collect()) == [0, 2]
    v = spark.range(25).withColumnRenamed("id", "vid")
    found = graph.low_diameter_decomposition(graph.grid(spark, 5), v).collect()
    assert len(found) == 25 and all(r.centre in {x.vid for x in found if x.vid == x.centre} for r in found)
    assert graph.grid(spark, 3).count() == 40
    r = graph.rmat(spark, 6, 500)
    assert r.count() == r.distinct().count() and r.where("src = dst or src >= 64 or dst >= 64").isEmpty()


def test_sequences(spark):
    s = seq_of(spark, [3, 1, 2, 3, 1])
    assert values(scan.scan(s, block=2), "scan") == [0, 3, 4, 6, 9]
    assert values(scan.scan(s, "max", True, block=2), "scan") == [3] * 5
    assert values(scan.rank(s), "rank") == [3, 0, 2, 4, 1]
    assert tuple(agg.minmax_element(s).first()) == (1, 0)
    assert values(sort.stable_sort(s)) == [1, 1, 2, 3, 3] and values(sort.stable_sort(s), "source") == [1, 4, 2, 0, 3]
    assert scan.max_contiguous_sum(seq_of(spark, [1, -3, 4, -1, 2, -5, 3])).first().mcss == 5
    assert scan.max_contiguous_sum(seq_of(spark, [-3, -1, -2])).first().mcss == -1
    assert [r["items"] for r in seq.split_at(s, "value = 1").orderBy("piece").collect()] == [[3, 1], [2, 3, 1], []]
    assert values(seq.insert(s, 2, seq_of(spark, [7, 8]))) == [3, 1, 7, 8, 2, 3, 1]
    assert sorted(values(sort.random_permutation(spark, 50))) == list(range(50))
    assert scan.ordered_reduce(seq_of(spark, list("sequence"), "string"), lambda a, b: a + b, "", "string", block=3).first().value == "sequence"
    one = seq_of(spark, [((50021 * i + 61) % 2**20) for i in range(1000)])
    assert agg.reduce(one).first().value == 519126692 and sort.kth_smallest(one, 999).first().value == 1047106
    with pytest.raises(Exception, match="out of range"):
        agg.histogram_by_index(s.withColumnRenamed("value", "key"), 2).collect()


def test_empty_sequences(spark):
    s = seq_of(spark, [1]).limit(0)
    assert agg.reduce(s).first().value == 0 and agg.reduce(s, "min").first().value is None
    assert tuple(seq.quantify(s, "value > 0").first()) == (True, False, True)
    assert seq.find_if(s, "true").first().pos == 0 and seq.equal(s, s).first().equal
    assert scan.scan(s).count() == 0 and scan.rank(s).count() == 0 and seq.reverse(s).count() == 0
    assert tuple(seq.search(seq_of(spark, [1]), s).first()) == (1, 1, 0)


def test_strings(spark):
    df = spark.createDataFrame([("kitten", "sitting", 5), ("abc", "", 3), ("abc", "abd", 2), (None, "x", None)], "a string, b string, n long")
    assert df.where(~T.insert_delete_distance("a", "b").eqNullSafe(F.col("n"))).isEmpty()
    b = spark.createDataFrame([("banana",), ("",), (None,)], "t string").select(T.suffix_array("t").alias("sa"), T.lcp_array("t").alias("lcp"), T.longest_repeat("t").alias("r"), T.burrows_wheeler("t").alias("bw")).collect()
    assert (b[0].sa, b[0].lcp, tuple(b[0].r), b[0].bw) == ([5, 3, 1, 0, 4, 2], [1, 3, 0, 0, 2], (3, 1, 3), "annb\0aa")
    assert b[1].sa == [] and b[2].sa is None
    runs = spark.createDataFrame([("a" * 2500,), ("xaaay",), ("aa",), ("",), (None,)], "t string").select(T.match_positions(F.col("t"), "aaa").alias("p")).collect()
    assert [r.p for r in runs] == [list(range(2498)), [1], [], [], []]
    row = spark.createDataFrame([(" one\ttwo\n",)], "t string").select(T.tokens(F.col("t")).alias("w"), T.token_bounds(F.col("t")).alias("b")).first()
    assert row.w == ["one", "two"] and [(x.start, x.end) for x in row.b] == [(1, 4), (5, 8)]


def test_numbers(spark):
    fit = numeric.linefit(spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.5)], "x double, y double")).first()
    assert (fit.intercept, fit.slope) == (pytest.approx(0.916667, abs=1e-6), pytest.approx(2.25))
    assert [r.value for r in numeric.primes(spark, 13).orderBy("value").collect()] == [2, 3, 5, 7, 11, 13]
    assert numeric.integrate(spark, "x * x", 0, 3, 1000).first().integral == pytest.approx(9, abs=1e-4)
    w = spark.createDataFrame([(1, 2, 6), (2, 3, 6), (3, 4, 6), (4, 6, 6), (5, 6, 6), (70000, 70001, 100003)], "u long, v long, n long").select(generated_weight(F.col("u"), F.col("v"), F.col("n")).alias("w")).collect()
    assert [r.w for r in w] == [1, 3, 1, 4, 3, 44558]
    big = spark.createDataFrame([([0xFFFFFFFF, 0], [1], [5])], "a array<long>, b array<long>, c array<long>").select(numeric.big_add("a", "b").alias("s"), numeric.big_subtract("b", "c").alias("d"), numeric.big_multiply("a", "a").alias("m")).first()
    assert (big.s, big.d, big.m) == ([0, 1], [2**32 - 4], [1, 0xFFFFFFFE, 0])
    x = spark.createDataFrame([(0, i, float(v), 0.0) for i, v in enumerate([1, 2, 3, 4])], "key int, idx long, re double, im double")
    assert [(round(r.re), round(r.im)) for r in numeric.fft(x).orderBy("idx").collect()] == [(10, 0), (-2, 2), (-2, 0), (-2, -2)]
    p = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(40)], "idx long, v array<double>")
    centres, _ = numeric.kmeans(p, 2)
    assert sorted(round(c[0]) for c in centres) == [0, 10]
    near = {r.id: r.neighbours for r in numeric.knn(spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0])], "id long, v array<double>"), 3).collect()}
    assert near == {1: [-1, 3, 2], 2: [-1, 3, 1], 3: [-1, 1, 2]}


def test_geometry(spark):
    rng = random.Random(2)
    pts = [(i, rng.random(), rng.random(), rng.random()) for i in range(80)]
    got = {(r.a, r.b) for r in geometry.radius_pairs(spark.createDataFrame(pts, "id long, x double, y double, z double"), 0.2).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] != q[0] and sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) < 0.04}
    boxes = [(i, x, x + rng.random(), y, y + rng.random()) for i in range(60) for x, y in [(rng.uniform(-3, 3), rng.uniform(-3, 3))]] + [(90, 0.0, 1.0, 0.0, 1.0), (91, 1.0, 2.0, 0.0, 1.0)]
    got = sorted((r.a, r.b) for r in geometry.box_overlaps(spark.createDataFrame(boxes, "id long, x0 double, x1 double, y0 double, y1 double"), 0.7).collect())
    assert got == sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] < b[2] and b[1] < a[2] and a[3] < b[4] and b[3] < a[4])
    hull = geometry.upper_hull(spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 2.0), (2, 2.0, 1.0), (3, 3.0, 0.0), (4, 1.5, 0.5)], "idx long, x double, y double"))
    assert [r.idx for r in hull.orderBy("x").collect()] == [0, 1, 3]


def test_files(spark, tmp_path):
    (tmp_path / "g.edges").write_text("4 6\n0 1\n1 0\n1 2\n2 1\n2 3\n3 2\n")
    assert sorted(map(tuple, graphs.read_edge_text(spark, f"{tmp_path}/g.edges").collect())) == [(0, 1), (1, 2), (2, 3)]
    (tmp_path / "g.bin").write_bytes(graphs.csr_bytes([(0, 1), (1, 2), (2, 3)], 4))
    assert sorted(map(tuple, graphs.read_csr(spark, f"{tmp_path}/g.bin").collect())) == [(0, 1), (1, 2), (2, 3)]
    (tmp_path / "g.mtx").write_text("%%MatrixMarket\n% c\n6 6 3\n2 1 3.7\n2 3\n6 4 9\n")
    assert [tuple(r) for r in graphs.read_matrix_market(spark, f"{tmp_path}/g.mtx").orderBy("eid").collect()] == [(0, 0, 1, 3), (1, 1, 2, 3), (2, 3, 5, 9)]
    (tmp_path / "a.txt").write_text("WeightedAdjacencyGraph\n3\n3\n0\n2\n2\n1\n2\n0\n.5\n1\n2\n")
    assert sorted(map(tuple, graphs.read_adjacency(spark, f"{tmp_path}/a.txt").collect())) == [(0, 1, 0.5), (0, 2, 1.0), (2, 0, 2.0)]
    graphs.write_edge_array(spark.createDataFrame([(0, 1, 2.5), (1, 2, 3.0)], "src long, dst long, w double").coalesce(1), f"{tmp_path}/ea")
    graphs.write_sequence(seq_of(spark, [5, 3, 9]), f"{tmp_path}/s")
    assert values(graphs.read_sequence(spark, f"{tmp_path}/s")) == [5, 3, 9]
    (tmp_path / "p").write_text("pbbs_sequencePoint2d\n0 1\n2 3.5\n")
    assert [tuple(r) for r in graphs.read_points(spark, f"{tmp_path}/p").orderBy("idx").collect()] == [(0, 0.0, 1.0), (1, 2.0, 3.5)]


def test_folds(spark, tmp_path):
    rng = random.Random(5)
    edges = [(i, rng.randrange(30), rng.randrange(30), rng.randrange(9)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(edges[k * 20 : k * 20 + 20], "eid long, u long, v long, w long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    df = spark.createDataFrame(edges, "eid long, u long, v long, w long")
    fold = ForestFold(spark, f"{tmp_path}/state")
    stream = spark.readStream.schema("eid long, u long, v long, w long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert fold.batches() == [0, 1, 2]
    fold(spark.read.parquet(f"{tmp_path}/in/2"), 2)  # a replay
    assert Counter(map(tuple, fold.state().collect())) == Counter(map(tuple, msf.minimum_spanning_forest(df).collect()))
    cc = ComponentsFold(spark, f"{tmp_path}/cc")
    for k in range(3):
        cc(df.where(f"eid div 20 = {k}").select(F.col("u").alias("src"), F.col("v").alias("dst")), k)
    assert {tuple(r) for r in cc.state().collect()} == {tuple(r) for r in components.star_edges(df, "u", "v").collect()}
