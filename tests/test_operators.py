"""Properties, closed forms and small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import arrays, exchange, generators, graph, strategies
from lattica.operators import matrix as mx
from lattica.operators.components import components
from lattica.operators.numbering import numbered, running_sum
from lattica.sources import dataset, matrix_market


def coo(spark, pairs, nr, nc=None):
    return mx.Matrix(spark.createDataFrame(pairs, "row long, col long"), nr, nc or nr)


def pairs(m):
    return sorted(map(tuple, m.entries.collect()))


FULL = [(i, j) for i in range(3) for j in range(3)]
K4 = [(i, j) for i in range(4) for j in range(i)]


def test_empty_matrix(spark):
    m = coo(spark, [], 0)
    assert pairs(m.transpose()) == [] and m.row_counts().count() == 0
    assert graph.triangle_count(m.entries).first()[0] == 0
    assert graph.toposort_levels(m).count() == 0
    assert m.compare(m).first()[0] == 0
    assert components(m.entries, "row", "col").count() == 0


def test_single_loop(spark):
    m = coo(spark, [(0, 0)], 1)
    assert m.triangular(True, True).first()[0] == 1 and m.triangular(False, True).first()[0] == 1
    assert graph.triangle_count(m.tril(-1).entries).first()[0] == 0


@pytest.mark.parametrize("k,lower,upper", [(-1, 3, 8), (0, 6, 6), (1, 8, 3)])
def test_triangles_of_full_matrix(spark, k, lower, upper):
    m = coo(spark, FULL, 3)
    assert len(pairs(m.tril(k))) == lower and len(pairs(m.triu(k))) == upper


@pytest.mark.parametrize("count", [graph.triangle_count, graph.triangles_lower, graph.triangles_upper, graph.triangles_push, graph.triangles_pull])
def test_triangle_strategies_agree(spark, count):
    assert count(coo(spark, K4, 4).entries).first()[0] == 4
    assert count(coo(spark, [(1, 0), (2, 0), (2, 1)], 3).entries).first()[0] == 1
    g = generators.erdos_renyi(spark, 60, 0.2, 3, 1, make=generators.er_naive)
    a = np.zeros((60, 60), int)
    for r, c in pairs(g):
        a[r, c] = a[c, r] = 1
    assert count(g.entries).first()[0] == np.trace(a @ a @ a) // 6


@pytest.mark.parametrize("sizes,want", [([3, 4], (0, 12, 1)), ([3, 4, 5], (0, 287, 7)), ([2, 3, 4, 2], (0, 972, 35))])
def test_kronecker_closed_forms(spark, sizes, want):
    for mode in (0, 1, 2):
        assert generators.kron_triangles(mode, sizes) == want[mode]
        if len(sizes) < 4:
            assert graph.triangle_count(generators.kron_stars(spark, sizes, mode, lower=True).entries).first()[0] == want[mode]


def test_kronecker_spec():
    assert generators.parse_spec("1 4 9 16 25") == (1, [4, 9], [16, 25])
    assert generators.kron_triangles(1, [4, 9, 16, 25]) == 214873
    for bad in ("3 4", "1", "0 0"):
        with pytest.raises(ValueError):
            generators.parse_spec(bad)


@pytest.mark.parametrize("mode,nnz", [(0, 8), (1, 9), (2, 9)])
def test_star(spark, mode, nnz):
    assert generators.star(spark, 4, mode).nnz() == nnz


def test_transpose_and_permute_invert(spark):
    m = coo(spark, [(0, 1), (2, 0), (4, 3)], 5, 4)
    assert pairs(m.transpose().transpose()) == pairs(m)
    ids, cols = spark.range(5).withColumnRenamed("id", "idx"), spark.range(4).withColumnRenamed("id", "idx")
    r, c = generators.rand_perm(ids, 1), generators.rand_perm(cols, 2)
    there = m.permute(r, c)
    assert there.compare(m).first()[0] == 1
    assert there.permute(mx.invert(r), mx.invert(c)).compare(m).first()[0] == 0
    assert m.compare(mx.Matrix(m.entries, 5, 5)).first()[0] == 1


@pytest.mark.parametrize("make", [generators.rand_perm, generators.rand_perm_bucketed])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_random_permutations(spark, make, n):
    perm = make(spark.range(n).withColumnRenamed("id", "idx"), 7)
    assert mx.is_perm(perm, n).first()[0] == 1
    if n > 1:
        assert mx.is_perm(perm.withColumn("newpos", F.greatest("newpos", F.lit(1))), n).first()[0] == 0
        assert mx.is_perm(perm, n - 1).first()[0] == 0


def test_erdos_renyi(spark):
    assert generators.er_triangle(spark, 5, 0.0, 1, diagonal=True).nnz() == 5
    assert pairs(generators.er_triangle(spark, 5, 1.0, 1)) == [(i, j) for i in range(5) for j in range(i)]
    g = generators.er_triangle(spark, 400, 0.1, 1)
    got = pairs(g)
    assert got == pairs(generators.er_triangle(spark, 400, 0.1, 1)) and len(set(got)) == len(got)
    assert all(0 <= c < r < 400 for r, c in got)
    assert abs(len(got) - 7980) < 5 * (79800 * 0.09) ** 0.5
    first = sum(c == 0 for _, c in got)  # the first cell of a row is as likely as any
    assert 15 < first < 70
    both = generators.erdos_renyi(spark, 50, 0.2, 1, 0, diagonal=True)
    assert pairs(both) == pairs(both.transpose()) and sum(r == c for r, c in pairs(both)) == 50


def test_toposort_chain(spark):
    n = 12
    m = coo(spark, [(i, i) for i in range(n)] + [(i, i + 1) for i in range(n - 1)], n)
    levels = graph.toposort_levels(m)
    assert {r.row: r.level for r in levels.collect()} == {i: n - 1 - i for i in range(n)}
    assert graph.toposort_check(m, graph.toposort_perm(levels, n)).first()[0] == 1


def test_toposort_of_permuted_input(spark):
    ids = spark.range(40).withColumnRenamed("id", "idx")
    m = generators.morally_triangular(generators.er_naive(spark, 40, 0.1, 5, lower=False, diagonal=True), ids, 3)
    perm = graph.toposort_perm(graph.toposort_levels(m), 40)
    assert graph.toposort_check(m, perm).first()[0] == 1
    wrong = perm.withColumn("pos", (F.col("pos") + 1) % 40)
    assert graph.toposort_check(m, wrong).first()[0] == 0


@pytest.mark.parametrize("local", [None, 0, 60])
def test_toposort_refuses(spark, local):
    with pytest.raises(ValueError, match="morally"):
        graph.toposort_levels(coo(spark, [(0, 0), (0, 1), (1, 0), (1, 1)], 2), local)
    with pytest.raises(ValueError, match="singular"):
        graph.toposort_levels(coo(spark, [(0, 0), (1, 0)], 2), local)
    with pytest.raises(ValueError, match="morally"):  # row 2 loses both its columns at once
        graph.toposort_levels(coo(spark, [(0, 0), (1, 1), (2, 0), (2, 1)], 3), local)


@pytest.mark.parametrize("local", [0, 70])
def test_toposort_by_levels_and_in_memory(spark, local):
    ids = spark.range(30).withColumnRenamed("id", "idx")
    m = generators.morally_triangular(generators.er_naive(spark, 30, 0.15, 5, lower=False, diagonal=True), ids, 3)
    found = lambda levels: sorted(map(tuple, levels.select("row", "col", "level").collect()))
    assert found(graph.toposort_levels(m, local)) == found(graph.toposort_levels(m))


def test_strategies(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "row long, col long")
    strategies.register("triangles", "mine", lambda e: e.agg((F.count("*") / 3).cast("long").alias("triangles")))
    try:
        got = {r.strategy: r.triangles for r in strategies.compare("triangles", edges).collect()}
        assert got == dict.fromkeys(["lower", "mine", "pull", "push", "upper", "wedges"], 1)
        with pytest.raises(ValueError, match="already"):
            strategies.register("triangles", "mine", graph.triangle_count)
    finally:
        strategies.unregister("triangles", "mine")
    with pytest.raises(ValueError, match="no strategy"):
        strategies.run("triangles", "mine", edges)
    with pytest.raises(ValueError, match="no kernel"):
        strategies.run("squares", "mine", edges)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from lattica import session

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_folder(Session())
    assert session.shared_folder(spark)


def test_dropped_tables_are_gone(spark):
    from lattica.session import cut, drop, written

    since = written()
    a, b = cut(spark.range(5)), cut(spark.range(7))
    drop(spark, since, keep=1)
    assert b.count() == 7 and written() == since + 1
    with pytest.raises(Exception, match="(?i)not.?exist"):
        a.count()
    drop(spark, since)


def test_triangles_of_ids_that_do_not_fit_32_bits(spark):
    edges = [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 0)]
    for shift in (0, 1 << 40, -(1 << 33)):
        e = spark.createDataFrame([(a + shift, b + shift) for a, b in edges], "row long, col long")
        for count in (graph.triangle_count, graph.triangles_lower, graph.triangles_upper, graph.triangles_push, graph.triangles_pull):
            assert count(e).first().triangles == 2


@pytest.mark.parametrize("local", [0, 3, 1000])
def test_components_by_contraction_and_in_memory(spark, local):
    import random

    r = random.Random(local)
    edges = [(i, i + 1) for i in range(30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(35)] + [(200, 200)]
    got = components(spark.createDataFrame(edges, "u long, v long"), local=local)
    assert {x.node: x.component for x in got.collect()} == union_find(edges)


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))]
    edges += [(i + 1000, i + 1001) for i in range(200)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == union_find(edges)
    labels = spark.createDataFrame([], "node long, component long")
    for i in range(3):
        labels = graph.components_incremental(labels, spark.createDataFrame(edges[i::3], "u long, v long"))
    assert {r.node: r.component for r in labels.collect()} == union_find(edges)


def test_histogram_counts_all(spark):
    up = spark.createDataFrame([(i % 7,) for i in range(100)], "idx long")
    dense = {r.idx: r.cnt for r in arrays.histogram_dense(up, 10).collect()}
    assert sum(dense.values()) == 100 and dense[9] == 0 and len(dense) == 10
    top = arrays.peak(arrays.histogram(up), 10).first()
    assert (top.idx, top.cnt) == (0, 15)  # the first of equals


def test_scans(spark):
    x = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 5).alias("x"))
    got = {r.i: r.s for r in running_sum(x, "s", "x", "i", size=64).collect()}
    assert all(got[i] == sum(j % 5 for j in range(i + 1)) for i in (0, 63, 64, 500, 999))
    rank = numbered(x, "n", [F.col("i")], F.floor(F.col("i") / 100), by=["x"]).collect()
    assert all(r.n == r.i // 5 for r in rank)


def test_fifo_keeps_the_order_of_each_pair(spark):
    sent = spark.createDataFrame([(i % 2, i % 3, i) for i in range(60)], "src long, dest long, seq long")
    got = exchange.fifo(exchange.deliver(sent), [F.col("seq")], F.floor(F.col("seq") / 16)).collect()
    assert all(r.place == r.seq // 6 for r in got) and len(got) == 60


def test_matrix_market(spark, tmp_path):
    m = coo(spark, [(0, 1), (2, 0)], 3, 2)
    matrix_market.write(m, str(tmp_path / "a"))
    back = matrix_market.read(spark, str(tmp_path / "a"))
    assert (pairs(back), back.numrows, back.numcols) == (pairs(m), 3, 2)

    def read(text):
        (tmp_path / "b").write_text(text)
        return matrix_market.read(spark, str(tmp_path / "b"))

    assert pairs(read("%%MatrixMarket matrix coordinate integer symmetric\n%c\n\n2 2 2\n1 1 5\n2 1 3\n")) == [(0, 0), (0, 1), (1, 0)]
    assert pairs(read("%%MatrixMarket matrix coordinate pattern general\n2 2 0\n")) == []
    for bad in ("%%MatrixMarket matrix coordinate real general\n1 1 0\n", "%%MatrixMarket matrix array integer\n1 1\n", "%%MatrixMarket matrix coordinate pattern\n2 2 2\n1 1\n", "%%MatrixMarket matrix coordinate pattern\n1 1 1\n2 1\n", ""):
        with pytest.raises(ValueError):
            read(bad)


@pytest.mark.parametrize("writers", [1, 3, 20])
def test_dataset(spark, tmp_path, writers):
    m = coo(spark, [(i, i % 4) for i in range(10)], 10, 4)
    dataset.write(m, str(tmp_path / "d"), writers)
    back = dataset.read(spark, str(tmp_path / "d"))
    assert pairs(back) == pairs(m) and dataset.metadata(spark, str(tmp_path / "d")) == (10, 4, 10, writers)
    sizes = dataset.block_sizes(spark, 10, writers).collect()
    assert sum(r.rows for r in sizes) == 10
    written = spark.read.parquet(str(tmp_path / "d/nonzero")).collect()
    first = {r.writer: (r.first_row, r.first_row + r.rows) for r in sizes}
    assert all(first[r.writer][0] <= r.row < first[r.writer][1] for r in written)


def test_checksums_see_loss_and_alteration(spark):
    m = spark.createDataFrame([(i, i % 3, i * i) for i in range(50)], "seq long, src long, word long")
    check = lambda d: d.agg(arrays.exchange_checksum(F.col("seq"), F.col("src"), F.col("word"))).first()[0]
    assert check(m) == sum((2 * i + 2 * (i % 3) + 1) * i * i for i in range(50)) == check(m.repartition(7))
    assert check(m) != check(m.filter("seq <> 9")) and check(m) != check(m.withColumn("word", F.col("word") + 1))


def test_put_block_claim(spark):
    a = spark.range(10).select(F.col("id").alias("idx"), F.col("id").alias("val"))
    w = spark.createDataFrame([(3, None), (5, 50)], "idx long, val long")
    assert {r.idx: r.val for r in arrays.put(a, w).collect()}[5] == 50
    assert {r.idx: r.val for r in arrays.put(a, w).collect()}[3] is None
    assert sorted(r.idx for r in arrays.block(a, 4, 3).collect()) == [4, 5, 6]


@pytest.mark.parametrize("block", [1 << 22, 300, 40])
def test_triangles_beyond_a_broadcast_exchange_rows_not_wedges(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 100)
    monkeypatch.setattr(graph, "BLOCK", block, raising=False)
    rng = np.random.default_rng(4)
    star = [(0, i) for i in range(1, 400)] + [(400 + i, 400 + j) for i in range(20) for j in range(i)]
    edges = sorted({(max(a, b), min(a, b)) for a, b in [*star, *map(tuple, rng.integers(300, 500, (900, 2)).tolist())] if a != b})
    a = np.zeros((500, 500), int)
    for r, c in edges:
        a[r, c] = a[c, r] = 1
    e = coo(spark, edges, 500).entries
    for count in (graph.triangle_count, graph.triangles_lower, graph.triangles_upper, graph.triangles_push, graph.triangles_pull):
        assert count(e).first().triangles == np.trace(a @ a @ a) // 6


def test_triangles_of_a_clique_shuffle_little(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 100)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    m = 150
    e = coo(spark, [(i, j) for i in range(m) for j in range(i)], m).entries
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for count in (graph.triangles_lower, graph.triangles_upper, graph.triangle_count):
            before = sent()
            assert count(e).first().triangles == m * (m - 1) * (m - 2) // 6
            assert sent() - before < 600_000, count.__name__  # 551,300 wedges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_toposort_of_many_entries_needs_no_pass_a_level(spark, monkeypatch):
    from lattica import session

    monkeypatch.setattr(graph, "LOCAL_ENTRIES", 50)
    m = coo(spark, [(i, i) for i in range(40)] + [(i, j) for i in range(40) for j in range(i + 1, min(40, i + 4))], 40)
    since = session.written()
    levels = graph.toposort_levels(m)
    assert {r.row: r.level for r in levels.collect()} == {i: 39 - i for i in range(40)}
    assert session.written() - since == 1


def test_toposort_passes_keep_one_table_of_live_entries(spark):
    from lattica import session

    m = coo(spark, [(i, i) for i in range(6)] + [(i, i + 1) for i in range(5)], 6)
    since = session.written()
    assert {r.row: r.level for r in graph.toposort_levels(m, 0).collect()} == {i: 5 - i for i in range(6)}
    assert session.written() - since == 6 + 1  # rows by level, and what is live


def test_permute_broadcasts_the_permutations_not_the_entries(spark):
    ids = spark.range(50).withColumnRenamed("id", "idx")
    made = generators.morally_triangular(generators.er_naive(spark, 50, 0.5, 5, lower=False, diagonal=True), ids, 3)
    plan = made.entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2


def test_coins_on_arrays_are_those_of_sql(spark):
    import hashlib

    from lattica.functions.portable import u32_of_numbers

    for i, js, seed in ((7, range(10), 0), (12345, range(100, 1000), 7), (10**12, range(10**9, 10**9 + 50), 10**6)):
        digits = [np.array([int(str(j)[k]) for j in js]) for k in range(len(str(js[0])))]
        got = u32_of_numbers(f"{i}:".encode(), digits, f":{seed}".encode())
        assert got.tolist() == [int(hashlib.md5(f"{i}:{j}:{seed}".encode()).hexdigest()[:8], 16) for j in js]
    head = lambda i, j: int(hashlib.md5(f"{i}:{j}:7".encode()).hexdigest()[:8], 16)
    got = pairs(generators.er_naive(spark, 130, 0.1, 7))
    assert got == [(i, j) for i in range(130) for j in range(i) if head(i, j) < round(0.1 * 2**32)]
    for n, p, want in ((0, 0.5, 0), (1, 0.5, 0), (40, 0.0, 0), (40, 1.0, 780)):
        assert generators.er_naive(spark, n, p, 7).nnz() == want


def test_triangles_free_shuffle_files_before_rows_are_sent(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 100)
    done, cut, free, dealt = [], graph.cut, graph.free, graph._dealt
    for name, f in (("cut", cut), ("free", free), ("_dealt", dealt)):
        monkeypatch.setattr(graph, name, lambda *a, name=name, f=f: (done.append(name), f(*a))[1])
    drawn = spark.range(4000).select((F.col("id") % 400 + 1).alias("row"), (F.col("id") * 7 % 300).alias("col")).filter("row > col").distinct()
    a = np.zeros((500, 500), int)
    for r, c in drawn.collect():
        a[r, c] = a[c, r] = 1
    assert graph.triangles_upper(drawn).first().triangles == np.trace(a @ a @ a) // 6
    assert done == ["cut", "free", "cut", "cut", "free", "_dealt", "free"]  # edges; ranks and lists; rows sent


def test_lists_leave_out_repeated_pairs(spark):
    rng = np.random.default_rng(6)
    drawn = [(int(u), int(v)) for u, v in rng.integers(0, 40, (5000, 2))]
    got = {r.u: list(r.vs) for r in graph.lists(spark.createDataFrame(drawn, "u int, v int")).collect()}
    assert got == {u: sorted({v for x, v in drawn if x == u}) for u in {u for u, _ in drawn}}


@pytest.mark.parametrize("local, most", [(None, 1 << 29), (None, 0), (0, 1 << 29), (1 << 20, 1 << 29)])
def test_levels_of_repeated_entries(spark, monkeypatch, local, most):
    monkeypatch.setattr(graph, "LOCAL_BYTES", most)
    rng = np.random.default_rng(8)
    once = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (300, 2))} | {(i, i) for i in range(60)})
    again = mx.Matrix(coo(spark, once * 3, 60).entries, 60, 60)
    assert sorted(graph.toposort_levels(again, local, repeats=True).collect()) == sorted(graph.toposort_levels(coo(spark, once, 60)).collect())


def test_fewer_keeps_every_key(spark):
    from lattica.operators.numbering import fewer

    keys = spark.range(0, 30000, 1, 3).select((F.col("id") % 1000 - 500).alias("k"))
    assert sorted(r.k for r in fewer(keys).distinct().collect()) == list(range(-500, 500))
    assert fewer(keys).count() == 3000 and fewer(keys, 1).count() >= 3000
    assert fewer(keys.filter("k > 500")).count() == 0


def test_levels_of_a_table_exchange_lines_and_pairs_once(spark, small, monkeypatch):
    from lattica.plans import inputs

    plans = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    graph.toposort_levels(inputs.dag(spark, small, repeats=True), repeats=True)
    initial = plans[0].split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning(l_orderkey") == 2 and initial.count("Exchange hashpartitioning") == 3  # one a side (one is reused), one by column


def shuffled(spark):
    """Bytes written for exchanges so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("most", [1 << 29, 40 * 40_000])
def test_levels_exchange_a_few_bytes_an_entry(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "LOCAL_BYTES", most)  # the second holds the ends, not the entries
    n = 20_000
    drawn = spark.range(1_000_000).select((F.xxhash64("id") % n).alias("a"), (F.xxhash64(-F.col("id")) % n).alias("b")).select(F.abs("a").alias("a"), F.abs("b").alias("b"))
    upper = drawn.filter("a < b").select(F.col("a").alias("row"), F.col("b").alias("col")).union(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col")))
    upper = upper.unionAll(upper.filter("row % 2 = 0"))
    want, before = [0] * n, shuffled(spark)
    levels = graph.toposort_levels(mx.Matrix(upper, n, n), repeats=True)
    written, entries = shuffled(spark) - before, sorted({tuple(r) for r in upper.collect()}, reverse=True)
    for r, c in entries:
        if r < c:
            want[r] = max(want[r], want[c] + 1)
    assert {r.row: (r.col, r.level) for r in levels.collect()} == {i: (i, level) for i, level in enumerate(want)}
    assert most < 1 << 29 or written < 5 * len(entries)


def test_packed_pairs_come_back(spark):
    rng = np.random.default_rng(9)
    drawn = {(0, 0), (0, (1 << 31) - 1), (1, 0), (graph.PACKS, 0), (graph.PACKS, 5), (13_000_000, 7), (13_000_000, 13_000_000)}
    drawn |= {(int(u), int(v)) for u, v in rng.integers(0, 3000, (4000, 2))} | {(17, v) for v in range(5000)}
    rows = [pair for pair in drawn for _ in range(2)]
    made = graph.packed(spark.createDataFrame(rows, "u int, v int").repartition(3))
    assert made.agg(F.sum("n")).first()[0] == len(drawn)
    assert sorted((r.col, r.row) for r in made.mapInArrow(graph._entries, "row long, col long").collect()) == sorted(drawn)
    assert graph.packed(spark.createDataFrame([], "u int, v int")).count() == 0


@pytest.mark.parametrize("most", [1, 7, 1 << 21])
def test_packing_leaves_out_repeats_a_part_at_a_time(most):
    import pyarrow as pa

    rng = np.random.default_rng(10)
    drawn = [rng.integers(0, 50, (k, 2)).astype(np.int32) for k in (5, 0, 1, 40, 300)]
    got = list(graph._packed(most)(pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1])], ["u", "v"]) for d in drawn))
    every = sorted((at, n, block) for b in got for at, n, block in zip(*(b.column(c).to_pylist() for c in ("at", "n", "block")), strict=True))
    parts = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*every[k : k + 3], strict=True)], ["at", "n", "block"]) for k in range(0, len(every), 3)]
    merged = list(graph._merged(iter(parts)))
    back = [(int(u), int(v)) for us, vs, _ in graph._blocks(iter(merged)) for u, v in zip(us, vs, strict=True)]
    assert sorted(back) == sorted({tuple(map(int, p)) for d in drawn for p in d})
