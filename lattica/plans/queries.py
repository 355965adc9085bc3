"""Queries over the test tables, by key. Their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.portable import MULTIPLIER, PRIME, pack, unpack
from lattica.operators import arrays, exchange, generators, graph, strategies
from lattica.operators import matrix as mx
from lattica.operators.components import components
from lattica.operators.numbering import numbered, running_sum
from lattica.plans import inputs
from lattica.plans.inputs import PES
from lattica.plans.oracle import ORACLE_SQL
from lattica.session import cut, free, scratch, table
from lattica.sources import dataset, matrix_market
from lattica.streaming import steady

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


# scatter and reductions


@query
def histogram(spark, d):
    return arrays.histogram(inputs.updates(spark, d))


@query
def histogram_dense(spark, d):
    return arrays.histogram_dense(inputs.updates(spark, d), inputs.rows(spark, d, "part"))


@query
def histogram_weighted(spark, d):
    return arrays.scatter_add(table(spark, d, "lineitem").select(F.col("l_partkey").alias("idx"), "l_orderkey"), "l_orderkey")


@query
def histogram_peak(spark, d):
    bins = inputs.rows(spark, d, "part")
    top = arrays.peak(arrays.histogram(inputs.updates(spark, d)), bins)
    return top.select("idx", "cnt", F.round("significance", 6).alias("significance"))


@query
def row_counts(spark, d):
    return dataset.row_counts(inputs.matrix(spark, d))


@query
def col_counts(spark, d):
    return inputs.matrix(spark, d).col_counts()


@query
def row_sums(spark, d):
    return inputs.matrix(spark, d).entries.groupBy("row").agg(F.sum("col").alias("rowsum"))


@query
def wedge_stats(spark, d):
    n = inputs.rows(spark, d, "part")
    return graph.wedge_stats(mx.Matrix(inputs.graph(spark, d), n, n))


@query
def reduce_all(spark, d):
    price = F.col("l_extendedprice")
    key = F.col("l_partkey")
    return table(spark, d, "lineitem").agg(
        F.sum(key).alias("sum_l"), F.min(key).alias("min_l"), F.max(key).alias("max_l"),
        F.round(F.sum(price.cast("decimal(20,2)")), 2).cast("double").alias("sum_d"), F.min(price).alias("min_d"), F.max(price).alias("max_d"),
    )


@query
def reduce_bitor(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bit_or("l_partkey").alias("bits"))


@query
def reduce_bitand(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bit_and("l_partkey").alias("bits"))


@query
def min_avg_max(spark, d):
    counts = arrays.histogram(inputs.updates(spark, d))
    got = arrays.min_avg_max(counts, "cnt", inputs.rows(spark, d, "part"))
    return got.select("min", "avg_int", F.round("avg", 6).alias("avg"), "max")


@query
def exchange_checksum(spark, d):
    sent = inputs.messages(spark, d)
    check = lambda m, name: m.agg(arrays.exchange_checksum(F.col("seq"), F.col("src"), F.col("l_orderkey")).alias(name))
    return check(sent, "sent").crossJoin(check(exchange.deliver(sent), "received"))


@query
def gather_checksum(spark, d):
    slot = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("slot")
    requests = table(spark, d, "lineitem").select(slot, F.col("l_partkey").alias("idx"))
    values = inputs.part_ids(spark, d).select("idx", ((F.col("idx").cast("decimal(19,0)") * MULTIPLIER) % PRIME).cast("long").alias("val"))
    sent = requests.agg(arrays.gather_checksum(F.col("slot"), F.col("idx")).alias("sent"))
    total = F.sum(((F.col("slot") + 1).cast("decimal(20,0)") * F.col("val").cast("decimal(17,0)")).cast("decimal(38,0)"))
    return sent.crossJoin(arrays.gather(requests, values).agg((total % PRIME).cast("long").alias("received")))


# gather


@query
def index_gather(spark, d):
    requests = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("idx"))
    return arrays.gather(requests, inputs.part_ids(spark, d).withColumn("val", -(F.col("idx") + 1)))


@query
def index_gather_wide(spark, d):
    requests = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("idx"))
    values = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), "p_name", "p_size", "p_retailprice")
    return arrays.gather(requests, values)


@query
def gather_roundtrip(spark, d):
    perm = generators.rand_perm(inputs.part_ids(spark, d), 42)
    there = arrays.gather(inputs.updates(spark, d), perm)
    back = arrays.gather(there.select(F.col("idx").alias("start"), F.col("newpos").alias("idx")), mx.invert(perm))
    return back.agg(F.count("*").alias("requests"), F.count_if(F.col("start") != F.col("newpos")).alias("astray"))


@query
def edge_membership(spark, d):
    edges = inputs.graph(spark, d)
    asked = edges.select("row", (F.col("col") + 1).alias("col")).distinct()
    return asked.join(edges, ["row", "col"], "left_semi")


@query
def point_put(spark, d):
    array = inputs.part_ids(spark, d).withColumn("val", F.col("idx") * 10)
    writes = inputs.supplier_ids(spark, d).select((F.col("idx") * 2).alias("idx"), F.col("idx").alias("val"))
    return arrays.put(array, writes)


@query
def block_get(spark, d):
    return arrays.block(table(spark, d, "part").select(F.col("p_partkey").alias("idx"), "p_size"), 50, 100)


@query
def claim_slots(spark, d):
    return arrays.claim(table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


# scans


@query
def prefix_sum_inclusive(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("x"))
    return running_sum(sizes, "total", "x", "idx").select("idx", "total")


@query
def prefix_sum_exclusive(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("x"))
    return running_sum(sizes, "total", "x", "idx", inclusive=False).select("idx", "total")


@query
def csr_offsets(spark, d):
    return running_sum(inputs.matrix(spark, d).row_counts(), "offset", "cnt", "row", inclusive=False).select("row", "offset")


@query
def ticket_numbers(spark, d):
    lines = arrays.tickets(table(spark, d, "lineitem"), "l_partkey", [F.col(c) for c in inputs.EVERY], F.floor(F.col("l_orderkey") / (1 << 16)))
    return lines.select("l_partkey", "l_orderkey", "l_linenumber", "ticket")


@query
def pack_index(spark, d):
    word = pack(F.col("idx"), PES)
    return inputs.part_ids(spark, d).select("idx", F.floor(F.col("idx") / PES).cast("long").alias("local"), (F.col("idx") % PES).alias("pe"), word.alias("word"), unpack(word, PES).alias("back"))


# matrices


@query
def transpose(spark, d):
    return inputs.matrix(spark, d).transpose().entries


@query
def transpose_csr(spark, d):
    return inputs.matrix(spark, d).transpose().csr().select("row", F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"))


@query
def tidy_rows(spark, d):
    return inputs.matrix(spark, d).csr().select("row", F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"))


@query
def row_explode(spark, d):
    return mx.row_explode(inputs.matrix(spark, d))


@query
def permute_matrix(spark, d):
    rows, cols = generators.rand_perm(inputs.part_ids(spark, d), 42), generators.rand_perm(inputs.supplier_ids(spark, d), 43)
    return inputs.matrix(spark, d).permute(rows, cols).entries


@query
def invert_perm(spark, d):
    return mx.invert(generators.rand_perm(inputs.part_ids(spark, d), 42))


@query
def tril(spark, d):
    return inputs.matrix(spark, d).tril(-1).entries


@query
def triu(spark, d):
    return inputs.matrix(spark, d).triu(1).entries


def _upper(spark, d):
    n = inputs.rows(spark, d, "part")
    return mx.Matrix(inputs.graph(spark, d).select(F.col("col").alias("row"), F.col("row").alias("col")), n, n)


@query
def is_upper_triangular(spark, d):
    return _upper(spark, d).triangular(upper=True)


@query
def is_lower_triangular(spark, d):
    return _upper(spark, d).triangular(upper=False)


@query
def is_unit_upper(spark, d):
    return inputs.dag(spark, d).triangular(upper=True, unit=True)


@query
def is_perm(spark, d):
    return mx.is_perm(generators.rand_perm(inputs.part_ids(spark, d), 42), inputs.rows(spark, d, "part"))


@query
def compare_matrix(spark, d):
    m = inputs.matrix(spark, d)
    same, other = m.compare(m.transpose().transpose()), m.compare(m.tril(0))
    return same.select(F.col("differs").alias("same")).crossJoin(other.select(F.col("differs").alias("other")))


@query
def matrix_union(spark, d):
    m = inputs.matrix(spark, d)
    return m.tril(0).union(m.triu(0)).entries


@query
def degree_one_rows(spark, d):
    return mx.degree_one(inputs.dag(spark, d))


# sources and sinks


@query
def mm_write_roundtrip(spark, d):
    path = scratch(spark, "mm")
    matrix_market.write(inputs.matrix(spark, d), path)
    return matrix_market.read(spark, path).entries


@query
def mm_read(spark, d):
    """A symmetric integer file with comments."""
    edges, n, path = inputs.edges(spark, d), inputs.rows(spark, d, "part"), scratch(spark, "mm")
    text = edges.select(F.concat_ws(" ", (F.col("v") + 1).cast("string"), (F.col("u") + 1).cast("string"), F.lit("7")).alias("value"), F.lit(1).alias("o"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer symmetric\n% made of a graph\n" + f"{n} {n} {edges.count()}", 0)], "value string, o int")
    head.union(text).orderBy("o").coalesce(1).select("value").write.text(path)
    return matrix_market.read(spark, path).entries


@query
def dataset_roundtrip(spark, d):
    path = scratch(spark, "dataset")
    dataset.write(inputs.matrix(spark, d), path, 7)
    return dataset.read(spark, path).entries


@query
def block_partition_sizes(spark, d):
    return dataset.block_sizes(spark, inputs.rows(spark, d, "part"), 7)


# generators


@query
def rand_perm(spark, d):
    return generators.rand_perm(inputs.part_ids(spark, d), 42)


@query
def rand_perm_bucketed(spark, d):
    return generators.rand_perm_bucketed(inputs.part_ids(spark, d), 42)


@query
def er_graph(spark, d):
    """Geometric gaps: a random stream, so compared by its properties in the tests, not by SQL."""
    return generators.erdos_renyi(spark, inputs.rows(spark, d, "part"), 0.01, 12345, 1).entries


@query
def er_naive(spark, d):
    return generators.er_naive(spark, 300, 0.05, 7).entries


@query
def er_symmetric(spark, d):
    return generators.erdos_renyi(spark, 300, 0.05, 7, 0, diagonal=True, make=generators.er_naive).entries


@query
def er_asymmetric(spark, d):
    return generators.erdos_renyi(spark, 300, 0.05, 7, 3, make=generators.er_naive).entries


@query
def star_graph(spark, d):
    made = [generators.star(spark, 7, mode).entries.withColumn("mode", F.lit(mode)) for mode in (0, 1, 2)]
    return made[0].union(made[1]).union(made[2])


@query
def kron_product(spark, d):
    return generators.kron(generators.star(spark, 3, 1), generators.star(spark, 4, 2)).entries


@query
def kron_lower(spark, d):
    return generators.kron(generators.star(spark, 3, 1), generators.star(spark, 4, 2), lower=True).entries


@query
def kron_stars(spark, d):
    return generators.kron_stars(spark, [2, 3, 4], 1).entries


@query
def kron_triangles(spark, d):
    found = None
    for mode in (0, 1, 2):
        got = graph.triangle_count(generators.kron_stars(spark, [3, 4, 5], mode, lower=True).entries)
        row = got.select(F.lit(mode).alias("mode"), "triangles", F.lit(generators.kron_triangles(mode, [3, 4, 5])).cast("long").alias("closed"))
        found = row if found is None else found.union(row)
    return found


@query
def kron_spec(spark, d):
    """A spec's two halves as factors; the triangles counted and in closed form."""
    spec = "1 4 9 16 25"
    mode, first, second = generators.parse_spec(spec)
    product = generators.kron(generators.kron_stars(spark, first, mode), generators.kron_stars(spark, second, mode), lower=True)
    closed = generators.kron_triangles(mode, first + second)
    return graph.triangle_count(product.entries).select(F.lit(spec).alias("spec"), "triangles", F.lit(closed).cast("long").alias("closed"))


@query
def morally_triangular(spark, d):
    ids = inputs.supplier_ids(spark, d)
    upper = generators.er_naive(spark, inputs.rows(spark, d, "supplier"), 0.1, 7, lower=False, diagonal=True)
    return generators.morally_triangular(upper, ids, 5).entries


# graphs


@query
def triangle_count(spark, d):
    return graph.triangle_count(inputs.graph(spark, d))


@query
def triangle_count_alg0(spark, d):
    return graph.triangles_lower(inputs.graph(spark, d))


@query
def triangle_count_alg1(spark, d):
    return graph.triangles_upper(inputs.graph(spark, d))


@query
def triangle_count_push(spark, d):
    return graph.triangles_push(inputs.graph(spark, d))


@query
def triangle_count_pull(spark, d):
    return graph.triangles_pull(inputs.graph(spark, d))


@query
def triangle_strategies(spark, d):
    """All registered strategies on the same graph."""
    return strategies.compare("triangles", inputs.graph(spark, d)).select("strategy", "triangles")


@query
def toposort_levels(spark, d):
    """Levels of the DAG with rows and columns permuted, by original row."""
    ids = inputs.part_ids(spark, d)
    rows, cols = generators.rand_perm(ids, 1), generators.rand_perm(ids, 2)
    levels = graph.toposort_levels(inputs.dag(spark, d).permute(rows, cols))
    return levels.join(rows, levels["row"] == rows["newpos"]).select(F.col("idx").alias("row"), "level")


@query
def toposort_perm(spark, d):
    return graph.toposort_perm(graph.toposort_levels(inputs.dag(spark, d, repeats=True), repeats=True), inputs.rows(spark, d, "part"))


@query
def toposort_check(spark, d):
    ids = inputs.part_ids(spark, d)
    permuted = inputs.dag(spark, d).permute(generators.rand_perm(ids, 1), generators.rand_perm(ids, 2))
    m = mx.Matrix(cut(permuted.entries), permuted.numrows, permuted.numcols)
    free(spark)
    return graph.toposort_check(m, graph.toposort_perm(graph.toposort_levels(m), m.numrows))


@query
def level_rank(spark, d):
    levels = graph.toposort_levels(inputs.dag(spark, d, repeats=True), repeats=True)
    placed = numbered(levels, "place", [F.col("row")], F.floor(F.col("row") / (1 << 16)), by=["level"])
    return placed.select("row", "level", (F.col("place") + 1).alias("rank"))


@query
def components_(spark, d):
    return components(inputs.edges(spark, d))


QUERIES["components"] = QUERIES.pop("components_")


@query
def components_incremental(spark, d):
    edges = inputs.edges(spark, d)
    return steady.component_waves(spark, [edges.filter(F.col("u") % 3 == i) for i in range(3)])


@query
def refusals(spark, d):
    """(case, refused): inputs that operators and readers refuse with a ValueError."""
    ids = spark.range(2)
    pairs = lambda *p: mx.Matrix(spark.createDataFrame(list(p), "row long, col long"), 2, 2)

    def read(*lines):
        path = scratch(spark, "mm")
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        return matrix_market.read(spark, path)

    def short_dataset():
        path = scratch(spark, "dataset")
        dataset.write(pairs((0, 0), (1, 1)), path, 2)
        meta = spark.createDataFrame([(2, 2, 3, 2)], "numrows long, numcols long, nnz long, writers int")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
        return dataset.read(spark, path)

    cases = {
        "not morally triangular": lambda: graph.toposort_levels(pairs((0, 0), (0, 1), (1, 0), (1, 1))),
        "two rows with one column": lambda: graph.toposort_levels(pairs((0, 0), (1, 0))),
        "another banner": lambda: read("%%MatrixMarket matrix array real general", "2 2"),
        "fewer entries than declared": lambda: read("%%MatrixMarket matrix coordinate pattern general", "2 2 2", "1 1"),
        "an entry outside": lambda: read("%%MatrixMarket matrix coordinate pattern general", "2 2 1", "3 1"),
        "a dataset that lacks entries": short_dataset,
        "a spec without sizes": lambda: generators.parse_spec("1"),
        "an unknown strategy": lambda: strategies.run("triangles", "none", ids),
        "a sound matrix": lambda: graph.toposort_levels(pairs((0, 0), (0, 1), (1, 1))),
    }
    found = []
    for name, case in cases.items():
        try:
            case()
            found.append((name, False))
        except ValueError:
            found.append((name, True))
    return spark.createDataFrame(found, "case string, refused boolean").withColumnRenamed("case", "input")


# exchanges


@query
def fifo_exchange(spark, d):
    sent = inputs.messages(spark, d).select("src", "dest", "seq", "l_orderkey")
    got = exchange.fifo(exchange.deliver(sent), [F.col("seq")], F.floor(F.col("seq") / (1 << 16)))
    return got.select("src", "dest", "seq", "l_orderkey", "place")


@query
def exchange_stats(spark, d):
    return exchange.statistics(inputs.messages(spark, d))


@query
def exchange_observed(spark, d):
    """Counters that the exchange itself fills, from one pass."""
    sent = table(spark, d, "lineitem").select((F.col("l_partkey") % PES).alias("dest"), F.col("l_orderkey").cast("string").alias("payload"))
    delivered, before, after = exchange.observed(sent, "payload")
    delivered.write.format("noop").mode("overwrite").save()
    row = (before.get["pushes"], after.get["pulls"], before.get["bytes"], after.get["bytes"])
    return spark.createDataFrame([row], "pushes long, pulls long, bytes_sent long, bytes_received long")


@query
def alltoall_rejects(spark, d):
    """Receivers put back a fifth of what they pull, and pull it again."""
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") % PES).alias("dest"), "l_orderkey", "l_linenumber")
    return exchange.pulls(lines, [F.col("l_orderkey"), F.col("l_linenumber")], 0.2, 11)


@query
def alltoall_counts(spark, d):
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") % PES).alias("src"), (F.col("l_partkey") % PES).alias("dest"))
    return exchange.counts(lines)


@query
def alltoall_elastic(spark, d):
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") % PES).alias("dest"), F.col("l_orderkey").cast("string").alias("payload"))
    return exchange.volumes(lines, "payload")


@query
def steady_histogram(spark, d):
    path = f"{d}/events.parquet"
    return steady.steady_histogram(spark, path, spark.read.parquet(path).schema, "event_type")
