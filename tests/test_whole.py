"""Queries that take the whole of their tables, against brute force on them."""

from collections import Counter

import pytest

from lattica.plans import inputs
from lattica.plans.queries import QUERIES
from tests.test_operators import union_find


@pytest.fixture(scope="module")
def lines(duck):
    return duck.execute("SELECT l_orderkey, l_partkey FROM lineitem").fetchall()


@pytest.fixture(scope="module")
def edges(lines):
    """All (u, v), u < v, of parts that share an order."""
    orders = {}
    for order, part in lines:
        orders.setdefault(order, set()).add(part)
    return {(u, v) for parts in orders.values() for u in parts for v in parts if u < v}


@pytest.mark.parametrize("key", ["components", "components_incremental"])
def test_components_of_all_edges(spark, small, edges, key):
    got = {r.node: r.component for r in QUERIES[key](spark, small).collect()}
    assert got == union_find(sorted(edges))


def levels(edges, n):
    """Of each row, the longest path down from it."""
    out = [0] * n
    for u, v in sorted(edges, reverse=True):
        out[u] = max(out[u], out[v] + 1)
    return out


@pytest.fixture(scope="module")
def parts(duck):
    return duck.execute("SELECT count(*) FROM part").fetchone()[0]


def test_mm_read_of_all_edges(spark, small, edges):
    got = {(r.row, r.col) for r in QUERIES["mm_read"](spark, small).collect()}
    assert got == edges | {(v, u) for u, v in edges}


def test_degree_one_rows_of_all_edges(spark, small, edges, parts):
    got = {(r.row, r.col) for r in QUERIES["degree_one_rows"](spark, small).collect()}
    assert got == {(i, i) for i in set(range(parts)) - {u for u, _ in edges}}


def test_dag_has_all_edges(spark, small, edges, parts):
    got = [(r.row, r.col) for r in inputs.dag(spark, small).entries.collect()]
    assert len(got) == len(edges) + parts and set(got) == edges | {(i, i) for i in range(parts)}
    assert QUERIES["is_unit_upper"](spark, small).first().ok == 1


def test_toposort_levels_of_all_edges(spark, small, edges, parts):
    want = levels(edges, parts)
    assert {r.row: r.level for r in QUERIES["toposort_levels"](spark, small).collect()} == dict(enumerate(want))


def test_histogram_dense_counts_all_updates(spark, small, lines, parts):
    got = {r.idx: r.cnt for r in QUERIES["histogram_dense"](spark, small).collect()}
    want = Counter(part for _, part in lines)
    assert got == {i: want[i] for i in range(parts)} and sum(got.values()) == len(lines)
