"""The queries' SQL, by key."""

M = 'm AS (SELECT DISTINCT l_partkey AS "row", l_suppkey AS col FROM lineitem)'
#: Parts that share an order: all edges of the part graph.
E = 'e AS (SELECT DISTINCT a.l_partkey AS "row", b.l_partkey AS col FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey > b.l_partkey)'
T = f'{E}, t AS (SELECT col AS u, "row" AS v FROM e)'
N = "(SELECT count(*) FROM part)"


def u32(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def perm(name: str, table: str, key: str, seed: int) -> str:
    return f"{name} AS (SELECT {key} AS idx, row_number() OVER (ORDER BY md5(concat({key}, ':', {seed})), {key}) - 1 AS newpos FROM {table})"


def cells(name: str, n: str, p: float, seed: int, lower: bool) -> str:
    pick = 'i AS "row", j AS col' if lower else 'j AS "row", i AS col'
    return f"{name} AS (SELECT {pick} FROM range({n}) a(i), range({n}) b(j) WHERE j < i AND {u32(f"concat(i, ':', j, ':', {seed})")} < {round(p * 2**32)})"


def star(name: str, m: int, mode: int) -> str:
    loop = f' UNION ALL SELECT {0 if mode == 1 else m}, {0 if mode == 1 else m}' if mode else ""
    return f'{name} AS (SELECT i AS "row", 0::BIGINT AS col FROM range(1, {m + 1}) r(i) UNION ALL SELECT 0, i FROM range(1, {m + 1}) r(i){loop})'


def kron(b: str, c: str, size: int) -> str:
    return f'SELECT b."row" * {size} + c."row" AS "row", b.col * {size} + c.col AS col FROM {b} b, {c} c'


_EVERY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
MESSAGES = f"g AS (SELECT l_suppkey % 8 AS src, l_partkey % 8 AS dest, l_orderkey, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY {_EVERY}) - 1 AS seq FROM lineitem)"
LEVELS = f'{T}, reach(v, level) AS (SELECT p_partkey, 0 FROM part UNION SELECT t.u, reach.level + 1 FROM reach JOIN t ON t.v = reach.v), lev AS (SELECT v AS "row", max(level)::BIGINT AS level FROM reach GROUP BY v)'
TRIANGLES = f"WITH {E} SELECT count(*) AS triangles FROM e a JOIN e b ON a.col = b.\"row\" JOIN e c ON c.\"row\" = a.\"row\" AND c.col = b.col"
COMPONENTS = f"""WITH RECURSIVE {T}, w AS (SELECT u, v FROM t UNION ALL SELECT v, u FROM t),
reach(node, component) USING KEY (node) AS (SELECT u, u FROM w GROUP BY u UNION
  SELECT w.v, min(reach.component) FROM reach JOIN w ON w.u = reach.node JOIN recurring.reach AS own ON own.node = w.v WHERE reach.component < own.component GROUP BY w.v)
SELECT node, component FROM reach"""


def mix32(x: str) -> str:
    """functions.portable.mix32 of an expression of 32 bits."""
    low = lambda x: f"(({x}) & 4294967295)"
    y = low(f"xor({x}, ({x}) >> 16) * 2146121005")
    return f"(SELECT xor(b, b >> 16) FROM (SELECT {low('xor(a, a >> 15) * 2221713035')} AS b FROM (SELECT {y} AS a)))"


_CSR = "array_to_string(list_transform(list_sort(list({0})), lambda x: x::VARCHAR), ',')"

ORACLE_SQL: dict[str, str] = {
    "histogram": "SELECT l_partkey AS idx, count(*) AS cnt FROM lineitem GROUP BY 1",
    "histogram_dense": "SELECT p_partkey AS idx, count(l_partkey) AS cnt FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "histogram_weighted": "SELECT l_partkey AS idx, sum(l_orderkey)::BIGINT AS total FROM lineitem GROUP BY 1",
    "histogram_peak": f"""
WITH h AS (SELECT l_partkey AS idx, count(*) AS cnt FROM lineitem GROUP BY 1), top AS (SELECT idx, cnt FROM h ORDER BY cnt DESC, idx LIMIT 1),
s AS (SELECT (SELECT sum(cnt) FROM h)::DOUBLE / {N} AS mean)
SELECT idx, cnt, round((SELECT sum(exp(-mean + (cnt + i) * ln(mean) - lgamma(cnt + i + 1))) FROM range(10) r(i), s) * {N}, 6) AS significance FROM top""",
    "row_counts": f'WITH {M} SELECT p_partkey AS "row", count(col) AS cnt FROM part LEFT JOIN m ON "row" = p_partkey GROUP BY 1',
    "col_counts": f"WITH {M} SELECT s_suppkey AS col, count(col) AS cnt FROM supplier LEFT JOIN m ON col = s_suppkey GROUP BY 1",
    "row_sums": f'WITH {M} SELECT "row", sum(col)::BIGINT AS rowsum FROM m GROUP BY 1',
    "wedge_stats": f"""
WITH {E}, r AS (SELECT "row" AS x, count(*) AS r FROM e GROUP BY 1), c AS (SELECT col AS x, count(*) AS c FROM e GROUP BY 1)
SELECT sum(coalesce(r, 0) * coalesce(c, 0))::BIGINT AS rc, sum(coalesce(r, 0) * (coalesce(r, 0) - 1) // 2)::BIGINT AS rr, sum(coalesce(c, 0) * (coalesce(c, 0) - 1) // 2)::BIGINT AS cc
FROM r FULL JOIN c USING (x)""",
    "reduce_all": "SELECT sum(l_partkey)::BIGINT AS sum_l, min(l_partkey) AS min_l, max(l_partkey) AS max_l, sum(l_extendedprice::DECIMAL(20, 2))::DOUBLE AS sum_d, min(l_extendedprice) AS min_d, max(l_extendedprice) AS max_d FROM lineitem",
    "reduce_bitor": "SELECT l_suppkey, bit_or(l_partkey) AS bits FROM lineitem GROUP BY 1",
    "reduce_bitand": "SELECT l_suppkey, bit_and(l_partkey) AS bits FROM lineitem GROUP BY 1",
    "min_avg_max": f"WITH h AS (SELECT count(*) AS cnt FROM lineitem GROUP BY l_partkey) SELECT min(cnt) AS min, (sum(cnt) // {N})::BIGINT AS avg_int, round(sum(cnt)::DOUBLE / {N}, 6) AS avg, max(cnt) AS max FROM h",
    "exchange_checksum": f"WITH {MESSAGES}, s AS (SELECT (sum((2 * seq + 2 * src + 1)::HUGEINT * l_orderkey) % 18446744073709551616)::DECIMAL(20, 0) AS s FROM g) SELECT s AS sent, s AS received FROM s",
    "gather_checksum": "WITH s AS (SELECT (((sum((l_orderkey * 8 + l_linenumber + 1)::HUGEINT * l_partkey) % 3690948119) * 2646891621) % 3690948119)::BIGINT AS s FROM lineitem) SELECT s AS sent, s AS received FROM s",
    "index_gather": "SELECT l_orderkey, l_linenumber, l_partkey AS idx, -(p_partkey + 1) AS val FROM lineitem JOIN part ON l_partkey = p_partkey",
    "index_gather_wide": "SELECT l_orderkey, l_linenumber, l_partkey AS idx, p_name, p_size, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey",
    "gather_roundtrip": "SELECT count(*) AS requests, 0::BIGINT AS astray FROM lineitem JOIN part ON l_partkey = p_partkey",
    "edge_membership": f'WITH {E}, q AS (SELECT DISTINCT "row", col + 1 AS col FROM e) SELECT "row", col FROM q SEMI JOIN e USING ("row", col)',
    "point_put": "SELECT p_partkey AS idx, coalesce(s_suppkey, p_partkey * 10) AS val FROM part LEFT JOIN supplier ON s_suppkey * 2 = p_partkey",
    "block_get": "SELECT p_partkey AS idx, p_size FROM part WHERE p_partkey >= 50 AND p_partkey < 150",
    "claim_slots": "SELECT l_partkey, min(l_orderkey) AS l_orderkey, count(*) AS claims FROM lineitem GROUP BY 1",
    "prefix_sum_inclusive": "SELECT p_partkey AS idx, sum(p_size) OVER (ORDER BY p_partkey)::BIGINT AS total FROM part",
    "prefix_sum_exclusive": "SELECT p_partkey AS idx, (sum(p_size) OVER (ORDER BY p_partkey) - p_size)::BIGINT AS total FROM part",
    "csr_offsets": f'WITH {M}, c AS (SELECT p_partkey AS "row", count(col) AS cnt FROM part LEFT JOIN m ON "row" = p_partkey GROUP BY 1) SELECT "row", (sum(cnt) OVER (ORDER BY "row") - cnt)::BIGINT AS "offset" FROM c',
    "ticket_numbers": f"SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY {_EVERY}) - 1 AS ticket FROM lineitem",
    "pack_index": "SELECT p_partkey AS idx, p_partkey // 8 AS local, p_partkey % 8 AS pe, (p_partkey // 8) * 65536 + p_partkey % 8 AS word, p_partkey AS back FROM part",
    "transpose": f'WITH {M} SELECT col AS "row", "row" AS col FROM m',
    "transpose_csr": f'WITH {M} SELECT col AS "row", {_CSR.format('"row"')} AS cols FROM m GROUP BY 1',
    "tidy_rows": f'WITH {M} SELECT "row", {_CSR.format("col")} AS cols FROM m GROUP BY 1',
    "row_explode": f'WITH {M} SELECT "row", row_number() OVER (PARTITION BY "row" ORDER BY col) - 1 AS pos, col FROM m',
    "permute_matrix": f'WITH {M}, {perm("r", "part", "p_partkey", 42)}, {perm("c", "supplier", "s_suppkey", 43)} SELECT r.newpos AS "row", c.newpos AS col FROM m JOIN r ON r.idx = m."row" JOIN c ON c.idx = m.col',
    "invert_perm": f"WITH {perm('r', 'part', 'p_partkey', 42)} SELECT newpos AS idx, idx AS newpos FROM r",
    "tril": f'WITH {M} SELECT * FROM m WHERE col - "row" <= -1',
    "triu": f'WITH {M} SELECT * FROM m WHERE col - "row" >= 1',
    "is_upper_triangular": f'WITH {E} SELECT (count(*) FILTER (WHERE "row" < col) = 0)::BIGINT AS ok FROM e',
    "is_lower_triangular": f'WITH {E} SELECT (count(*) FILTER (WHERE "row" > col) = 0)::BIGINT AS ok FROM e',
    "is_unit_upper": f"WITH {T} SELECT (count(*) FILTER (WHERE u > v) = 0)::BIGINT AS ok FROM t",
    "is_perm": f"WITH {perm('r', 'part', 'p_partkey', 42)} SELECT (count(DISTINCT newpos) = {N} AND min(newpos) = 0 AND max(newpos) = {N} - 1)::BIGINT AS ok FROM r",
    "compare_matrix": f'WITH {M} SELECT 0::BIGINT AS same, (count(*) FILTER (WHERE col > "row") > 0)::BIGINT AS other FROM m',
    "matrix_union": f"WITH {M} SELECT * FROM m",
    "degree_one_rows": f'WITH {T}, d AS (SELECT u AS "row", v AS col FROM t UNION SELECT p_partkey, p_partkey FROM part) SELECT "row", max(col) AS col FROM d GROUP BY 1 HAVING count(*) = 1',
    "mm_write_roundtrip": f"WITH {M} SELECT * FROM m",
    "mm_read": f'WITH {T} SELECT u AS "row", v AS col FROM t UNION SELECT v, u FROM t',
    "dataset_roundtrip": f"WITH {M} SELECT * FROM m",
    "block_partition_sizes": f"WITH b AS (SELECT i AS writer, ({N} + 7 - i - 1) // 7 AS rows FROM range(7) r(i)) SELECT writer, (sum(rows) OVER (ORDER BY writer) - rows)::BIGINT AS first_row, rows FROM b",
    "rand_perm": f"WITH {perm('r', 'part', 'p_partkey', 42)} SELECT * FROM r",
    "rand_perm_bucketed": f"SELECT p_partkey AS idx, row_number() OVER (ORDER BY {u32("concat(p_partkey, ':', 42, ':b')")} % 64, md5(concat(p_partkey, ':', 42, ':s')), p_partkey) - 1 AS newpos FROM part",
    "er_graph": f"""
WITH g AS (SELECT i, k, {mix32(f"xor({mix32('(i + 12345 * 2654435769) & 4294967295')}, k::UBIGINT)")} AS h FROM (SELECT unnest(range((SELECT count(*) FROM part)))::UBIGINT AS i), range(500) r(k)),
c AS (SELECT i, sum(floor(ln((h::DOUBLE + 0.5) / 4294967296) / ln(0.99)) + 1) OVER (PARTITION BY i ORDER BY k) - 1 AS col FROM g)
SELECT i::BIGINT AS "row", col::BIGINT AS col FROM c WHERE col < i""",
    "er_naive": f"WITH {cells('x', '300', 0.05, 7, True)} SELECT * FROM x",
    "er_symmetric": f'WITH {cells("x", "300", 0.05, 7, True)} SELECT "row", col FROM x UNION ALL SELECT col, "row" FROM x UNION ALL SELECT i, i FROM range(300) r(i)',
    "er_asymmetric": f'WITH {cells("x", "300", 0.05, 7, False)}, {cells("y", "300", 0.05, 8, True)} SELECT "row", col FROM x UNION ALL SELECT "row", col FROM y',
    "star_graph": f"WITH {star('a', 7, 0)}, {star('b', 7, 1)}, {star('c', 7, 2)} SELECT *, 0 AS mode FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c",
    "kron_product": f"WITH {star('x', 3, 1)}, {star('y', 4, 2)} {kron('x', 'y', 5)}",
    "kron_lower": f'WITH {star("x", 3, 1)}, {star("y", 4, 2)}, k AS ({kron("x", "y", 5)}) SELECT * FROM k WHERE col < "row"',
    "kron_stars": f"WITH {star('x', 2, 1)}, {star('y', 3, 1)}, {star('z', 4, 1)}, k AS ({kron('x', 'y', 4)}) {kron('k', 'z', 5)}",
    "kron_triangles": """
WITH m(x) AS (VALUES (3), (4), (5)), p AS (SELECT product(3 * x + 1) AS a, product(x + 1) AS b, count(*) AS k FROM m),
t AS (SELECT 0 AS mode, 0::BIGINT AS t UNION ALL SELECT 1, round(a / 6 - b / 2 + 1.0 / 3)::BIGINT FROM p UNION ALL SELECT 2, round(4 ** k / 6 - 2 ** (k - 1) + 1.0 / 3)::BIGINT FROM p)
SELECT mode, t AS triangles, t AS closed FROM t""",
    "kron_spec": """
WITH m(x) AS (VALUES (4), (9), (16), (25)), t AS (SELECT round(product(3 * x + 1) / 6 - product(x + 1) / 2 + 1.0 / 3)::BIGINT AS t FROM m)
SELECT '1 4 9 16 25' AS spec, t AS triangles, t AS closed FROM t""",
    "triangle_strategies": f"SELECT strategy, triangles FROM ({TRIANGLES}), (VALUES ('lower'), ('pull'), ('push'), ('upper'), ('wedges')) s(strategy)",
    "morally_triangular": f"""
WITH {cells("x", "(SELECT count(*) FROM supplier)", 0.1, 7, False)}, a AS (SELECT * FROM x UNION ALL SELECT s_suppkey, s_suppkey FROM supplier),
{perm("r", "supplier", "s_suppkey", 5)}, {perm("c", "supplier", "s_suppkey", 6)} SELECT r.newpos AS "row", c.newpos AS col FROM a JOIN r ON r.idx = a."row" JOIN c ON c.idx = a.col""",
    "triangle_count": TRIANGLES,
    "triangle_count_alg0": TRIANGLES,
    "triangle_count_alg1": TRIANGLES,
    "triangle_count_push": TRIANGLES,
    "triangle_count_pull": TRIANGLES,
    "toposort_levels": f'WITH RECURSIVE {LEVELS} SELECT "row", level FROM lev',
    "toposort_perm": f'WITH RECURSIVE {LEVELS} SELECT "row", "row" AS col, {N} - row_number() OVER (ORDER BY level, "row") AS pos FROM lev',
    "toposort_check": "SELECT 1::BIGINT AS ok",
    "level_rank": f'WITH RECURSIVE {LEVELS} SELECT "row", level, row_number() OVER (PARTITION BY level ORDER BY "row") AS rank FROM lev',
    "components": COMPONENTS,
    "components_incremental": COMPONENTS,
    "refusals": """
SELECT input, input <> 'a sound matrix' AS refused FROM (VALUES ('not morally triangular'), ('two rows with one column'), ('another banner'), ('fewer entries than declared'),
('an entry outside'), ('a dataset that lacks entries'), ('a spec without sizes'), ('an unknown strategy'), ('a sound matrix')) c(input)""",
    "fifo_exchange": f"WITH {MESSAGES} SELECT src, dest, seq, l_orderkey, row_number() OVER (PARTITION BY src, dest ORDER BY seq) - 1 AS place FROM g",
    "exchange_stats": "WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey % 8) SELECT sum(n)::BIGINT AS pushes, count(*) AS destinations, max(n) AS most, min(n) AS fewest FROM c",
    "exchange_observed": "SELECT count(*) AS pushes, count(*) AS pulls, sum(strlen(l_orderkey::VARCHAR))::BIGINT AS bytes_sent, sum(strlen(l_orderkey::VARCHAR))::BIGINT AS bytes_received FROM lineitem",
    "alltoall_rejects": f"""
WITH r AS (SELECT l_partkey % 8 AS dest, list_position(list_transform(range(17), lambda i: {u32("concat(l_orderkey, ':', l_linenumber, ':', i, ':11')")} >= {round(0.2 * 2**32)} OR i = 16), true) - 1 AS back FROM lineitem)
SELECT dest, count(*) AS items, (count(*) + sum(back))::BIGINT AS pulls, sum(back)::BIGINT AS unpulls FROM r GROUP BY 1""",
    "alltoall_counts": "SELECT l_suppkey % 8 AS src, l_partkey % 8 AS dest, count(*) AS items FROM lineitem GROUP BY 1, 2",
    "alltoall_elastic": "SELECT l_partkey % 8 AS dest, count(*) AS items, sum(strlen(l_orderkey::VARCHAR))::BIGINT AS bytes FROM lineitem GROUP BY 1",
    "steady_histogram": "SELECT event_type, count(*) AS cnt FROM events GROUP BY 1",
}
