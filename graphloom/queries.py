"""The engine's own queries over the tables' graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.procedures import procedure
from graphloom.operators import access, explore, search
from graphloom.operators.graph import ID_BITS, PropertyGraph
from graphloom.plans.parser import parse
from graphloom.plans.planner import Planner
from graphloom.sources.tables import NODES, table_graph

FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000.0 RETURN c.c_name AS customer, o.o_orderkey AS order_key"


def cypher(graph: PropertyGraph, text: str, **params) -> DataFrame:
    """Rows of a reading query over a graph."""
    return Planner(graph, params).query(parse(text)[0])


def _ordinal(label: str) -> int:
    return next(k for k, n in enumerate(NODES) if n.label == label) << ID_BITS


_C = "customer c JOIN orders o ON c.c_custkey = o.o_custkey"
#: name: (query, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    # scans and patterns
    "scan_nodes": ("MATCH (n) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM benchmark) AS n"),
    "scan_by_label": ("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name, c.c_nationkey AS nation", "SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation FROM customer"),
    "scan_multi_label": ("MATCH (c:Customer:Supplier) RETURN count(*) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "out_edges": ("MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders"),
    "in_edges": ("MATCH (o:Order)<-[:PLACED]-(c) RETURN o.o_orderkey AS o, c.c_name AS name", f"SELECT o.o_orderkey AS o, c.c_name AS name FROM {_C}"),
    "undirected_edges": ("MATCH (n:Nation)-[:IN_NATION]-(x) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x ON n_nationkey = k GROUP BY 1"),
    "all_edges_both_ways": ("MATCH (a)--(b) RETURN count(*) AS n", "SELECT 2 * ((SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) + (SELECT count(*) FROM events)) AS n"),
    "two_hop": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.p_size > 40 RETURN c.c_custkey AS c, p.p_partkey AS p, l.l_linenumber AS line", "SELECT o_custkey AS c, p_partkey AS p, CAST(l_linenumber AS BIGINT) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 40"),
    "three_hop": ("MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p)-[:SUPPLIED_BY]->(s:Supplier) RETURN s.s_suppkey AS s, count(*) AS n", "SELECT d.l_suppkey AS s, count(*) AS n FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d ON d.l_partkey = l.l_partkey GROUP BY 1"),
    "four_hop": ("MATCH (c:Customer)-[:PLACED]->()-[:CONTAINS]->()-[:SUPPLIED_BY]->(s)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d ON d.l_partkey = l.l_partkey JOIN supplier ON s_suppkey = d.l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"),
    "five_hop": ("MATCH (c:Customer)-[:PLACED]->()-[:CONTAINS]->()-[:SUPPLIED_BY]->()-[:IN_NATION]->()-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d ON d.l_partkey = l.l_partkey JOIN supplier ON s_suppkey = d.l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "edge_type_filter": ("MATCH (a:Customer)-[e]->(b) WHERE e:IN_NATION RETURN a.c_custkey AS c, type(e) AS t", "SELECT c_custkey AS c, 'IN_NATION' AS t FROM customer"),
    "edge_type_choice": ("MATCH (a:Customer)-[e:PLACED|IN_NATION]->(b) RETURN type(e) AS t, count(*) AS n", "SELECT 'PLACED' AS t, count(*) AS n FROM orders UNION ALL SELECT 'IN_NATION', count(*) FROM customer"),
    "edge_prop_filter": ("MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p) WHERE l.l_quantity >= 45 RETURN o.o_orderkey AS o, l.l_quantity AS q", "SELECT l_orderkey AS o, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45"),
    "node_map_constraint": ("MATCH (o:Order {o_orderstatus: 'F'})<-[:PLACED]-(c:Customer {c_mktsegment: 'BUILDING'}) RETURN o.o_orderkey AS o", f"SELECT o.o_orderkey AS o FROM {_C} WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'"),
    "label_test_in_where": ("MATCH (n)-[:IN_NATION]->(m:Nation) WHERE n:Supplier AND m.n_nationkey < 5 RETURN n.s_name AS name", "SELECT s_name AS name FROM supplier WHERE s_nationkey < 5"),
    "label_test_negated": ("MATCH (n)-[:IN_NATION]->(m:Nation) WHERE NOT n:Customer RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier"),
    "bounded_walk": ("MATCH (c:Customer)-[*1..2]->(r:Region) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "named_path": ("MATCH p = (c:Customer)-[:PLACED]->(o:Order) RETURN length(p) AS hops, size(nodes(p)) AS nodes, count(*) AS n", "SELECT CAST(1 AS BIGINT) AS hops, CAST(2 AS BIGINT) AS nodes, count(*) AS n FROM orders"),
    # conditions
    "where_eq": ("MATCH (o:Order) WHERE o.o_orderstatus = 'O' RETURN o.o_orderkey AS o", "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'O'"),
    "where_ne": ("MATCH (n:Nation) WHERE n.n_regionkey <> 1 RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_regionkey <> 1"),
    "where_lt": ("MATCH (p:Part) WHERE p.p_size < 5 RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size < 5"),
    "where_le": ("MATCH (p:Part) WHERE p.p_size <= 5 RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size <= 5"),
    "where_gt": ("MATCH (c:Customer) WHERE c.c_acctbal > 9000 RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000"),
    "where_ge": ("MATCH (c:Customer) WHERE c.c_custkey >= 100 RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey >= 100"),
    "where_and": ("MATCH (p:Part) WHERE p.p_size > 10 AND p.p_size < 20 RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size > 10 AND p_size < 20"),
    "where_or": ("MATCH (p:Part) WHERE p.p_size < 3 OR p.p_size > 48 RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size < 3 OR p_size > 48"),
    "where_not": ("MATCH (p:Part) WHERE NOT (p.p_size > 3) RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE NOT p_size > 3"),
    "where_xor": ("MATCH (p:Part) WHERE (p.p_size > 10) XOR (p.p_size > 20) RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE (p_size > 10) <> (p_size > 20)"),
    "double_equality": ("MATCH (l:Order)-[e:CONTAINS]->() WHERE e.l_discount = 0.0 RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem WHERE l_discount = 0.0"),
    "node_inequality": ("MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b:Nation) WHERE a <> b RETURN a.n_name AS a, b.n_name AS b", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey WHERE x.n_nationkey <> y.n_nationkey"),
    "node_equality": ("MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b:Nation) WHERE a = b RETURN a.n_name AS a", "SELECT n_name AS a FROM nation"),
    "homomorphism": ("MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey"),
    "in_list": ("MATCH (n:Nation) WHERE n.n_regionkey IN [0, 2] RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_regionkey IN (0, 2)"),
    "starts_with": ("MATCH (p:Part) WHERE p.p_type STARTS WITH 'S' RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE starts_with(p_type, 'S')"),
    "ends_with": ("MATCH (c:Customer) WHERE c.c_name ENDS WITH '7' RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE suffix(c_name, '7')"),
    "contains": ("MATCH (c:Customer) WHERE c.c_name CONTAINS '00012' RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE contains(c_name, '00012')"),
    "regex_match": ("MATCH (c:Customer) WHERE c.c_name =~ '.*[13579]' RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE regexp_full_match(c_name, '.*[13579]')"),
    "pattern_predicate": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "pattern_predicate_negated": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_subquery": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o) WHERE o.o_totalprice > 400000 } OR c.c_acctbal < 0 RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "count_subquery": ("MATCH (c:Customer) RETURN c.c_custkey AS c, COUNT { (c)-[:PLACED]->() } AS n", "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    # joins
    "common_successor_join": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN c.c_custkey AS c, s.s_suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "common_ancestor_join": ("MATCH (c:Customer)-[:PLACED]->(o:Order), (c)-[:IN_NATION]->(n:Nation) RETURN o.o_orderkey AS o, n.n_name AS nation", "SELECT o_orderkey AS o, n_name AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"),
    "diamond_join": ("MATCH (o:Order)-[:CONTAINS]->(p)-[:SUPPLIED_BY]->(s)-[:IN_NATION]->(n), (o)<-[:PLACED]-(c)-[:IN_NATION]->(n) RETURN count(*) AS k", "SELECT count(*) AS k FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d ON d.l_partkey = l.l_partkey JOIN supplier ON s_suppkey = d.l_suppkey WHERE s_nationkey = c_nationkey"),
    "cycle": ("MATCH (c:Customer)-[:PLACED]->(o)<-[:PLACED]-(c) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey"),
    "cartesian": ("MATCH (r:Region), (n:Nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation"),
    "theta_join": ("MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey"),
    "value_join": ("MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN count(*) AS n", "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000"),
    "repeated_match": ("MATCH (c:Customer)-[:IN_NATION]->(n) MATCH (n)-[:IN_REGION]->(r {r_name: 'ASIA'}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'"),
    # aggregates
    "count_star": ("MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders"),
    "count_empty": ("MATCH (o:Order) WHERE o.o_orderkey < 0 RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0"),
    "count_prop": ("MATCH (n:Nation)-[:IN_NATION]-(x) RETURN count(x.c_name) AS customers, count(x) AS all_of_them", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS all_of_them"),
    "count_distinct": ("MATCH (:Order)-[l:CONTAINS]->(p) RETURN count(DISTINCT p) AS parts, count(DISTINCT l.l_quantity) AS quantities", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_quantity) AS quantities FROM lineitem"),
    "group_count": ("MATCH (c:Customer) RETURN c.c_mktsegment AS segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"),
    "min_max_avg": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, min(o.o_orderkey) AS low, max(o.o_totalprice) AS high, round(avg(o.o_orderkey), 3) AS mean", "SELECT o_orderstatus AS s, min(o_orderkey) AS low, max(o_totalprice) AS high, round(avg(o_orderkey), 3) AS mean FROM orders GROUP BY 1"),
    "sum_of_ints": ("MATCH (p:Part) RETURN p.p_brand AS brand, sum(p.p_size) AS size", "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1"),
    "collect_sizes": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH r, collect(n.n_name) AS names RETURN r.r_name AS region, size(names) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "collect_distinct": ("MATCH (u:User)-[:DID]->(e:Event) WITH u, collect(DISTINCT e.event_type) AS kinds RETURN u.user_id AS user, size(kinds) AS n", "SELECT user_id AS user, count(DISTINCT event_type) AS n FROM events GROUP BY 1"),
    "deviations": ("MATCH (p:Part) RETURN p.p_brand AS brand, round(stDev(p.p_size), 6) AS sample, round(stDevP(p.p_size), 6) AS whole", "SELECT p_brand AS brand, round(coalesce(stddev_samp(p_size), 0), 6) AS sample, round(coalesce(stddev_pop(p_size), 0), 6) AS whole FROM part GROUP BY 1"),
    "percentiles": ("MATCH (p:Part) RETURN p.p_brand AS brand, percentileCont(p.p_size, 0.5) AS median, percentileDisc(p.p_size, 0.9) AS high", "SELECT p_brand AS brand, quantile_cont(p_size, 0.5) AS median, CAST(quantile_disc(p_size, 0.9) AS BIGINT) AS high FROM part GROUP BY 1"),
    "collect_subquery": ("MATCH (r:Region) RETURN r.r_name AS region, size(COLLECT { MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.n_name }) AS n", "SELECT r_name AS region, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region"),
    "return_all": ("MATCH (n:Nation) WITH n.n_nationkey AS k, n.n_name AS name RETURN *", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation"),
    "list_slice": ("UNWIND [1, 2, 3, 4][1..3] AS x RETURN x", "SELECT CAST(x AS BIGINT) AS x FROM (VALUES (2), (3)) t(x)"),
    "edge_identities": ("MATCH (c)-[e:PLACED]->(o:Order) RETURN e AS eid, o.o_orderkey AS k", "SELECT CAST(3 AS BIGINT) * 72057594037927936 + o_orderkey AS eid, o_orderkey AS k FROM orders"),
    "edges_told_apart": ("MATCH ()-[l:CONTAINS]->() RETURN count(DISTINCT l) AS n", "SELECT count(*) AS n FROM lineitem"),
    "having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n >= 12 RETURN c.c_custkey AS c, n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12"),
    # shape of the result
    "order_by": ("MATCH (n:Nation) RETURN n.n_name AS name ORDER BY n.n_regionkey DESC, name", "SELECT n_name AS name FROM nation ORDER BY n_regionkey DESC, n_name"),
    "skip_limit": ("MATCH (o:Order) RETURN o.o_orderkey AS o ORDER BY o.o_totalprice DESC, o SKIP 5 LIMIT 10", "SELECT o_orderkey AS o FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "distinct": ("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "with_chain": ("MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 20 MATCH (c)-[:PLACED]->(o) RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(*) AS n FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "unwind": ("UNWIND [1, 2, 3] AS x MATCH (n:Nation {n_regionkey: x}) RETURN x, count(n) AS n", "SELECT CAST(n_regionkey AS BIGINT) AS x, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2, 3) GROUP BY 1"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier"),
    "union_all": ("MATCH (r:Region) RETURN r.r_name AS x UNION ALL MATCH (n:Nation) RETURN n.n_name AS x", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation"),
    "call_subquery": ("CALL { MATCH (r:Region) RETURN count(r) AS regions } MATCH (n:Nation) RETURN n.n_name AS name, regions", "SELECT n_name AS name, (SELECT count(*) FROM region) AS regions FROM nation"),
    # expressions
    "arithmetic": ("MATCH (p:Part) RETURN p.p_partkey AS p, p.p_size * 2 + 1 AS a, p.p_size / 7 AS b, p.p_size % 7 AS c, -p.p_size AS d, p.p_size - p.p_partkey AS e", "SELECT p_partkey AS p, CAST(p_size * 2 + 1 AS BIGINT) AS a, CAST(p_size // 7 AS BIGINT) AS b, CAST(p_size % 7 AS BIGINT) AS c, CAST(-p_size AS BIGINT) AS d, p_size - p_partkey AS e FROM part"),
    "power": ("MATCH (r:Region) RETURN r.r_name AS r, (r.r_regionkey + 1) ^ 2 AS square", "SELECT r_name AS r, CAST((r_regionkey + 1) * (r_regionkey + 1) AS DOUBLE) AS square FROM region"),
    "case_when": ("MATCH (p:Part) RETURN CASE WHEN p.p_size > 40 THEN 'large' WHEN p.p_size > 15 THEN 'medium' ELSE 'small' END AS size, count(*) AS n", "SELECT CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 15 THEN 'medium' ELSE 'small' END AS size, count(*) AS n FROM part GROUP BY 1"),
    "string_functions": ("MATCH (n:Nation) RETURN toLower(n.n_name) AS a, substring(n.n_name, 1, 3) AS b, size(n.n_name) AS c, n.n_name + '!' AS d, replace(n.n_name, 'N', '-') AS e", "SELECT lower(n_name) AS a, substring(n_name, 2, 3) AS b, length(n_name) AS c, n_name || '!' AS d, replace(n_name, 'N', '-') AS e FROM nation"),
    "list_comprehension": ("MATCH (r:Region) RETURN r.r_name AS r, size([x IN range(0, 9) WHERE x % 5 = r.r_regionkey | x * 2]) AS n", "SELECT r_name AS r, CAST(2 AS BIGINT) AS n FROM region"),
    "quantifier": ("MATCH (r:Region) WHERE any(x IN [1, 3] WHERE x = r.r_regionkey) RETURN r.r_name AS r", "SELECT r_name AS r FROM region WHERE r_regionkey IN (1, 3)"),
    "labels_function": ("MATCH (n)-[:IN_NATION]->() RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier"),
    "keys_function": ("MATCH (r:Region) RETURN r.r_name AS r, size(keys(r)) AS n", "SELECT r_name AS r, CAST(2 AS BIGINT) AS n FROM region"),
}

#: Documents with what labels says of some of them, for null logic.
_RATED = "documents d LEFT JOIN labels l USING (doc_id)"
RATED: dict[str, tuple[str, str]] = {
    "is_null": ("MATCH (d:Document) WHERE d.quality IS NULL RETURN d.doc_id AS d", f"SELECT doc_id AS d FROM {_RATED} WHERE quality IS NULL"),
    "is_not_null": ("MATCH (d:Document) WHERE d.quality <> null RETURN d.doc_id AS d", f"SELECT doc_id AS d FROM {_RATED} WHERE quality IS NOT NULL"),
    "null_logic": ("MATCH (d:Document) WHERE NOT (d.quality = 1 AND d.toxic = 0) RETURN d.doc_id AS d", f"SELECT doc_id AS d FROM {_RATED} WHERE NOT (quality = 1 AND toxic = 0)"),
    "null_or_true": ("MATCH (d:Document) WHERE d.quality = 1 OR d.lang = 'fr' RETURN count(*) AS n, count(d.toxic) AS rated", f"SELECT count(*) AS n, count(toxic) AS rated FROM {_RATED} WHERE quality = 1 OR lang = 'fr'"),
    "order_nulls": ("MATCH (d:Document) RETURN d.doc_id AS d, d.quality AS q ORDER BY d.quality, d LIMIT 50", f"SELECT doc_id AS d, CAST(quality AS BIGINT) AS q FROM {_RATED} ORDER BY quality NULLS LAST, doc_id LIMIT 50"),
    "coalesce_missing": ("MATCH (d:Document) RETURN coalesce(d.quality, -1) AS q, count(*) AS n", f"SELECT CAST(coalesce(quality, -1) AS BIGINT) AS q, count(*) AS n FROM {_RATED} GROUP BY 1"),
}


def _reading(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cypher(table_graph(spark, sf_dir), text)


def _rated(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
        return cypher(table_graph(spark, sf_dir, extras={"documents": docs}), text)

    return run


def _key(df: DataFrame, label: str, column: str = "id") -> DataFrame:
    """Node identities of one label as keys."""
    return df.withColumn(column, F.col(column) - F.lit(_ordinal(label)))


def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.list_labels(table_graph(spark, sf_dir))


def list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = explore.list_nodes(table_graph(spark, sf_dir), ["Customer", "Unknown"], {"c_name": "CUSTOMER#00000001"}, skip=2, limit=5)
    return _key(page, "Customer").select("id", F.element_at("labels", 1).alias("label"))


def get_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    near = explore.neighbors(g, spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.lit(_ordinal("Customer")) + F.col("c_custkey")).alias("id")), limit=3)
    return _key(near, "Customer").groupBy("id", "out").agg(F.count(F.lit(1)).alias("n"), F.min("reached_end").alias("all_of_them"))


def node_edges_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    edges = explore.node_edges(g, g.scan_nodes(("Nation",)), default_limit=4)
    return _key(edges, "Nation").groupBy("id", "type", "out").agg(F.count(F.lit(1)).alias("shown"), F.max("total").alias("total"))


def node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    return _key(explore.node_properties(g, g.scan_nodes(("Nation",)), ("n_name", "n_regionkey", "c_name")), "Nation")


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.label_sets(table_graph(spark, sf_dir)).select(F.array_join("labels", ",").alias("labels"), "nodes")


def edges_by_end_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.scan_edges(table_graph(spark, sf_dir), ("Customer",)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def node_property_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(access.scan_node_property(table_graph(spark, sf_dir), "p_size"), "Part")


def edge_property_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.scan_edge_property(table_graph(spark, sf_dir), "l_quantity").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def string_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that begin like 'economy'; it has seven characters, so five of them count and six have to occur."""
    g = table_graph(spark, sf_dir)
    return _key(search.search_words(search.word_index(g, "p_type", ("Part",)), "economy"), "Part")


_QUERY_VECTOR = [((7 * k) % 11 - 5) / 8 for k in range(64)]
_SQL_VECTOR = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _QUERY_VECTOR) + "]"


def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.nearest(v, _QUERY_VECTOR, 10, "l2", id_col="vec_id").select("id", F.round("score", 6).alias("score"))


def vector_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.nearest(v, _QUERY_VECTOR, 10, "ip", id_col="vec_id").select("id", F.round("score", 6).alias("score"))


#: Signs' difference at which at least 0.9 of the ten nearest are found in the tables' vectors, which have little structure.
LSH_REACH = 6


def vector_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every hundredth vector in the buckets within reach."""
    lib = search.VectorLibraries(spark).create("v", 64, "ip")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    lib.add(vectors)
    return lib.search_all(vectors.where("id % 100 = 0"), 10, LSH_REACH).withColumn("score", F.round("score", 6))


def _sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


_SQL_SIGNATURE = " + ".join(f"CASE WHEN {_sql_dot('embedding', str(p))} > 0 THEN {1 << k} ELSE 0 END" for k, p in enumerate(search.hyperplanes(64)))
_SQL_LSH = f"""WITH s AS (SELECT vec_id, embedding, {_SQL_SIGNATURE} AS sig FROM embeddings),
met AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_sql_dot('c.embedding', 'q.embedding')} AS score FROM s q, s c
  WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND bit_count(xor(q.sig, c.sig)) <= {LSH_REACH}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM met)
SELECT query_id, rank, id, round(score, 6) AS score FROM ranked WHERE rank <= 10"""


#: The properties of the tables' graph, in order, and the procedures: fixed values.
_SQL_PROPERTIES = """SELECT CAST(k - 1 AS BIGINT) AS id, split_part(x, ' ', 1) AS "propertyType", split_part(x, ' ', 2) AS "valueType" FROM (SELECT unnest(a) AS x, generate_subscripts(a, 1) AS k FROM (SELECT [
'r_regionkey Int64', 'r_name String', 'n_nationkey Int64', 'n_name String', 'n_regionkey Int64', 'c_custkey Int64', 'c_name String', 'c_nationkey Int64', 'c_acctbal Double', 'c_mktsegment String',
's_suppkey Int64', 's_name String', 's_nationkey Int64', 's_acctbal Double', 'p_partkey Int64', 'p_name String', 'p_brand String', 'p_type String', 'p_size Int64', 'p_retailprice Double',
'o_orderkey Int64', 'o_custkey Int64', 'o_orderstatus String', 'o_totalprice Double', 'o_orderdate timestamp_ntz', 'o_orderpriority String',
'user_id Int64', 'event_id Int64', 'ts timestamp_ntz', 'event_type String', 'value Double', 'props String',
'doc_id Int64', 'text String', 'lang String', 'source String', 'n_chars Int64', 'page_id Int64', 'url String', 'html String', 'item_id Int64',
'l_linenumber Int64', 'l_quantity Double', 'l_extendedprice Double', 'l_discount Double', 'l_tax Double', 'l_returnflag String', 'l_linestatus String', 'l_shipdate timestamp_ntz'] AS a))"""
_SQL_PROCEDURES = """SELECT name, name || '() :: (' || columns || ')' AS signature FROM (VALUES ('db.labels', 'id :: INTEGER, label :: STRING'), ('db.edgeTypes', 'id :: INTEGER, edgeType :: STRING'),
('db.propertyTypes', 'id :: INTEGER, propertyType :: STRING, valueType :: STRING'), ('db.history', 'commit :: STRING, nodeCount :: INTEGER, edgeCount :: INTEGER, partCount :: INTEGER'),
('db.procedures', 'name :: STRING, signature :: STRING')) v(name, columns)"""


def db_procedure(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = table_graph(spark, sf_dir)
        return procedure(name)(g, None)

    return run


def tombstone_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and their regions as a versioned graph; a deleted node's edges go with it."""
    from graphloom.engine import Engine

    e = _nations(Engine(spark), sf_dir)
    c = e.query("CHANGE NEW", "nations").first()[0]
    e.query("MATCH (r:Region {name: 'ASIA'}) DELETE r", "nations", change=c)
    e.query("CHANGE SUBMIT", "nations", change=c)
    return e.query("MATCH (n:Nation)-[:IN]->(r:Region) RETURN r.name AS region, count(*) AS n", "nations")


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph before and after a commit."""
    from graphloom.engine import Engine

    e = _nations(Engine(spark), sf_dir)
    before = e.graph("nations").commits[-1].hash
    c = e.query("CHANGE NEW", "nations").first()[0]
    e.query("MATCH (n:Nation) CREATE (n)-[:NEAR]->(x:Town {name: 'Town'})", "nations", change=c)
    e.query("CHANGE SUBMIT", "nations", change=c)
    old = e.query("MATCH (n) RETURN count(*) AS n", "nations", commit=before).withColumn("at", F.lit("before"))
    return old.unionByName(e.query("MATCH (n) RETURN count(*) AS n", "nations").withColumn("at", F.lit("after")))


def set_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.engine import Engine

    e = _nations(Engine(spark), sf_dir)
    c = e.query("CHANGE NEW", "nations").first()[0]
    e.query("MATCH (n:Nation)-[:IN]->(r:Region {name: 'ASIA'}) SET n.size = n.key * 2, n:Asian", "nations", change=c)
    e.query("CHANGE SUBMIT", "nations", change=c)
    return e.query("MATCH (n:Asian) RETURN n.key AS key, n.size AS size", "nations")


def _written(sf_dir: str, spark: SparkSession, *statements: str):
    """The graph of nations after a change of these statements."""
    from graphloom.engine import Engine

    e = _nations(Engine(spark), sf_dir)
    c = e.query("CHANGE NEW", "nations").first()[0]
    for x in statements:
        e.query(x, "nations", change=c)
    e.query("CHANGE SUBMIT", "nations", change=c)
    return e


def merge_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows that miss the same pattern create it once."""
    e = _written(sf_dir, spark, "MATCH (n:Nation)-[:IN]->(r:Region) WITH r.name AS name MERGE (t:Tag {tag: name})")
    return e.query("MATCH (t:Tag) RETURN t.tag AS tag, count(*) AS n", "nations")


def remove_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _written(sf_dir, spark, "MATCH (n:Nation)-[:IN]->(r:Region {name: 'ASIA'}) REMOVE n.key")
    return e.query("MATCH (n:Nation) WHERE n.key IS NULL RETURN n.name AS name", "nations")


def commit_in_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change commits, its later statements see."""
    e = _written(sf_dir, spark, "MATCH (r:Region) CREATE (m:Mark {of: r.key})", "COMMIT", "MATCH (m:Mark), (r:Region) WHERE m.of = r.key CREATE (m)-[:MARKS]->(r)")
    return e.query("MATCH (m:Mark)-[:MARKS]->(r:Region) RETURN m.of AS k, r.name AS name", "nations")


def db_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _written(sf_dir, spark, "MATCH (r:Region) CREATE (m:Mark {of: r.key})")
    return e.query("CALL db.history()", "nations").agg(F.max("nodeCount").alias("nodes"), F.max("edgeCount").alias("edges"))


def _nations(e, sf_dir: str):
    """Regions and nations copied into a versioned graph."""
    spark = e.spark
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    nodes = r.select(F.col("r_regionkey").cast("long").alias("id"), F.array(F.lit("Region")).alias("labels"), F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name")).unionByName(n.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")))
    edges = n.select(F.col("n_nationkey").cast("long").alias("eid"), (F.col("n_nationkey") + 1000).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), F.lit("IN").alias("type"))
    e.import_frames("nations", nodes, edges)
    return e


FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "list_labels": (list_labels, "SELECT 'Region' AS label, count(*) AS nodes FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Page', count(*) FROM pages UNION ALL SELECT 'Item', count(*) FROM benchmark"),
    "label_sets": (label_sets, "SELECT 'Region' AS labels, count(*) AS nodes FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Page', count(*) FROM pages UNION ALL SELECT 'Item', count(*) FROM benchmark"),
    "list_nodes": (list_nodes, "SELECT c_custkey AS id, 'Customer' AS label FROM customer WHERE contains(lower(c_name), 'customer#00000001') ORDER BY 1 LIMIT 5 OFFSET 2"),
    "get_neighbors": (get_neighbors, "WITH e AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT o_custkey FROM orders), t AS (SELECT id, count(*) AS k FROM e GROUP BY 1) SELECT id, true AS out, least(k, 3) AS n, k <= 3 AS all_of_them FROM t"),
    "node_edges_per_type": (node_edges_per_type, "WITH e AS (SELECT n_nationkey AS id, 'IN_REGION' AS type, true AS out FROM nation UNION ALL SELECT c_nationkey, 'IN_NATION', false FROM customer UNION ALL SELECT s_nationkey, 'IN_NATION', false FROM supplier) SELECT CAST(id AS BIGINT) AS id, type, out, least(count(*), 4) AS shown, count(*) AS total FROM e GROUP BY ALL"),
    "node_properties": (node_properties, "SELECT CAST(n_nationkey AS BIGINT) AS id, 'n_name' AS property, n_name AS value FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation"),
    "edges_by_end_labels": (edges_by_end_labels, "SELECT 'IN_NATION' AS type, count(*) AS n FROM customer UNION ALL SELECT 'PLACED', count(*) FROM orders"),
    "node_property_scan": (node_property_scan, "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS value FROM part"),
    "edge_property_scan": (edge_property_scan, "SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1"),
    "string_prefix_search": (string_prefix_search, "WITH w AS (SELECT p_partkey AS id, unnest(string_split_regex(lower(regexp_replace(p_type, '[^A-Za-z0-9]', ' ', 'g')), ' +')) AS word FROM part) SELECT DISTINCT id FROM w WHERE starts_with(word, 'econo') AND EXISTS (SELECT 1 FROM w WHERE starts_with(word, 'econom'))"),
    "vector_topk_l2": (vector_topk_l2, f"SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, {_SQL_VECTOR}), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 6) AS score FROM embeddings ORDER BY list_sum(list_transform(list_zip(embedding, {_SQL_VECTOR}), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), vec_id LIMIT 10"),
    "vector_topk_ip": (vector_topk_ip, f"SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, {_SQL_VECTOR}), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 6) AS score FROM embeddings ORDER BY list_sum(list_transform(list_zip(embedding, {_SQL_VECTOR}), lambda p: CAST(p[1] AS DOUBLE) * p[2])) DESC, vec_id LIMIT 10"),
    "vector_topk_lsh": (vector_topk_lsh, _SQL_LSH),
    "db_labels": (db_procedure("db.labels"), "SELECT CAST(id AS BIGINT) AS id, label FROM (VALUES (0, 'Region'), (1, 'Nation'), (2, 'Customer'), (3, 'Supplier'), (4, 'Part'), (5, 'Order'), (6, 'User'), (7, 'Event'), (8, 'Document'), (9, 'Page'), (10, 'Item')) t(id, label)"),
    "db_edge_types": (db_procedure("db.edgeTypes"), "SELECT CAST(id AS BIGINT) AS id, edgeType FROM (VALUES (0, 'IN_REGION'), (1, 'IN_NATION'), (2, 'PLACED'), (3, 'CONTAINS'), (4, 'SUPPLIED_BY'), (5, 'DID')) t(id, edgeType)"),
    "db_property_types": (db_procedure("db.propertyTypes"), _SQL_PROPERTIES),
    "show_procedures": (db_procedure("db.procedures"), _SQL_PROCEDURES),
    "tombstone_delete": (tombstone_delete, "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' GROUP BY 1"),
    "time_travel": (time_travel, "SELECT 'before' AS at, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'after', 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)"),
    "merge_once": (merge_once, "SELECT r_name AS tag, CAST(1 AS BIGINT) AS n FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)"),
    "remove_property": (remove_property, "SELECT n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'"),
    "commit_in_change": (commit_in_change, "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region"),
    "db_history": (db_history, "SELECT (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM nation) AS edges"),
    "set_property": (set_property, "SELECT CAST(n_nationkey AS BIGINT) AS key, CAST(n_nationkey * 2 AS BIGINT) AS size FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _reading(q) for n, (q, _) in CYPHER.items()} | {n: _rated(q) for n, (q, _) in RATED.items()} | {n: f for n, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for table in (CYPHER, RATED) for n, (_, s) in table.items()} | {n: s for n, (_, s) in FUNCTIONS.items() if s}
