"""Registered queries of the core engine and their DuckDB oracles, keyed by operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tagged as T
from ..operators import graph as G
from ..operators import vectors as V
from ..operators.tpch_graph import FIRST, tpch_graph
from ..session import Engine
from ..sources import scratch
from ..sources.tables import table
from . import cypher as C
from . import reads, routing, sqltext

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "j3_multi_join_window"


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def run_sql(spark: SparkSession, sf_dir: str, text: str, params: dict | None = None) -> DataFrame:
    """A statement through the SQL frontend over the tables of a folder."""
    sqltext.shape(text)
    return reads.run(spark, text, {name: (lambda name=name: table(spark, sf_dir, name)) for name in TABLES}, params)


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def add_sql(name: str, text: str, params: dict | None = None, oracle: str | None = None) -> None:
    """The same PostgreSQL-style text runs here and, with its parameters put in, in DuckDB."""
    own = re.sub(r"\$(\w+)", lambda m: _literal(params[m[1]]), text) if params else text
    register(name, oracle or own)(lambda spark, sf_dir: run_sql(spark, sf_dir, text, params))


# --- SQL reads ------------------------------------------------------------------------------------------

add_sql("s2_table_scan", "SELECT * FROM customer")
add_sql("p1_projection", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer")
add_sql("p2_predicates", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 500 AND (c_mktsegment = 'BUILDING' OR c_nationkey IS NULL) AND c_name IS NOT NULL")
add_sql("p2_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = $key", {"key": 77})
add_sql("p3_between", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
add_sql("p4_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
add_sql("p5_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' AND p_name LIKE '%i%'")
add_sql("p6_cast", "SELECT o_orderkey, o_totalprice::INTEGER AS whole, CAST(o_custkey AS TEXT) AS customer FROM orders WHERE o_custkey::TEXT LIKE '1%'", oracle="SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR) AS customer FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '1%'")
add_sql("p7_date_literal", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'")
add_sql("p8_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
add_sql("p9_exists", "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
add_sql("p10_case_exists", "SELECT c.c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') THEN 1 ELSE 0 END AS has_f FROM customer c")
add_sql("p11_scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM nation) AS nations FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
add_sql("p12_derived_table", "SELECT x.segment, x.n FROM (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment) x WHERE x.n > 10")
add_sql("p13_ctes", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_name, per.n FROM per JOIN customer c ON c.c_custkey = per.o_custkey")
add_sql("j1_inner_join", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
add_sql("j2_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 450000")
add_sql("j3_multi_join", "SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name")
add_sql(
    "j3_multi_join_window",
    "WITH revenue AS (SELECT r.r_name AS region, n.n_name AS nation, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name) "
    "SELECT region, nation, round(revenue, 2) AS revenue, row_number() OVER (PARTITION BY region ORDER BY revenue DESC, nation) AS place FROM revenue",
)
add_sql("j4_semi_join", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o WHERE EXISTS (SELECT 1 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey = o.o_custkey AND n.n_regionkey = 1)")
add_sql("j5_anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
add_sql("j_full_join", "SELECT n.n_name, r.r_name FROM nation n FULL OUTER JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey < 3")
add_sql("j_right_join_using", "SELECT k, a, b FROM (SELECT r_regionkey AS k, r_name AS a FROM region) x RIGHT JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation) y USING (k)")
add_sql("a1_count", "SELECT count(*) AS n, count(o_orderpriority) AS known FROM orders WHERE o_orderstatus = 'F'")
add_sql("a2_sum_group_by", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag, l_linestatus")
add_sql("a3_avg_join", "SELECT c.c_mktsegment, round(avg(o.o_totalprice), 4) AS mean FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
add_sql("a4_min_max_spread", "SELECT event_type, min(value) AS least, max(value) AS most, round(stddev(value), 4) AS spread, round(variance(value), 3) AS var FROM events GROUP BY event_type")
add_sql("a5_two_keys", "SELECT event_type, user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type, user_id")
# Sums of decimals don't depend on the order of the rows.
add_sql("a6_two_levels", "WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events GROUP BY user_id, CAST(ts AS DATE)) SELECT user_id, count(*) AS days, CAST(sum(total) AS DOUBLE) / count(*) AS mean FROM daily GROUP BY user_id")
add_sql("a7_distinct_join", "SELECT DISTINCT n.n_name, c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
add_sql("a8_aggregate_top_k", "SELECT user_id, round(avg(value), 4) AS mean, round(sum(value), 2) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10")
add_sql("a_having_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) > 10")
add_sql("w1_row_number", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
add_sql("w2_top_per_group", "WITH ranked AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) SELECT user_id, event_id, value, rn FROM ranked WHERE rn <= 3")
add_sql("w3_window_over_aggregate", "WITH per AS (SELECT c.c_nationkey AS nation, c.c_mktsegment AS segment, sum(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, c.c_mktsegment) SELECT nation, segment, round(total, 2) AS total, row_number() OVER (PARTITION BY segment ORDER BY total DESC, nation) AS place FROM per")
add_sql("w4_rank_lag", "SELECT event_id, user_id, rank() OVER (PARTITION BY user_id ORDER BY value) AS place, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM events")
add_sql("o1_null_order", "SELECT x, row_number() OVER (ORDER BY x DESC, k) AS place FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_name END AS x FROM nation) t", oracle="SELECT x, row_number() OVER (ORDER BY x DESC NULLS FIRST, k) AS place FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_name END AS x FROM nation) t")
add_sql("o2_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
add_sql("u1_union_all", "WITH parties AS (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier) SELECT nation, count(*) AS n, round(sum(balance), 2) AS total FROM parties GROUP BY nation")
add_sql("u3_set_operations", "SELECT x.k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT 3 AS k) x")
add_sql("f_scalar_functions", "SELECT c_custkey, lower(c_mktsegment) AS low, coalesce(c_name, '-') AS name, length(c_name) AS n, substr(c_name, 1, 4) AS head, c_acctbal * 2 + 1 AS twice FROM customer")
add_sql("q10_named_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = $priority AND o_totalprice > $least", {"priority": "1-URGENT", "least": 400000})

STATEMENTS = (
    "SELECT count(*) FROM t WHERE a = 1",
    "SELECT a, count(*) FROM t GROUP BY a",
    "SELECT a, row_number() OVER (ORDER BY a) AS r FROM t",
    "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.a = t.a)",
    "SELECT DISTINCT t.a FROM t JOIN u ON t.a = u.a",
    "WITH x AS (SELECT a FROM t) SELECT a FROM x ORDER BY a LIMIT 3",
    "SELECT t.a FROM t JOIN u ON t.a = u.a JOIN v ON v.a = u.a ORDER BY t.a",
    "INSERT INTO t VALUES (1)",
)
KINDS = ("transactional_read", "analytical_read", "analytical_read", "analytical_read", "analytical_read", "analytical_read", "analytical_read", "transactional_write")


@register("q12_classification", "SELECT * FROM (VALUES " + ", ".join(f"({_literal(s)}, {_literal(k)})" for s, k in zip(STATEMENTS, KINDS, strict=True)) + ") AS t(statement, kind)")
def q12_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, routing.classify_sql(sqltext.shape(s)).kind) for s in STATEMENTS], "statement string, kind string")


# --- graph reads ----------------------------------------------------------------------------------------


def run_cypher(spark: SparkSession, sf_dir: str, text: str, params: dict | None = None) -> DataFrame:
    out = G.Matcher(tpch_graph(spark, sf_dir), C.parse(text), params).result()
    return out.toDF(*(c.replace(".", "_") for c in out.columns))


def add_cypher(name: str, text: str, oracle: str, params: dict | None = None) -> None:
    register(name, oracle)(lambda spark, sf_dir: run_cypher(spark, sf_dir, text, params))


_CU, _NA, _RE, _PA, _OR, _SU = (FIRST[k] for k in ("Customer", "Nation", "Region", "Part", "Order", "Supplier"))
add_cypher("s4_node_scan", "MATCH (n:Nation) RETURN n.id, n.label, n.name", f"SELECT {_NA} + n_nationkey AS n_id, 'Nation' AS n_label, n_name AS n_name FROM nation")
add_cypher("s5_edge_scan", "MATCH ()-[r:IN_REGION]->() RETURN r.id, r.type", f"SELECT {_NA} + n_nationkey AS r_id, 'IN_REGION' AS r_type FROM nation")
add_cypher("c6_node_anchor", "MATCH (c:Customer {segment: $s}) RETURN c.name, c.acctbal", "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'", {"s": "BUILDING"})
add_cypher("c6_node_range", "MATCH (p:Part) WHERE p.size >= 10 AND p.size < 20 AND p.price > 950.0 RETURN p.name, p.size", "SELECT p_name, p_size::BIGINT AS p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950")
add_cypher("c13_string_predicates", "MATCH (p:Part) WHERE p.name STARTS WITH 's' AND p.name CONTAINS 'ing' AND p.brand ENDS WITH '7' RETURN p.id, p.name", f"SELECT {_PA} + p_partkey AS p_id, p_name FROM part WHERE starts_with(p_name, 's') AND contains(p_name, 'ing') AND ends_with(p_brand, '7')")
add_cypher("c13_null_predicates", "MATCH (n) WHERE n.acctbal IS NOT NULL AND n.segment IS NULL RETURN n.id, n.label", f"SELECT {_SU} + s_suppkey AS n_id, 'Supplier' AS n_label FROM supplier")
add_cypher("c11_or_coerced", "MATCH (c:Customer) WHERE c.active = 0 OR c.acctbal > 9000 RETURN c.name, c.active", "SELECT c_name, c_acctbal >= 0 AS c_active FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
add_cypher("c11_parentheses", "MATCH (o:Order) WHERE o.status = 'F' AND (o.total > 400000 OR o.priority = '1-URGENT') RETURN o.id, o.total", f"SELECT {_OR} + o_orderkey AS o_id, o_totalprice AS o_total FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 400000 OR o_orderpriority = '1-URGENT')")
add_cypher("c12_strict_equality", "MATCH (p:Part {size: 5.0}) RETURN p.id", f"SELECT {_PA} + p_partkey AS p_id FROM part WHERE false")
add_cypher("c14_raw_fields", f"MATCH (n) WHERE n.label = 'Customer' AND n.id < {_CU + 50} RETURN n.id, n.name", f"SELECT {_CU} + c_custkey AS n_id, c_name AS n_name FROM customer WHERE c_custkey < 50")
add_cypher("c7_expand", "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE r.total > 300000 RETURN c.name, o.id, r.total", f"SELECT c_name, {_OR} + o_orderkey AS o_id, o_totalprice AS r_total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")
add_cypher("c7_expand_reverse", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name, s.name", "SELECT n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
add_cypher("c8_anonymous", "MATCH (:Region {name: 'ASIA'})<-[:IN_REGION]-(n) RETURN n.name", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
add_cypher("c9_untyped", "MATCH (n:Nation)-[r]->(x) RETURN n.name, r.type, x.name", "SELECT n_name, 'IN_REGION' AS r_type, r_name AS x_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add_cypher("c10_type_alternation", "MATCH (c:Customer)-[r:PLACED|IN_NATION]->(x) WHERE c.acctbal > 9500.0 RETURN c.name, r.type, x.id", f"SELECT c_name, 'PLACED' AS r_type, {_OR} + o_orderkey AS x_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9500 UNION ALL SELECT c_name, 'IN_NATION', {_NA} + c_nationkey FROM customer WHERE c_acctbal > 9500")
add_cypher("c12_edge_properties", "MATCH (o:Order)-[r:CONTAINS {line: 1}]->(p:Part) WHERE r.quantity >= 45 RETURN o.id, p.name, r.quantity", f"SELECT {_OR} + l_orderkey AS o_id, p_name, l_quantity AS r_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_quantity >= 45")
add_cypher("u2_or_on_named_relationship", "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.status = 'P' OR o.priority = '5-LOW' RETURN r.id, c.id", f"SELECT {_OR} + o_orderkey AS r_id, {_CU} + o_custkey AS c_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
add_cypher("a9_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.segment, o.status", "SELECT DISTINCT c_mktsegment AS c_segment, o_orderstatus AS o_status FROM orders JOIN customer ON c_custkey = o_custkey")
add_cypher("o3_order_limit", "MATCH (p:Part) RETURN p.id, p.size ORDER BY p.size DESC, p.id LIMIT 25", f"SELECT {_PA} + p_partkey AS p_id, p_size::BIGINT AS p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
add_cypher("o4_skip", "MATCH (n:Nation) RETURN n.name ORDER BY n.id SKIP 5", "SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 5")
add_cypher("o5_offset_limit", "MATCH (c:Customer) WHERE c.acctbal >= 0 RETURN DISTINCT c.name ORDER BY c.name DESC OFFSET 3 LIMIT 7", "SELECT DISTINCT c_name FROM customer WHERE c_acctbal >= 0 ORDER BY c_name DESC LIMIT 7 OFFSET 3")


@register("j6_cross_match", "SELECT count(*) AS n FROM nation, region WHERE n_nationkey < 10 AND r_name <> 'ASIA'")
def j6_cross_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that a two-pattern MATCH ... CREATE connects."""
    s = C.parse(f"MATCH (n:Nation), (r:Region) WHERE n.id < {_NA + 10} AND (r.id < {_RE + 2} OR r.id > {_RE + 2}) CREATE (n)-[:NEAR]->(r)")
    return G.Matcher(tpch_graph(spark, sf_dir), s, None).frame().agg(F.count("*").alias("n"))


# --- vectors --------------------------------------------------------------------------------------------

_KEYS = ("target", "namespace", "target_id")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit("direct").alias("target"), F.lit("").alias("namespace"), F.col("vec_id").alias("target_id"), "embedding", F.create_map(F.lit("label"), T.as_tagged(F.col("label").cast("bigint"), "integer")).alias("metadata"))


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]]


_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORES = {"cosine": f"{_DOT} / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))", "dot": _DOT, "l2": "0.0 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"}


def _knn_sql(metric: str, k: int, where: str = "true") -> str:
    return f"SELECT e.vec_id AS target_id, round({_SCORES[metric]}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} ORDER BY {_SCORES[metric]} DESC, e.vec_id LIMIT {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("target_id", F.round("score", 6).alias("score"))


for _metric, _id in (("cosine", "x1"), ("dot", "x2"), ("l2", "x3")):
    register(f"{_id}_{_metric}_top_k", _knn_sql(_metric, 10))(lambda spark, sf_dir, m=_metric: _rounded(V.top_k(_embeddings(spark, sf_dir), _query(spark, sf_dir), 10, m)))


@register("x4_candidates", _knn_sql("cosine", 10, "e.label = 3"))
def x4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").filter("label = 3").select(F.col("vec_id").alias("target_id"))
    return _rounded(V.top_k(_embeddings(spark, sf_dir).join(ids, "target_id", "left_semi"), _query(spark, sf_dir), 10))


@register("x13_metadata_filter", _knn_sql("l2", 5, "e.label = 2"))
def x13_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).filter(T.Prop(F.col("metadata")["label"]).equals(2))
    return _rounded(V.top_k(rows, _query(spark, sf_dir), 5, "l2"))


@register("x8_merge", _knn_sql("cosine", 10))
def x8_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _embeddings(spark, sf_dir), _query(spark, sf_dir)
    parts = [V.top_k(rows.filter(f"metadata['label'].i % 2 = {i}"), q, 10) for i in (0, 1)]
    return _rounded(V.merge_best(parts, _KEYS, 10))


_INT8 = """
WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, coalesce(nullif(max(abs(x)) / 127.0, 0), 1.0) AS scale FROM d GROUP BY i),
a AS (SELECT vec_id, i, round(x / scale) * scale AS x FROM d JOIN s USING (i)),
q AS (SELECT i, x AS y FROM d WHERE vec_id = 0),
c AS (SELECT vec_id, sum(x * y) / sqrt(sum(x * x) * (SELECT sum(y * y) FROM q)) AS score FROM a JOIN q USING (i) GROUP BY vec_id)
SELECT vec_id AS target_id, round(score, 6) AS score FROM c ORDER BY c.score DESC, vec_id LIMIT 10"""


@register("x5_int8_top_k", _INT8)
def x5_int8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.top_k_quantised(_embeddings(spark, sf_dir), _query(spark, sf_dir), 10))


def _vector_engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, scratch.folder(spark), ann_threshold=256)
    engine.insert_vector_frame(_embeddings(spark, sf_dir).select("target_id", "embedding", "metadata"))
    return engine


# The index loses no neighbour, so that brute force says the same.
@register("x6_ann_reranked", f"SELECT q.vec_id AS query_id, e.vec_id AS target_id, round({_SCORES['cosine']}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORES['cosine']} DESC, e.vec_id) <= 10")
def x6_ann_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _vector_engine(spark, sf_dir)
    engine.create_vector_index("by_cosine", "cosine")
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return engine.search_vectors_many(queries, top_k=10).select("query_id", "target_id", F.round("score", 6).alias("score"))


@register("x11_search_vectors", _knn_sql("dot", 10))
def x11_search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_vector_engine(spark, sf_dir).search_vectors(_query(spark, sf_dir), top_k=10, metric="dot").df)


@register("x15_sql_vector", _knn_sql("cosine", 10, "e.label IN (1, 4)"))
def x15_sql_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE TABLE docs (id INTEGER PRIMARY KEY, label INTEGER, embedding BLOB)")
    engine.register("source", table(spark, sf_dir, "embeddings"))
    engine.query("INSERT INTO docs (id, label, embedding) SELECT vec_id, label, embedding FROM source")
    return _rounded(engine.query("SELECT id FROM docs WHERE label IN (1, 4) ORDER BY embedding <=> $q LIMIT 10", {"q": _query(spark, sf_dir)}).df)


@register("x16_cypher_vector", _knn_sql("cosine", 10, "e.label = 5").replace("e.vec_id AS target_id", "e.vec_id + 1 AS node_id"))
def x16_cypher_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    rows = table(spark, sf_dir, "embeddings")
    props = F.create_map(F.lit("e"), T.as_tagged(F.col("embedding"), "vector"), F.lit("label"), T.as_tagged(F.col("label").cast("bigint"), "integer")).cast(T.PROPS)
    engine.catalog.atomically(lambda: engine.catalog.append("__nodes", rows.select((F.col("vec_id") + 1).alias("id"), F.lit("Doc").alias("label"), props.alias("props"))))
    out = engine.query("CALL db.index.vector.queryNodes('any', 10, $q) YIELD node, score MATCH (node:Doc {label: 5}) RETURN node.id, score", {"q": _query(spark, sf_dir)})
    return out.df.select(F.col("`node.id`").alias("node_id"), F.round("score", 6).alias("score"))


@register("l8_index_catalog", "SELECT 'by_cosine' AS name, 'cosine' AS metric, 'ready' AS state, count(*) AS total_rows, count(*) AS indexed_rows FROM embeddings")
def l8_index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _vector_engine(spark, sf_dir)
    engine.query("CREATE VECTOR INDEX by_cosine FOR cosine")
    engine.query("REFRESH VECTOR INDEX by_cosine")
    return engine.query("SHOW VECTOR INDEXES").df.select("name", "metric", "state", "total_rows", "indexed_rows")


# --- writes and ingest ----------------------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE TABLE people (id INTEGER PRIMARY KEY, name TEXT NOT NULL, balance REAL, segment TEXT)")
    engine.register("customer", table(spark, sf_dir, "customer"))
    engine.query("INSERT INTO people (id, name, balance, segment) SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
    return engine


@register("q7_insert_select", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT max(c_custkey) + 1, 'new', 1.5, NULL FROM customer")
def q7_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _customers(spark, sf_dir)
    engine.query("INSERT INTO people (name, balance) VALUES ($n, 1.5)", {"n": "new"})
    return engine.query("SELECT id, name, balance, segment FROM people").df


@register("q8_update", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS balance FROM customer")
def q8_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _customers(spark, sf_dir)
    engine.query("UPDATE people SET balance = balance + 10 WHERE segment = $s", {"s": "BUILDING"})
    return engine.query("SELECT id, name, balance FROM people").df


@register("q9_delete", "SELECT c_custkey AS id FROM customer WHERE NOT c_acctbal < 1000")
def q9_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _customers(spark, sf_dir)
    engine.query("DELETE FROM people WHERE balance < 1000")
    return engine.query("SELECT id FROM people").df


def _csv(df: DataFrame) -> str:
    path = scratch.folder(df.sparkSession)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@register("s7_import_table", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def s7_import_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE TABLE people (id INTEGER PRIMARY KEY, name TEXT NOT NULL, balance REAL, segment TEXT)")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    engine.import_table("people", _csv(rows))
    return engine.query("SELECT id, name, balance, segment FROM people").df


def _graph_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Nations and suppliers as nodes, IN_NATION edges, all through CSV files."""
    engine = Engine(spark, scratch.folder(spark))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    engine.import_nodes("Nation", _csv(nation.select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("name"))), id_column="id", property_columns=["name"])
    engine.import_nodes("Supplier", _csv(supplier.select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))), id_column="id", property_columns=["name", "acctbal"], property_types={"acctbal": "real"})
    engine.import_edges("IN_NATION", _csv(supplier.select((F.col("s_suppkey") + 1000).alias("a"), (F.col("s_nationkey") + 1).alias("b"), F.lit(2000).alias("since"))), source_id_column="a", target_id_column="b", property_columns=["since"], property_types={"since": "integer"})
    return engine


def _named(out: DataFrame, **tags: str) -> DataFrame:
    """Graph results with plain columns: dots become underscores and tagged values the type that is named."""
    cols = []
    for c in out.columns:
        name = c.replace(".", "_")
        cols.append(F.col(f"`{c}`")[T.FIELDS[tags[name]]].alias(name) if name in tags else F.col(f"`{c}`").alias(name))
    return out.select(*cols)


@register("s8_import_nodes", "SELECT s_suppkey + 1000 AS s_id, s_name, s_acctbal FROM supplier")
def s8_import_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_graph_engine(spark, sf_dir).query("MATCH (s:Supplier) RETURN s.id, s.name, s.acctbal").df, s_name="string", s_acctbal="real")


@register("s9_import_edges", "SELECT s_name, n_name, 2000::BIGINT AS r_since FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def s9_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_graph_engine(spark, sf_dir).query("MATCH (s:Supplier)-[r:IN_NATION]->(n:Nation) RETURN s.name, n.name, r.since").df, s_name="string", n_name="string", r_since="integer")


@register("g5_match_create", "SELECT s_suppkey + 1000 AS s_id, 'Flag' AS f_label FROM supplier WHERE s_acctbal >= 5000")
def g5_match_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _graph_engine(spark, sf_dir)
    engine.query("MATCH (s:Supplier) WHERE s.acctbal >= 5000 CREATE (s)-[:HAS]->(f:Flag {on: true})")
    return _named(engine.query("MATCH (s)-[r:HAS]->(f:Flag {on: true}) RETURN s.id, f.label").df)


@register("g6_connect_matches", "SELECT a.n_nationkey + 1 AS a_id, b.n_nationkey + 1 AS b_id FROM nation a, nation b WHERE a.n_nationkey < 3 AND b.n_nationkey >= 20")
def g6_connect_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _graph_engine(spark, sf_dir)
    engine.query("MATCH (a:Nation), (b:Nation) WHERE a.id < 4 AND b.id >= 21 AND b.id < 1000 CREATE (a)-[:NEAR]->(b)")
    return _named(engine.query("MATCH (a)-[:NEAR]->(b) RETURN a.id, b.id").df)


@register("g7_set", "SELECT s_suppkey + 1000 AS s_id, CASE WHEN s_acctbal < 0 THEN 'debt' END AS s_state FROM supplier")
def g7_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _graph_engine(spark, sf_dir)
    engine.query("MATCH (s:Supplier) WHERE s.acctbal < 0 SET s.state = 'debt', s.seen = 1")
    return _named(engine.query("MATCH (s:Supplier) RETURN s.id, s.state").df, s_state="string")


@register("g8_set_relationship", "SELECT s_suppkey + 1000 AS s_id, CASE WHEN s_nationkey = 1 THEN 2001 ELSE 2000 END::BIGINT AS r_since FROM supplier")
def g8_set_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _graph_engine(spark, sf_dir)
    engine.query("MATCH (s:Supplier)-[r:IN_NATION]->(n:Nation {name: 'NATION_1'}) SET r.since = 2001")
    return _named(engine.query("MATCH (s)-[r:IN_NATION]->(n) RETURN s.id, r.since").df, r_since="integer")


@register("g9_detach_delete", "SELECT s_suppkey + 1000 AS s_id, s_nationkey + 1 AS n_id FROM supplier WHERE s_nationkey <> 2")
def g9_detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _graph_engine(spark, sf_dir)
    engine.query("MATCH (n:Nation {name: 'NATION_2'}) DETACH DELETE n")
    return _named(engine.query("MATCH (s)-[r:IN_NATION]->(n) RETURN s.id, n.id").df)


@register("g10_delete_relationship", "SELECT s_suppkey + 1000 AS s_id FROM supplier WHERE NOT s_acctbal > 3000")
def g10_delete_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _graph_engine(spark, sf_dir)
    engine.query("MATCH (s:Supplier)-[r:IN_NATION]->(n) WHERE s.acctbal > 3000 DELETE r")
    return _named(engine.query("MATCH (s)-[r:IN_NATION]->(n) RETURN s.id").df)


@register("g1_create", "SELECT 'KNOWS' AS r_type, 'A' AS a_name, 7::BIGINT AS b_age")
def g1_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE (a:User {name: 'A'})-[r:KNOWS {since: 1}]->(b:User {age: $age})", {"age": 7})
    return _named(engine.query("MATCH (a:User)-[r:KNOWS]->(b:User) RETURN r.type, a.name, b.age").df, a_name="string", b_age="integer")


# --- what has no table of its own to read: lifecycle, admission, hooks and the life of an index ------------


def _values(rows: list[tuple], names: str) -> str:
    """An oracle of literal rows."""
    cell = lambda x: "NULL" if x is None else _literal(x) if not isinstance(x, bool) else str(x).lower()
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"


def _fails(action) -> bool:
    try:
        action()
    except ValueError:
        return True
    return False


@register("s1_open_store", "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region")
def s1_open_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark)
    with Engine(spark, path) as engine:
        engine.query("CREATE TABLE places (id INTEGER PRIMARY KEY, name TEXT)")
        engine.register("region", table(spark, sf_dir, "region"))
        engine.query("INSERT INTO places SELECT r_regionkey, r_name FROM region")
    return Engine(spark, path).query("SELECT id, name FROM places").df


@register("s6_vector_scan", "SELECT 'direct' AS target, count(*) AS n, max(len(embedding)) AS dims FROM embeddings")
def s6_vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_engine(spark, sf_dir).vectors().groupBy("target").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))


@register("s10_csv_quoting", "SELECT n_nationkey::BIGINT AS id, n_name || ', \"q\"' || chr(10) || 'next' AS name, '' AS note FROM nation")
def s10_csv_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE TABLE places (id INTEGER PRIMARY KEY, name TEXT, note TEXT)")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(', "q"\nnext')).alias("name"), F.lit("").alias("note"))
    engine.import_table("places", _csv(rows), columns=["note", "name", "id"])
    return engine.query("SELECT id, name, note FROM places").df


@register("s11_csv_types", "SELECT p_partkey AS p_id, p_size::BIGINT AS p_size, p_retailprice AS p_price, p_size > 25 AS p_big FROM part")
def s11_csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    big = F.when(F.col("p_size") > 25, F.when(F.col("p_size") % 2 == 0, "YES").otherwise("1")).otherwise(F.when(F.col("p_size") % 2 == 0, "False").otherwise("no"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), big.alias("big"))
    engine.import_nodes("Part", _csv(rows), id_column="id", property_types={"size": "integer", "price": "real", "big": "boolean"})
    return _named(engine.query("MATCH (p:Part) RETURN p.id, p.size, p.price, p.big").df, p_size="integer", p_price="real", p_big="boolean")


@register("s12_ingest_atomicity", "SELECT true AS failed, 0::BIGINT AS n_after, (SELECT count(*) FROM nation) AS n_nodes")
def s12_ingest_atomicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which one hangs in the air: none is kept."""
    engine = Engine(spark, scratch.folder(spark))
    nation = table(spark, sf_dir, "nation")
    engine.import_nodes("Nation", _csv(nation.select((F.col("n_nationkey") + 1).alias("id"), "n_name")), id_column="id")
    edges = _csv(nation.select((F.col("n_nationkey") + 1).alias("a"), (F.col("n_nationkey") + 2).alias("b")))
    failed = _fails(lambda: engine.import_edges("NEXT", edges, source_id_column="a", target_id_column="b"))
    return engine.query("SELECT (SELECT count(*) FROM graph_edges) AS n_after, (SELECT count(*) FROM graph_nodes) AS n_nodes").df.withColumn("failed", F.lit(failed))


@register("s13_executemany", "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'odd' END AS name FROM nation WHERE n_nationkey <> 3")
def s13_executemany(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE TABLE places (id INTEGER PRIMARY KEY, name TEXT)")
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("n")).collect()]
    engine.executemany("INSERT INTO places (id, name) VALUES ($i, $n)", rows)
    engine.executemany("UPDATE places SET name = $n WHERE id = $i", [{"i": r["i"], "n": "odd"} for r in rows if r["i"] % 2])
    engine.executemany("DELETE FROM places WHERE id = $i", [{"i": 3}])
    return engine.query("SELECT id, name FROM places").df


@register("s14_result_rows", "SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation ORDER BY n_name LIMIT 7")
def s14_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.register("nation", table(spark, sf_dir, "nation"))
    found = engine.query("SELECT n_name AS name, n_regionkey AS region FROM nation ORDER BY n_name LIMIT 7")
    return spark.createDataFrame(list(found.rows), ", ".join(f"{c} {k}" for c, k in zip(found.columns, ("string", "bigint"), strict=True)))


@register("q1_translated_sql", "SELECT o_orderkey::VARCHAR AS k, o_orderpriority AS p FROM orders WHERE o_orderdate < DATE '1993-01-01' AND o_orderpriority ILIKE '%high%'")
def q1_translated_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT o_orderkey::TEXT AS k, o_orderpriority AS p FROM orders WHERE o_orderdate < DATE '1993-01-01' AND o_orderpriority ILIKE '%high%' -- :x $y"
    sqltext.translate_sql(text)
    return run_sql(spark, sf_dir, text)


_ADMITTED = (
    ("SELECT 1", True), ("WITH a AS (SELECT 1 AS x) SELECT x FROM a", True), ("INSERT INTO t VALUES (1)", True), ("UPDATE t SET a = 1", True), ("DELETE FROM t", True),
    ("CREATE TABLE t (a INTEGER)", True), ("DROP TABLE t", False), ("MERGE INTO t USING u ON true", False), ("PRAGMA x", False), ("", False), ("SELECT 1; SELECT 2", False),
    ("WITH RECURSIVE a AS (SELECT 1) SELECT * FROM a", False), ("WITH a AS (DELETE FROM t) SELECT 1", False), ("SELECT 'open", False),
)


@register("q2_admission", _values(list(_ADMITTED), "statement, admitted"))
def q2_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is admitted (Q2), recursion (Q3) and writing CTEs (Q11) among what isn't."""
    return spark.createDataFrame([(q, not _fails(lambda q=q: sqltext.translate_sql(q))) for q, _ in _ADMITTED], "statement string, admitted boolean")


_SHAPES = (
    ("SELECT DISTINCT a FROM t JOIN u ON t.a = u.a ORDER BY a LIMIT 2", "SELECT", 0, 1, 0, 0, 0, True, True, False, True),
    ("WITH x AS (SELECT a, count(*) AS n FROM t GROUP BY a), y AS (SELECT 1) SELECT max(n) OVER () FROM x", "SELECT", 2, 0, 2, 1, 0, False, False, False, False),
    ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u ORDER BY b LIMIT 1) GROUP BY a", "SELECT", 0, 0, 0, 0, 1, False, False, True, False),
    ("DELETE FROM t WHERE a = 'JOIN COUNT(x)'", "DELETE", 0, 0, 0, 0, 0, False, False, False, False),
)


@register("q4_shape", _values(list(_SHAPES), "text, statement, ctes, joins, aggregates, windows, exists_n, ordered, limited, grouped, is_distinct"))
def q4_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text, *_ in _SHAPES:
        x = sqltext.shape(text)
        rows.append((text, x.statement, x.cte_count, x.join_count, x.aggregate_count, x.window_count, x.exists_count, x.has_order_by, x.has_limit, x.has_group_by, x.has_distinct))
    return spark.createDataFrame(rows, "text string, statement string, ctes int, joins int, aggregates int, windows int, exists_n int, ordered boolean, limited boolean, grouped boolean, is_distinct boolean")


@register("q6_unique_index", "SELECT n_regionkey::BIGINT AS region, count(*) AS n, true AS refused FROM nation GROUP BY n_regionkey")
def q6_unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE TABLE places (name TEXT, region INTEGER)")
    engine.query("CREATE UNIQUE INDEX by_name ON places (name)")
    engine.register("nation", table(spark, sf_dir, "nation"))
    engine.query("INSERT INTO places SELECT n_name, n_regionkey FROM nation")
    refused = _fails(lambda: engine.query("INSERT INTO places SELECT n_name, 99 FROM nation WHERE n_nationkey = 5"))
    return engine.query("SELECT region, count(*) AS n FROM places GROUP BY region").df.withColumn("refused", F.lit(refused))


_ROUTED = (("SELECT a, count(*) FROM t GROUP BY a", "olap"), ("SELECT a, count(*) FROM t JOIN u ON t.a = u.a GROUP BY a", "olap"), ("SELECT count(*) FROM t", "row"), ("SELECT DISTINCT t.a FROM t JOIN u ON t.a = u.a", "row"))


@register("q13_rules", _values(list(_ROUTED), "statement, route"))
def q13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = routing.Rules(True, routing.Rule(), (routing.Rule(require_group_by=True), routing.Rule(min_window_count=2)))
    return spark.createDataFrame([(q, routing.classify_sql(sqltext.shape(q), rules).route) for q, _ in _ROUTED], "statement string, route string")


_REFUSED = (
    "MATCH (a) WITH a RETURN a.id", "OPTIONAL MATCH (a) RETURN a.id", "MERGE (a:A)", "UNWIND [1] AS x RETURN x", "MATCH (a) WHERE NOT a.x = 1 RETURN a.id", "MATCH (a:A:B) RETURN a.id",
    "MATCH (a)-[r]->(b)-[s]->(c) RETURN a.id", "MATCH (a), (b) RETURN a.id", "MATCH (a) RETURN b.id", "MATCH (a) RETURN a", "MATCH (a)-[r*2]->(b) RETURN a.id", "CREATE (a)",
)


@register("c17_rejections", _values([(q, True) for q in _REFUSED] + [("MATCH (a:A) RETURN a.id", False)], "statement, refused"))
def c17_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    asked = [*_REFUSED, "MATCH (a:A) RETURN a.id"]
    return spark.createDataFrame([(q, _fails(lambda q=q: engine.query(q))) for q in asked], "statement string, refused boolean")


@register("g3_repeated_alias", _values([(1, "SELF", 1)], "a_id, r_type, b_id"))
def g3_repeated_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE (a:User {name: 'A'})-[:SELF]->(a)")
    return _named(engine.query("MATCH (a:User)-[r:SELF]->(b) RETURN a.id, r.type, b.id").df)


@register("g4_three_patterns", _values([("B", "R", "A", 1.5)], "a_name, r_type, b_name, r_w"))
def g4_three_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE (x:N {name: 'A'}), (y:N {name: $n}), (y)-[:R {w: 1.5}]->(x)", {"n": "B"})
    return _named(engine.query("MATCH (a:N)-[r:R]->(b:N) RETURN a.name, r.type, b.name, r.w").df, a_name="string", b_name="string", r_w="real")


@register("g11_atomicity", _values([(1, 0)], "n_nodes, n_edges"))
def g11_atomicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failing statement or a transaction that is rolled back wrote is gone."""
    engine = Engine(spark, scratch.folder(spark))
    engine.query("CREATE (a:N {name: 'kept'})")
    _fails(lambda: engine.query("CREATE (a:N {v: $v, w: $v})", {"v": [1.0]}))
    engine.begin()
    engine.query("CREATE (a:N)-[:R]->(b:N)")
    engine.rollback()
    return engine.query("SELECT (SELECT count(*) FROM graph_nodes) AS n_nodes, (SELECT count(*) FROM graph_edges) AS n_edges").df


def _some_vectors(spark: SparkSession, sf_dir: str, many: int) -> list[tuple[int, list[float]]]:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < many).orderBy("vec_id").select("vec_id", "embedding").collect()
    return [(r[0], [float(x) for x in r[1]]) for r in rows]


@register("g12_vector_property", _knn_sql("cosine", 3, "e.vec_id < 4").replace("e.vec_id AS target_id", "e.vec_id + 1 AS node_id"))
def g12_vector_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of nodes, written by CREATE and SET (X21)."""
    engine = Engine(spark, scratch.folder(spark))
    vectors = _some_vectors(spark, sf_dir, 4)
    for i, v in vectors:
        engine.query("CREATE (n:Doc {k: $k, e: $v})", {"k": i, "v": vectors[3][1]})
    for i, v in vectors:
        engine.query(f"MATCH (n:Doc {{k: {i}}}) SET n.e = $v", {"v": v})
    out = engine.query("CALL db.index.vector.queryNodes('any', 3, $q) YIELD node, score RETURN node.id, score", {"q": _query(spark, sf_dir)}).df
    return out.select(F.col("`node.id`").alias("node_id"), F.round("score", 6).alias("score"))


@register("x7_delta_and_tombstones", _knn_sql("cosine", 10, "e.vec_id % 7 <> 1 OR e.vec_id >= 50"))
def x7_delta_and_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over some vectors; others come and some go after its snapshot."""
    engine = Engine(spark, scratch.folder(spark), ann_threshold=1_000_000)
    rows = _embeddings(spark, sf_dir).select("target_id", "embedding", "metadata")
    engine.insert_vector_frame(rows.filter("target_id % 10 <> 0"))
    engine.create_vector_index("one", "cosine")
    engine.build_vector_index("one")
    engine.insert_vector_frame(rows.filter("target_id % 10 = 0"))
    engine.delete_vectors([i for i in range(50) if i % 7 == 1])
    return _rounded(engine.search_vectors(_query(spark, sf_dir), top_k=10).df)


@register("x9_insert_vectors", "SELECT CASE WHEN vec_id < 3 THEN vec_id + 101 ELSE vec_id + 97 END AS target_id, vec_id < 3 AS automatic FROM embeddings WHERE vec_id < 4")
def x9_insert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors without an id and one with 100: ids go on after the largest."""
    engine = Engine(spark, scratch.folder(spark))
    v = [x for _, x in _some_vectors(spark, sf_dir, 4)]
    ids = engine.insert_vectors([v[0], {"embedding": v[1], "metadata": {"k": 1}}, v[2], (100, v[3])])
    return engine.vectors().select("target_id").join(spark.createDataFrame([(i, i != 100) for i in ids], "target_id bigint, automatic boolean"), "target_id")


@register("x10_delete_vectors", _knn_sql("dot", 5, "e.vec_id >= 40"))
def x10_delete_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _vector_engine(spark, sf_dir)
    engine.delete_vectors(list(range(40)))
    return _rounded(engine.search_vectors(_query(spark, sf_dir), top_k=5, metric="dot").df)


@register("x12_set_metadata", _knn_sql("cosine", 5, "e.vec_id < 60 AND e.vec_id % 3 = 0 AND e.label = 1"))
def x12_set_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _vector_engine(spark, sf_dir)
    engine.set_vector_metadata([(i, {"group": "third"}) for i in range(0, 60, 3)])
    return _rounded(engine.search_vectors(_query(spark, sf_dir), top_k=5, filters={"group": "third", "label": 1}).df)


@register("x14_preload", _knn_sql("l2", 5))
def x14_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _vector_engine(spark, sf_dir)
    if not engine.preload_vectors() or not engine.vectors_cached():
        raise RuntimeError("vectors weren't kept")
    return _rounded(engine.search_vectors(_query(spark, sf_dir), top_k=5, metric="l2").df)


@register("x17_write_hooks", _knn_sql("cosine", 6, "e.vec_id < 8 AND e.vec_id <> 3"))
def x17_write_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of SQL rows follow INSERT (X17), UPDATE (X18), DELETE (X19) and executemany (X20)."""
    engine = Engine(spark, scratch.folder(spark))
    vectors = _some_vectors(spark, sf_dir, 8)
    engine.query("CREATE TABLE docs (id INTEGER PRIMARY KEY, embedding BLOB)")
    engine.query("INSERT INTO docs (id, embedding) VALUES ($i, $e)", {"i": 0, "e": vectors[1][1]})
    engine.executemany("INSERT INTO docs (id, embedding) VALUES ($i, $e)", [{"i": i, "e": e} for i, e in vectors[1:]])
    engine.query("UPDATE docs SET embedding = $e WHERE id = 0", {"e": vectors[0][1]})
    engine.query("DELETE FROM docs WHERE id = 3")
    return _rounded(engine.query("SELECT id FROM docs ORDER BY embedding <=> $q LIMIT 6", {"q": vectors[0][1]}).df)


@register("x22_blob_codec", "SELECT vec_id, 4 * len(embedding) AS n_bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE vec_id < 20")
def x22_blob_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = [(i, V.encode_blob(v)) for i, v in _some_vectors(spark, sf_dir, 20)]
    return spark.createDataFrame([(i, len(b), round(sum(V.decode_blob(b)), 6)) for i, b in blobs], "vec_id bigint, n_bytes int, total double")


_INDEXES = (
    ("a", "cosine", "CREATE INDEX IF NOT EXISTS a ON docs USING ivfpq (embedding vector_cosine_ops) WITH (lists = 10)"),
    ("b", "dot", "CREATE INDEX b ON VECTOR(embedding) WITH (metric = 'dot')"),
    ("c", "l2", "CREATE VECTOR INDEX c IF NOT EXISTS FOR (p:Doc) ON (p.embedding) OPTIONS {indexConfig: {similarity: 'euclidean'}}"),
)


@register("l1_index_statements", _values([(n, m, "exact_only", True) for n, m, _ in _INDEXES], "name, metric, state, second_refused"))
def l1_index_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of CREATE INDEX (L1, L2, L4); a second name for a live metric is refused (L10)."""
    engine = Engine(spark, scratch.folder(spark))
    for _, _, text in _INDEXES:
        engine.query(text)
    refused = all(_fails(lambda m=m: engine.query(f"CREATE VECTOR INDEX other FOR {m}")) for _, m, _ in _INDEXES)
    return engine.query("SELECT * FROM tessera_vector_indexes").df.select("name", "metric", "state", F.lit(refused).alias("second_refused"))


_LIFE = ("created ready", "paused ready", "resumed ready", "dropped disabled", "refreshed ready", "rebuilt ready")


@register("l6_index_life", _values([(i, x) for i, x in enumerate(_LIFE)], "step, seen"))
def l6_index_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAUSE, RESUME (L6), DROP (L7), REFRESH, REBUILD (L5) and the states (L9, L10)."""
    engine = _vector_engine(spark, sf_dir)
    # Small tables lie below the least number of vectors that cells are fitted on.
    copies = _embeddings(spark, sf_dir).select((F.col("target_id") + 1_000_000).alias("target_id"), "embedding", "metadata")
    engine.insert_vector_frame(copies)
    seen = []
    texts = ("CREATE VECTOR INDEX one FOR cosine", "ALTER VECTOR INDEX one PAUSE MAINTENANCE", "ALTER VECTOR INDEX one RESUME MAINTENANCE", "DROP INDEX one", "REFRESH VECTOR INDEX one", "REBUILD VECTOR INDEX one")
    for word, text in zip((x.split()[0] for x in _LIFE), texts, strict=True):
        engine.query(text)
        state = engine.inspect_vector_index("one")
        if state["maintenance_paused"] != (word == "paused"):
            raise RuntimeError(f"maintenance after {text}")
        seen.append((len(seen), f"{word} {state['state']}"))
    return spark.createDataFrame(seen, "step bigint, seen string")


@register("l12_background_refresh", "SELECT 'ready' AS state, 2 * count(*) AS total_rows, 0 AS delta_rows, true AS waited FROM embeddings")
def l12_background_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth beyond the threshold (L11) starts a refresh in the background."""
    engine = _vector_engine(spark, sf_dir)
    engine.create_vector_index("one", "cosine")
    engine.insert_vector_frame(_embeddings(spark, sf_dir).select((F.col("target_id") + 1_000_000).alias("target_id"), "embedding", "metadata"))
    waited = engine.await_vector_index_refresh("one", 600.0)
    if engine.inspect_vector_index("one")["delta_rows"]:  # fewer than the least number of new rows: nothing was due
        engine.refresh_vector_index("one")
    return engine.vector_indexes().select("state", "total_rows", "delta_rows", F.lit(waited).alias("waited"))


@register("l13_admin_order", _values([("admin", True), ("with parameters", False)], "how, is_admin"))
def l13_admin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about indexes are recognised before any parsing, and only without parameters."""
    engine = Engine(spark, scratch.folder(spark))
    seen = [("admin", engine.query("SHOW VECTOR INDEXES").query_type == "vector"), ("with parameters", not _fails(lambda: engine.query("SHOW VECTOR INDEXES", {"x": 1})))]
    return spark.createDataFrame(seen, "how string, is_admin boolean")
