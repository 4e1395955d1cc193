"""Lexers, parsers, statement shapes and routing; no Spark jobs."""

import json

import pytest

from tessera.plans import cypher as C
from tessera.plans import routing, sqltext
from tessera.plans import statements as D
from tessera.session import vector_query


def test_to_spark_rewrites_only_outside_literals():
    got = sqltext.to_spark("SELECT \"a b\", 'it''s $x -- no' AS t FROM t WHERE x = $p -- $q\n AND y::TEXT = CAST(z AS INTEGER)")
    assert got == "SELECT `a b`, 'it\\'s $x -- no' AS t FROM t WHERE x = :p AND y::STRING = CAST(z AS BIGINT)"


def test_null_order_is_postgres():
    got = sqltext.to_spark("SELECT row_number() OVER (PARTITION BY a ORDER BY b, c DESC) FROM t ORDER BY f(x, y) DESC, z ASC NULLS FIRST LIMIT 3")
    assert "ORDER BY b NULLS LAST, c DESC NULLS FIRST)" in got
    assert got.endswith("ORDER BY f(x, y) DESC NULLS FIRST, z ASC NULLS FIRST LIMIT 3")


@pytest.mark.parametrize("text", ["DROP TABLE t", "WITH RECURSIVE x AS (SELECT 1) SELECT * FROM x", "", "SELECT 1; SELECT 2", "WITH x AS (DELETE FROM t) SELECT 1"])
def test_not_admitted(text):
    with pytest.raises(ValueError):
        sqltext.shape(text)


def test_shape_counts():
    s = sqltext.shape("WITH a AS (SELECT x FROM t ORDER BY x), b AS (SELECT 1 AS y) SELECT DISTINCT count(*), row_number() OVER (ORDER BY x) FROM a JOIN b ON a.x = b.y WHERE EXISTS (SELECT 1 FROM t LIMIT 1) GROUP BY x")
    assert (s.cte_count, s.join_count, s.aggregate_count, s.window_count, s.exists_count) == (2, 1, 1, 1, 1)
    assert (s.has_order_by, s.has_limit, s.has_group_by, s.has_distinct, s.read_only) == (False, False, True, True, True)
    assert not sqltext.shape("WITH a AS (SELECT 1 UNION ALL SELECT 2) SELECT * FROM a").read_only


def test_routing_rules(tmp_path, monkeypatch):
    s = sqltext.shape("SELECT a, count(*) FROM t GROUP BY a")
    assert routing.classify_sql(s, routing.Rules()).route == "row"
    file = tmp_path / "rules.json"
    file.write_text(json.dumps({"benchmark_calibrated": True, "rules": [{"min_aggregate_count": 1, "require_group_by": True}]}))
    monkeypatch.setenv(routing.RULES_VARIABLE, str(file))
    assert routing.classify_sql(s).route == "olap"
    assert routing.classify_sql(sqltext.shape("SELECT count(*) FROM t WHERE a = 1")).kind == "transactional_read"
    (tmp_path / "bad.json").write_text(json.dumps({"min_join_count": -1}))
    with pytest.raises(ValueError):
        routing.load_rules(str(tmp_path / "bad.json"))


def test_statements(spark):
    made = D.parse("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, day DATE, embedding BLOB, UNIQUE (name, day))")
    assert made.key == "id" and made.not_null == ("name",) and made.unique == (("name", "day"),)
    assert made.schema.simpleString() == "struct<id:bigint,name:string,day:date,embedding:array<float>>"
    assert D.parse("UPDATE t SET a = b + 1, c = 'x,y' WHERE d = (SELECT 1)") == D.Update("t", (("a", "b + 1"), ("c", "'x,y'")), "d = (SELECT 1)")
    assert D.parse("DELETE FROM t") == D.Delete("t", None)
    assert D.parse("INSERT INTO t (a, b) VALUES (1, f(2, 3)), ($x, NULL)").rows == (("1", "f(2, 3)"), ("$x", "NULL"))
    with pytest.raises(ValueError):
        D.parse("INSERT INTO t (a) VALUES (1, 2)")


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n) WHERE NOT n.a = 1 RETURN n.id",
        "MATCH (n) WHERE n.a <> 1 RETURN n.id",
        "MATCH (n:A:B) RETURN n.id",
        "MATCH (a)-[r]->(b)-[s]->(c) RETURN a.id",
        "MATCH (a)-[r*1..2]->(b) RETURN a.id",
        "MATCH (a), (b) RETURN a.id",
        "MATCH (n) RETURN m.id",
        "MATCH (n) RETURN n.id LIMIT 0",
        "MATCH (n) RETURN n.id SKIP -1",
        "MATCH (n) RETURN n.id LIMIT 1 SKIP 1",
        "MATCH (n) DELETE n",
        "MATCH (a)-[r]->(b) DETACH DELETE r",
        "OPTIONAL MATCH (n) RETURN n.id",
        "MERGE (n:A)",
        "MATCH (n) WHERE n.label > 'a' RETURN n.id",
        "MATCH (n) WHERE n.id IS NULL RETURN n.id",
        "MATCH (n) WHERE n.id STARTS WITH 'a' RETURN n.id",
        "MATCH (n) RETURN count(n)",
    ],
)
def test_cypher_rejections(text):
    with pytest.raises(ValueError):
        C.parse(text)


def test_cypher_shapes():
    s = C.parse("MATCH (b)<-[r:KNOWS|LIKES {w: 1.5}]-(a:User {name: 'it\\'s'}) WHERE (a.x = 1 OR b.y IS NOT NULL) AND r.z = $q RETURN DISTINCT a.name ORDER BY a.name DESC SKIP 2 LIMIT 3")
    path = s.match[0]
    assert (path.left.alias, path.right.alias, path.rel.types, path.left.props) == ("a", "b", ("KNOWS", "LIKES"), (("name", "it's"),))
    assert C.has_or(s.where) and s.result.order == (("a", "name", True),) and (s.result.skip, s.result.limit) == (2, 3)
    assert C.is_cypher("MATCH (n) RETURN n.id") and not C.is_cypher("match (n) return n.id")
    call = C.parse_vector_call("call db.index.vector.queryNodes('i', 3, $q) YIELD node, score WHERE node.a = 1 RETURN node.id, score ORDER BY score DESC")
    assert call.items == ("node.id", "score") and call.order == (("score", True),) and call.candidates.match[0].alias == "node"


def test_vector_query_shapes():
    assert vector_query("SELECT id FROM docs WHERE a = 1 ORDER BY embedding <#> $q LIMIT $k") == {"candidates": "SELECT id FROM docs WHERE a = 1 ", "table": "docs", "metric": "dot", "param": "q", "limit": "k"}
    assert vector_query("SELECT id FROM docs ORDER BY id") is None
    for bad in ("SELECT id FROM a JOIN b ON a.x = b.x ORDER BY embedding <=> $q LIMIT 3", "SELECT id FROM docs ORDER BY other <=> $q LIMIT 3", "SELECT id FROM docs ORDER BY embedding <=> $q"):
        with pytest.raises(ValueError):
            vector_query(bad)
