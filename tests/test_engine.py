"""End-to-end behaviour of the engine on literal rows."""

import pytest

from tessera.session import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def test_sql_writes_and_reads(engine, spark):
    engine.query("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, city TEXT, born DATE)")
    assert engine.query("INSERT INTO users (id, name, city) VALUES ($i, $n, 'Bonn'), (7, 'it''s', NULL)", {"i": 1, "n": "Ada"}).rowcount == 2
    assert engine.executemany("INSERT INTO users (name, born) VALUES ($n, $d)", [{"n": "x", "d": "2026-01-02"}, {"n": "y", "d": None}]).rowcount == 2
    assert engine.query("SELECT id, name FROM users ORDER BY city, id").rows == ((1, "Ada"), (7, "it's"), (8, "x"), (9, "y"))
    assert engine.query("SELECT id FROM users WHERE born = DATE '2026-01-02'").first() == (8,)
    assert engine.query("UPDATE users SET city = $c, name = upper(name) WHERE id > 7", {"c": "R"}).rowcount == 2
    assert engine.query("DELETE FROM users WHERE name = 'Y'").rowcount == 1
    assert engine.query("DELETE FROM users WHERE name = 'nobody'").rowcount == 0
    again = Engine(spark, engine.base_path)
    assert again.query("SELECT id, name, city FROM users ORDER BY id").rows == ((1, "Ada", "Bonn"), (7, "it's", None), (8, "X", "R"))
    assert again.query("SELECT count(*) AS n FROM users").columns == ("n",)


def test_constraints_leave_nothing_behind(engine):
    engine.query("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT NOT NULL)")
    engine.query("CREATE UNIQUE INDEX u ON t (a)")
    engine.query("INSERT INTO t VALUES (1, 'x')")
    for bad in ("INSERT INTO t VALUES (1, 'y')", "INSERT INTO t VALUES (2, NULL)", "INSERT INTO t VALUES (3, 'x')", "INSERT INTO t VALUES (4, 'z'), (4, 'w')"):
        with pytest.raises(ValueError):
            engine.query(bad)
    assert engine.query("SELECT id FROM t").rows == ((1,),)
    with pytest.raises(ValueError):
        engine.query("SELECT id FROM t WHERE a = $missing")
    with pytest.raises(ValueError):
        engine.query("SELECT id FROM t WHERE a = $p", ["x"])


def test_transactions(engine):
    engine.query("CREATE TABLE t (a INTEGER)")
    with pytest.raises(RuntimeError), engine.transaction():
        engine.query("INSERT INTO t VALUES (1)")
        assert engine.query("SELECT a FROM t").rows == ((1,),)
        raise RuntimeError
    assert engine.query("SELECT a FROM t").rows == ()
    with engine.transaction():
        engine.query("INSERT INTO t VALUES (2)")
        with pytest.raises(RuntimeError):
            engine.begin()
    assert engine.query("SELECT a FROM t").rows == ((2,),)


@pytest.fixture
def people(engine):
    engine.query("CREATE (a:P {name: 'A', v: 1})")
    engine.query("CREATE (a:P {name: 'B', v: 1.0})")
    engine.query("CREATE (a:P {name: 'C', v: true})")
    engine.query("CREATE (a:P {name: 'D', v: 'one'})")
    engine.query("CREATE (a:P {name: 'E', v: null})")
    engine.query("CREATE (a:P {name: 'F'})")
    return engine


def names(engine, text, params=None):
    return [r[0] for r in engine.query(text, params).rows]


def test_typed_comparisons(people):
    q = lambda where: sorted(names(people, f"MATCH (n:P) WHERE {where} RETURN n.name"))
    assert q("n.v = 1") == ["A"] and q("n.v = 1.0") == ["B"] and q("n.v = true") == ["C"]
    assert q("n.v = 1 OR n.name = 'F'") == ["A", "B", "C", "F"]
    assert q("n.v >= 1") == ["A", "B", "C"] and q("n.v < 1") == []
    assert q("n.v IS NULL") == ["E", "F"] and q("n.v = null") == ["E"] and q("n.v IS NOT NULL") == ["A", "B", "C", "D"]
    assert q("n.v STARTS WITH ''") == ["D"] and q("n.v CONTAINS 'n' AND n.v ENDS WITH 'e'") == ["D"]
    with pytest.raises(ValueError):
        q("n.v > 'a'")
    assert names(people, "MATCH (n:P {v: 1}) RETURN n.name") == ["A"]
    order = [r[0] for r in people.query("MATCH (n:P) RETURN n.v ORDER BY n.v").rows]
    assert order[:2] == [None, None] and order[2] == "one" and {1, 1.0, True} >= set(order[3:])
    assert people.query("MATCH (n:P) RETURN n.v ORDER BY n.v DESC SKIP 4").rows == ((None,), (None,))


def test_named_relationship_keeps_or_strict(engine):
    engine.query("CREATE (a:P {v: 1})-[:R {w: 1}]->(b:P {v: 2})")
    assert engine.query("MATCH (a)-[r:R]->(b) WHERE r.w = 1.0 OR b.v = 9 RETURN a.id").rows == ()
    assert engine.query("MATCH (a)-[:R]->(b) WHERE a.v = 1.0 OR b.v = 9 RETURN a.v").rows == ((1,),)


def test_graph_writes(engine):
    assert engine.query("CREATE (a:U {name: 'A'})-[r:K {since: 1}]->(b:U {name: 'B'})").rows == ((1, 1, 2),)
    assert engine.query("CREATE (a:U)<-[:K]-(a)").rows == ((3, 2, 3),)
    assert engine.query("CREATE (a:X), (b:Y), (b)-[:Z]->(a)").rows == ((5, 3, 4),)
    assert engine.query("MATCH (u:U) SET u.seen = true, u.name = $n", {"n": "Q"}).rowcount == 3
    assert engine.query("MATCH (a:U)-[r:K {since: 1}]->(b) SET r.since = 2").rowcount == 1
    assert engine.query("MATCH (a)-[r:K]->(b) RETURN r.since ORDER BY r.since").rows == ((None,), (2,))
    assert engine.query("MATCH (x:X) CREATE (x)-[:NEW]->(n:N {k: 1})").rowcount == 1
    assert engine.query("MATCH (a:X), (b:Y) CREATE (a)-[:BOTH {p: 2.5}]->(b)").rowcount == 1
    assert engine.query("MATCH (a:X)-[r]->(b) RETURN r.type, b.label, r.p ORDER BY r.id").rows == (("NEW", "N", None), ("BOTH", "Y", 2.5))
    assert engine.query("MATCH (a)-[r:BOTH]->(b) DELETE r").rowcount == 1
    assert engine.query("MATCH (u:U) DETACH DELETE u").rowcount == 3
    assert engine.query("MATCH (a)-[r]->(b) RETURN r.type ORDER BY r.id").rows == (("Z",), ("NEW",))
    assert engine.query("CREATE (n:U)").rows == ((7,),)
    assert engine.query("SELECT count(*) AS n FROM graph_node_properties WHERE key = 'k' AND value_type = 'integer'").rows == ((1,),)
    for bad in ("CREATE (n)", "CREATE (a:A)-[r]->(b:B)", "CREATE (a:A {x: 1})-[:R]->(a:B)", "MATCH (n:N) CREATE (a:A)-[:R]->(b:B)", "MATCH (n) SET n.id = 3"):
        with pytest.raises(ValueError):
            engine.query(bad)


def test_distinct_orders_by_value(engine):
    for v in ("'b'", "2", "'a'", "2", "2.0"):
        engine.query(f"CREATE (n:D {{v: {v}}})")
    got = [r[0] for r in engine.query("MATCH (n:D) RETURN DISTINCT n.v").rows]
    assert got[:2] == ["a", "b"] and len(got) == 4
    with pytest.raises(ValueError):
        engine.query("MATCH (n:D) RETURN DISTINCT n.v ORDER BY n.id")


def test_vectors(engine):
    assert engine.insert_vectors([[1.0, 0.0], (9, [0.9, 0.1]), {"embedding": [0.0, 1.0], "metadata": {"k": "a", "n": 1}}, [0.0, 0.0]]) == [10, 9, 11, 12]
    assert [r[2] for r in engine.search_vectors([1.0, 0.0], top_k=2).rows] == [10, 9]
    assert engine.search_vectors([1.0, 0.0]).rows[-1][3] == 0.0
    assert [r[2:] for r in engine.search_vectors([1.0, 0.0], top_k=1, metric="l2").rows] == [(10, 0.0)]
    assert [r[2] for r in engine.search_vectors([0.0, 1.0], filters={"k": "a", "n": 1}).rows] == [11]
    assert engine.search_vectors([0.0, 1.0], filters={"n": 1.0}).rows == () and engine.search_vectors([0.0, 1.0], filters={}).rows == ()
    assert engine.set_vector_metadata([(9, {"k": "a"}), {"target_id": 11, "metadata": {"n": 2}}]) == 2
    assert sorted(r[2] for r in engine.search_vectors([0.0, 1.0], filters={"k": "a"}).rows) == [9, 11]
    assert engine.delete_vectors([9, 9, 77]) == 1
    for bad in (lambda: engine.insert_vectors([[1.0]]), lambda: engine.insert_vectors([(10, [1.0, 2.0])]), lambda: engine.search_vectors([0.0, 0.0]), lambda: engine.search_vectors([1.0, 0.0], top_k=0), lambda: engine.search_vectors([1.0, 0.0], metric="x"), lambda: engine.set_vector_metadata([(77, {"k": 1})]), lambda: engine.insert_vectors([[]])):
        with pytest.raises(ValueError):
            bad()
    assert engine.preload_vectors() and engine.vectors_cached()
    assert [r[2] for r in engine.search_vectors([1.0, 0.0], top_k=1).rows] == [10]


def test_sql_and_graph_vectors(engine):
    engine.query("CREATE TABLE docs (id INTEGER PRIMARY KEY, topic TEXT, embedding BLOB)")
    engine.executemany("INSERT INTO docs (topic, embedding) VALUES ($t, $e)", [{"t": "a", "e": [1.0, 0.0]}, {"t": "b", "e": [0.0, 1.0]}, {"t": "a", "e": [0.6, 0.8]}])
    q = "SELECT id FROM docs WHERE topic = $t ORDER BY embedding <=> $q LIMIT $k"
    assert engine.query(q, {"t": "a", "q": [0.0, 1.0], "k": 5}).rows[0][:3] == ("sql_row", "docs", 3)
    engine.query("UPDATE docs SET embedding = $e WHERE id = 1", {"e": [0.0, 2.0]})
    assert [r[2] for r in engine.query(q, {"t": "a", "q": [0.0, 1.0], "k": 1}).rows] == [1]
    engine.query("DELETE FROM docs WHERE id = 1")
    engine.query("CREATE (n:P {e: $v, g: 1})-[:R]->(m:P {e: $w})", {"v": [1.0, 0.0], "w": [0.0, 1.0]})
    call = "CALL db.index.vector.queryNodes('none', 5, $q) YIELD node, score "
    assert engine.query(call + "RETURN node.id, score ORDER BY score", {"q": [0.0, 1.0]}).rows == ((1, 0.0), (2, 1.0))
    assert engine.query(call + "WHERE node.g = 1 RETURN node.id", {"q": [0.0, 1.0]}).rows == ((1,),)
    assert engine.query(call + "MATCH (x)-[:R]->(node:P) RETURN node.id", {"q": [0.0, 1.0]}).rows == ((2,),)
    with pytest.raises(ValueError):
        engine.query("CREATE (n:P {a: $v, b: $v})", {"v": [1.0, 0.0]})


def test_index_lifecycle(engine, spark):
    engine.ann_threshold = 256
    from pyspark.sql import functions as F

    angle = F.col("id") * 0.0241
    engine.insert_vector_frame(spark.range(300).select(F.col("id").alias("target_id"), F.array(F.cos(angle), F.sin(angle)).cast("array<float>").alias("embedding")))
    engine.query("CREATE VECTOR INDEX IF NOT EXISTS one FOR cosine")
    for bad in ("CREATE VECTOR INDEX two FOR cosine", "CREATE VECTOR INDEX one FOR cosine", "DROP INDEX none", "REFRESH VECTOR INDEX none"):
        with pytest.raises(ValueError):
            engine.query(bad)
    engine.query("CREATE VECTOR INDEX IF NOT EXISTS one FOR cosine")
    assert engine.inspect_vector_index("one")["state"] == "ready"
    exact = {r[2] for r in engine.search_vectors([1.0, 0.2], top_k=10, metric="l2").rows}
    near = {r[2] for r in engine.search_vectors([1.0, 0.2], top_k=10).rows}
    assert len(exact & near) >= 9
    engine.insert_vectors([(999, [1.0, 0.2])])
    engine.delete_vectors([8])
    assert engine.search_vectors([1.0, 0.2], top_k=3).rows[0][2] == 999
    state = engine.inspect_vector_index("one")
    assert (state["delta_rows"], state["tombstone_rows"], state["total_rows"]) == (1, 1, 300)
    assert engine.query("ALTER VECTOR INDEX one PAUSE MAINTENANCE").df.first()["maintenance_paused"]
    engine.query("REFRESH VECTOR INDEX one")
    assert engine.inspect_vector_index("one")["delta_rows"] == 0
    engine.query("DROP INDEX one")
    assert engine.inspect_vector_index("one")["state"] == "disabled"
    assert engine.query("SHOW VECTOR INDEXES").columns[:2] == ("name", "metric")
    engine.query("CREATE INDEX three ON docs USING ivfpq (embedding vector_l2_ops) WITH (x = 1)")
    assert Engine(spark, engine.base_path).inspect_vector_index("three")["metric"] == "l2"


def test_csv_ingest(engine, tmp_path):
    f = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    engine.query("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, city TEXT, active BOOLEAN)")
    assert engine.import_table("users", f("u.csv", 'ignored,name,id,active\nz,"A, b",1,yes\n\nz,,2,FALSE\n'), columns=["id", "name", "active"]) == 2
    assert engine.query("SELECT * FROM users ORDER BY id").rows == ((1, "A, b", None, True), (2, "", None, False))
    assert engine.import_table("users", f("h.csv", "5;x\n"), columns=["id", "name"], header=False, delimiter=";") == 1
    for name, text in (("few.csv", "id,name\n8\n"), ("many.csv", "id,name\n8,a,b\n"), ("dup.csv", "id,name\n8,a\n8,b\n"), ("old.csv", "id,name\n1,a\n"), ("col.csv", "id,other\n8,a\n")):
        with pytest.raises(Exception):
            engine.import_table("users", f(name, text))
    assert engine.query("SELECT count(*) AS n FROM users").rows == ((3,),)
    nodes = f("n.csv", "id,name,age,active\n10,Ann,3,true\n11,Bob,4,no\n")
    assert engine.import_nodes("U", nodes, id_column="id", property_columns=["name", "age", "active"], property_types={"age": "integer", "active": "boolean"}) == 2
    assert engine.query("MATCH (u:U) WHERE u.age > 3 RETURN u.name, u.active").rows == (("Bob", False),)
    edges = f("e.csv", "a,b,since\n10,11,1999\n11,10,2000\n")
    assert engine.import_edges("K", edges, source_id_column="a", target_id_column="b", property_columns=["since"], property_types={"since": "integer"}) == 2
    assert engine.query("MATCH (x)-[r:K]->(y) RETURN r.id, x.id, r.since ORDER BY r.id").rows == ((1, 10, 1999), (2, 11, 2000))
    with pytest.raises(ValueError):
        engine.import_edges("K", f("dangling.csv", "a,b\n10,99\n"), source_id_column="a", target_id_column="b")
    with pytest.raises(ValueError):
        engine.import_nodes("U", nodes, id_column="id")
    with pytest.raises(Exception):
        engine.import_nodes("U", f("bad.csv", "id,age\n20,x\n"), id_column="id", property_columns=["age"], property_types={"age": "integer"})
    assert engine.query("MATCH (x)-[r:K]->(y) RETURN r.id").rows == ((1,), (2,))
    assert engine.query("CREATE (n:U)").rows == ((12,),)
