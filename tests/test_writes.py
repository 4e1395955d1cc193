"""Parameters and literals, views, folder-level writes, vacuum, background refresh, CSV quoting and workload rules."""

import itertools

import pytest

from tessera import Engine
from tessera.plans import reads, routing, sqltext


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), ann_threshold=256)
    yield e
    e.close()


def test_parameters_leave_literals_alone(engine):
    engine.query("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    engine.query("INSERT INTO t VALUES (1, 'a:n'), (2, ':n'), (3, 'it''s :n')")
    assert engine.query("UPDATE t SET name = 'hit' WHERE name = 'a:n' AND id = $n", {"n": 1}).rowcount == 1
    assert engine.query("UPDATE t SET name = 'x:n' || $n WHERE id = 2", {"n": "'; DROP TABLE t --"}).rowcount == 1
    assert engine.query("DELETE FROM t WHERE name = 'it''s :n' AND id = $n", {"n": 3}).rowcount == 1
    engine.query("INSERT INTO t VALUES ($n + 1, ':n $n' || $m)", {"n": 8, "m": "\\ ' \" $n :n"})
    assert engine.query("SELECT id, name FROM t ORDER BY id").rows == ((1, "hit"), (2, "x:n'; DROP TABLE t --"), (9, ":n $n\\ ' \" $n :n"))
    assert engine.query("SELECT id FROM t WHERE name = $v", {"v": "hit"}).rows == ((1,),)


def test_reads_leave_no_view_behind(engine, spark):
    spark.createDataFrame([(7,)], "id long").createOrReplaceTempView("t")
    engine.query("CREATE TABLE t (id INTEGER, t TEXT)")
    engine.query("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    before = sorted(x.name for x in spark.catalog.listTables())
    assert engine.query("SELECT t.id, t FROM t ORDER BY t.id DESC").rows == ((2, "b"), (1, "a"))
    assert engine.query("WITH t AS (SELECT id FROM t WHERE id = 2), u AS (SELECT id FROM t) SELECT u.id FROM u JOIN t x ON x.id = u.id").rows == ((2,),)
    assert engine.query("SELECT a.id FROM t a, t AS b WHERE a.id = b.id AND EXISTS (SELECT 1 FROM t WHERE t.id = a.id AND t.t = 'a')").rows == ((1,),)
    assert sorted(x.name for x in spark.catalog.listTables()) == before
    assert [r.id for r in spark.sql("SELECT id FROM t").collect()] == [7]
    with pytest.raises(Exception):
        engine.query("SELECT nothing FROM t")
    assert sorted(x.name for x in spark.catalog.listTables()) == before
    spark.catalog.dropTempView("t")
    with pytest.raises(ValueError):
        reads.run(spark, "SELECT $x", {}, {})


def test_table_references():
    found = lambda q: [sqltext.tokens(q)[i].text for i in sqltext.table_references(sqltext.tokens(q))]
    assert found("SELECT * FROM a, b x JOIN c ON a.i = c.i WHERE EXISTS (SELECT 1 FROM d) ORDER BY 1, 2") == ["a", "b", "c", "d"]
    assert found("SELECT extract(day FROM e) FROM f WHERE a IS DISTINCT FROM g") == ["f"]
    assert found("SELECT x.k FROM (SELECT a FROM c INTERSECT SELECT b FROM s) x, range(3) r, db.t, q") == ["c", "s", "q"]
    assert found("WITH t AS (SELECT * FROM t), u AS (SELECT 1 FROM t) SELECT (SELECT max(b) FROM n) FROM u LEFT JOIN w ON true") == ["t", "n", "w"]


def test_writes_touch_only_the_folders_that_they_change(engine):
    engine.query("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT NOT NULL, b INTEGER)")
    for i in range(3):
        engine.query(f"INSERT INTO t VALUES ({2 * i + 1}, 'x', 0), ({2 * i + 2}, 'y', 0)")
    paths = list(engine.catalog.entry("t")["paths"])
    assert engine.query("UPDATE t SET b = b + 1 WHERE id = 3").rowcount == 1
    after = engine.catalog.entry("t")["paths"]
    assert [p for p in paths if p in after] == [paths[0], paths[2]] and len(after) == 3
    assert engine.query("DELETE FROM t WHERE id IN (1, 2)").rowcount == 2
    assert paths[2] in engine.catalog.entry("t")["paths"]
    assert engine.executemany("UPDATE t SET b = $b WHERE id = $i", [{"i": 5, "b": 9}, {"i": 77, "b": 1}]).rowcount == 1
    assert engine.query("SELECT id, a, b FROM t ORDER BY id").rows == ((3, "x", 1), (4, "y", 0), (5, "x", 9), (6, "y", 0))
    assert sum(engine.catalog.entry("t")["rows"].values()) == 4
    for bad in ("UPDATE t SET id = 4 WHERE id = 3", "UPDATE t SET id = 6 WHERE id < 5", "UPDATE t SET a = NULL WHERE id = 5"):
        with pytest.raises(ValueError):
            engine.query(bad)
    assert engine.query("DELETE FROM t").rowcount == 4 and engine.query("SELECT id FROM t").rows == ()
    engine.query("INSERT INTO t VALUES (1, 'z', 1)")
    assert engine.query("SELECT id FROM t").rows == ((1,),)


def test_vacuum_keeps_what_is_needed(engine, spark):
    engine.query("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT)")
    for i in range(4):
        engine.query("INSERT INTO t (a) VALUES ('x')")
        engine.query("UPDATE t SET a = a || 'y'")
    engine.query("CREATE (n:N {k: 1})")
    assert engine.vacuum() > 0 and engine.vacuum() == 0
    again = Engine(spark, engine.base_path)
    assert again.query("SELECT count(*) AS n FROM t").rows == ((4,),) and again.query("MATCH (n:N) RETURN n.k").rows == ((1,),)
    with pytest.raises(RuntimeError), engine.transaction():
        engine.vacuum()


def fill(engine, spark, first, many):
    from pyspark.sql import functions as F

    angle = F.col("id") * 0.0241
    engine.insert_vector_frame(spark.range(first, first + many).select(F.col("id").alias("target_id"), F.array(F.cos(angle), F.sin(angle)).cast("array<float>").alias("embedding")))


def test_background_refresh(engine, spark):
    fill(engine, spark, 0, 300)
    engine.create_vector_index("one", "cosine")
    assert engine.inspect_vector_index("one")["snapshot_generation"] == 1
    engine.pause_vector_index("one")
    fill(engine, spark, 300, 300)
    assert engine.await_vector_index_refresh("one", 0.0)
    state = engine.inspect_vector_index("one")
    assert (state["delta_rows"], state["snapshot_generation"], state["maintenance_paused"]) == (300, 1, True)
    engine.resume_vector_index("one")  # what was due is made up for
    assert engine.await_vector_index_refresh("one", 120.0)
    state = engine.inspect_vector_index("one")
    assert (state["delta_rows"], state["snapshot_rows"], state["snapshot_generation"], state["state"]) == (0, 600, 2, "ready")
    engine.drop_vector_index("one")
    fill(engine, spark, 600, 300)
    assert engine.await_vector_index_refresh("one") and engine.inspect_vector_index("one")["state"] == "disabled"
    assert Engine(spark, engine.base_path).search_vectors([1.0, 0.0], top_k=1).rows[0][2] == 0
    with pytest.raises(ValueError):
        engine.await_vector_index_refresh("none")


def test_a_small_index_is_built_when_it_has_grown(engine, spark):
    fill(engine, spark, 0, 10)
    engine.create_vector_index("one", "l2")
    assert engine.inspect_vector_index("one")["state"] == "exact_only"
    fill(engine, spark, 10, 400)
    assert engine.await_vector_index_refresh("one", 120.0) and engine.inspect_vector_index("one")["state"] == "ready"


def test_searches_see_rows_that_the_snapshot_lacks(engine, spark):
    fill(engine, spark, 0, 300)
    engine.query("CREATE TABLE docs (id INTEGER PRIMARY KEY, embedding BLOB)")
    engine.create_vector_index("one", "cosine")
    engine.insert_vectors([(1000, [0.5, -0.5])])
    assert engine.search_vectors([0.5, -0.5], top_k=1).rows[0][2] == 1000
    engine.delete_vectors([1000])
    assert engine.search_vectors([0.5, -0.5], top_k=1).rows[0][2] != 1000
    engine.query("CREATE (n:P {e: $v})", {"v": [0.0, 3.0]})
    assert engine.query("CALL db.index.vector.queryNodes('one', 2, $q) YIELD node, score RETURN node.id", {"q": [0.0, 1.0]}).rows == ((1,),)
    with pytest.raises(ValueError):
        engine.query("INSERT INTO docs (embedding) VALUES ($e)", {"e": [1.0, 2.0, 3.0]})
    plan = engine.search_vectors([1.0, 0.0], top_k=3).df._jdf.queryExecution().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan


def test_csv_fields_with_line_ends(engine, tmp_path):
    f = tmp_path / "q.csv"
    f.write_text('id,name\n1,"two\nlines, ""quoted"""\n\n2,plain\n')
    engine.query("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    assert engine.import_table("t", str(f)) == 2
    assert engine.query("SELECT id, name FROM t ORDER BY id").rows == ((1, 'two\nlines, "quoted"'), (2, "plain"))
    f.write_text('id,name\n3,"open\n4,x,y\n"\n5\n')
    with pytest.raises(Exception):
        engine.import_table("t", str(f))


def test_what_makes_a_read_analytical():
    flags = (False, True)
    for joins, aggregates, ctes, windows, exists, order, limit, group, distinct in itertools.product((0, 1, 2), (0, 1), (0, 1), (0, 1), (0, 1), flags, flags, flags, flags):
        s = sqltext.Shape("SELECT", True, ctes, joins, aggregates, windows, exists, order, limit, group, distinct)
        tail = order or limit
        reasons = {
            "window": windows,
            "exists": exists,
            "aggregate": aggregates and (group or distinct or joins or ctes or tail),
            "distinct join": distinct and joins,
            "cte": ctes and (joins or distinct or tail),
            "joins": joins >= 2 and (distinct or tail),
        }
        assert routing.analytical(s) == any(reasons.values()), (s, reasons)
