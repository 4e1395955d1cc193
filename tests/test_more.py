"""Batch writes, budgets, blobs, and a differential test of predicates against a naive evaluator."""

import random

import pytest

from tessera import Engine, RuntimeThreadBudget, configure_runtime_threads_from_env, translate_sql
from tessera.operators import vectors as V


def test_keyed_batches_make_one_version(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.query("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT, embedding BLOB)")
    e.executemany("INSERT INTO t (a, embedding) VALUES ($a, $e)", [{"a": str(i), "e": [1.0, float(i)]} for i in range(5)])
    before = e.catalog.state["version"]
    assert e.executemany("UPDATE t SET a = $a, embedding = $e WHERE id = $i", [{"i": 1, "a": "x", "e": [0.0, 1.0]}, {"i": 3, "a": None, "e": [2.0, 2.0]}, {"i": 99, "a": "y", "e": [1.0, 1.0]}]).rowcount == 2
    assert e.executemany("DELETE FROM t WHERE id = $i", [{"i": 2}, {"i": 5}]).rowcount == 2
    assert e.catalog.state["version"] == before + 2
    assert e.query("SELECT id, a FROM t ORDER BY id").rows == ((1, "x"), (3, None), (4, "3"))
    assert e.executemany("UPDATE t SET a = upper(a) || $s WHERE id > $i", [{"i": 0, "s": "!"}, {"i": 3, "s": "?"}]).rowcount == 4
    assert e.query("SELECT a FROM t ORDER BY id").rows == (("X!",), (None,), ("3!?",))
    for bad in ("SELECT 1", "MATCH (n) RETURN n.id", "CREATE TABLE u (a TEXT)"):
        with pytest.raises(ValueError):
            e.executemany(bad, [{}])


def test_budgets(monkeypatch):
    monkeypatch.setenv("TESSERA_THREADS", "3")
    monkeypatch.setenv("TESSERA_NATIVE_THREADS", "")
    assert configure_runtime_threads_from_env() == RuntimeThreadBudget(3, None)
    for bad in ("0", "x", "-1"):
        monkeypatch.setenv("TESSERA_THREADS", bad)
        with pytest.raises(ValueError):
            configure_runtime_threads_from_env()
    with pytest.raises(ValueError):
        RuntimeThreadBudget(True)


def test_blobs_and_translation():
    assert V.decode_blob(V.encode_blob([1.5, -2.0])) == [1.5, -2.0]
    for bad in (b"", b"abc"):
        with pytest.raises(ValueError):
            V.decode_blob(bad)
    assert translate_sql("SELECT a::TEXT FROM t ORDER BY a") == "SELECT a::STRING FROM t ORDER BY a NULLS LAST"
    with pytest.raises(ValueError):
        translate_sql("MERGE INTO t")


def number(v):
    return float(v) if isinstance(v, (bool, int, float)) else None


def naive(node, test, coerced):
    """Whether a node satisfies (key, op, value)."""
    key, op, value = test
    has, own = key in node, node.get(key)
    if op == "IS NULL":
        return own is None
    if op == "IS NOT NULL":
        return own is not None
    if op == "=":
        if value is None:
            return has and own is None
        if coerced and number(value) is not None:
            return number(own) == number(value)
        return type(own) is type(value) and own == value
    if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
        return isinstance(own, str) and {"STARTS WITH": str.startswith, "ENDS WITH": str.endswith, "CONTAINS": str.__contains__}[op](own, value)
    a, b = number(own), number(value)
    return a is not None and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def test_predicates_against_naive(spark, tmp_path):
    rng = random.Random(11)
    values = [0, 1, 2, -3, 1.0, 2.5, True, False, "a", "ab", "1", "", None]
    e = Engine(spark, str(tmp_path / "db"))
    nodes = [{k: rng.choice(values) for k in ("p", "q") if rng.random() < 0.8} for _ in range(40)]
    from tessera.functions import tagged as T

    rows = [(i, "N", {k: T.tagged(v) for k, v in n.items()}) for i, n in enumerate(nodes)]
    e.catalog.atomically(lambda: e._append_rows("__nodes", rows))

    def test():
        op = rng.choice(["=", "=", "<", "<=", ">", ">=", "STARTS WITH", "ENDS WITH", "CONTAINS", "IS NULL", "IS NOT NULL"])
        value = None if op.startswith("IS") else rng.choice([v for v in values if isinstance(v, str)]) if " " in op or op == "CONTAINS" else rng.choice(values if op == "=" else [v for v in values if number(v) is not None])
        return rng.choice(["p", "q"]), op, value

    def text(t):
        v = "" if t[1].startswith("IS") else "'" + t[2] + "'" if isinstance(t[2], str) else {True: "true", False: "false"}[t[2]] if isinstance(t[2], bool) else "null" if t[2] is None else repr(t[2])
        return f"n.{t[0]} {t[1]} {v}"

    for _ in range(25):
        a, b, c = test(), test(), test()
        for where, truth in (
            (f"{text(a)} AND {text(b)}", lambda n: naive(n, a, False) and naive(n, b, False)),
            (f"{text(a)} OR {text(b)} AND {text(c)}", lambda n: naive(n, a, True) or naive(n, b, True) and naive(n, c, True)),
            (f"({text(a)} OR {text(b)}) AND {text(c)}", lambda n: (naive(n, a, True) or naive(n, b, True)) and naive(n, c, True)),
        ):
            got = sorted(r[0] for r in e.query(f"MATCH (n:N) WHERE {where} RETURN n.id").rows)
            assert got == [i for i, n in enumerate(nodes) if truth(n)], where
