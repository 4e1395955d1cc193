"""The engine: one entry for SQL, graph and vector statements over one catalog of versioned tables."""

from __future__ import annotations

import concurrent.futures
import contextlib
import functools
import itertools
import json
import logging
import re
import threading
import uuid
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tagged as T
from .operators import graph as G
from .operators import vectors as V
from .plans import cypher as C
from .plans import reads, routing, sqltext
from .plans import statements as D
from .sources import csvfiles
from .sources.catalog import Catalog, Measured, with_dense_ids

log = logging.getLogger(__name__)
OPERATORS = {"<=>": "cosine", "<->": "l2", "<#>": "dot"}
_ID_NAMES = ("item_id", "id")
#: The columns of the index catalogue.
INDEX_COLUMNS = ("name", "metric", "enabled", "state", "total_rows", "indexed_rows", "snapshot_rows", "delta_rows", "tombstone_rows", "ann_threshold_rows", "refresh_in_progress", "snapshot_table", "snapshot_generation", "maintenance_paused")
_INDEX_DDL = "name string, metric string, enabled boolean, state string, total_rows bigint, indexed_rows bigint, snapshot_rows bigint, delta_rows bigint, tombstone_rows bigint, ann_threshold_rows bigint, refresh_in_progress boolean, snapshot_table string, snapshot_generation bigint, maintenance_paused boolean"
_OPS = {"vector_cosine_ops": "cosine", "vector_ip_ops": "dot", "vector_l2_ops": "l2", "cosine": "cosine", "dot": "dot", "ip": "dot", "inner_product": "dot", "l2": "l2", "euclidean": "l2"}


class QueryResult:
    """A lazy result: ``df`` is the plan, ``rows`` collects it once. Writes have no frame and a rowcount."""

    def __init__(self, df: DataFrame | None, query_type: str, workload: routing.Workload, rowcount: int = -1):
        self.df, self.query_type, self.workload, self._count = df, query_type, workload, rowcount

    @property
    def route(self) -> str:
        return self.workload.route

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.df.columns) if self.df is not None else ()

    @cached_property
    def rows(self) -> tuple[tuple, ...]:
        return tuple(tuple(_plain(x) for x in r) for r in self.df.collect()) if self.df is not None else ()

    @property
    def rowcount(self) -> int:
        return self._count

    def first(self) -> tuple | None:
        return self.rows[0] if self.rows else None


def _plain(value):
    if isinstance(value, Row) and set(value.__fields__) == {"t", "i", "d", "b", "s", "v"}:
        return T.untag(value)
    return value


class Engine:
    """``Engine(spark, base_path)`` opens or creates a store."""

    def __init__(self, spark: SparkSession, base_path: str, preload_vectors: bool = False, ann_threshold: int = 100_000):
        self.spark, self.base_path, self.ann_threshold = spark, base_path, ann_threshold
        self.catalog = Catalog(spark, base_path)
        self.views: dict[str, DataFrame] = {}
        self._cached: tuple[str, DataFrame] | None = None
        # A refresh in the background takes the lock to publish; a transaction holds it from begin to its end.
        self._lock = threading.RLock()
        self._pool = concurrent.futures.ThreadPoolExecutor(1, "tessera-index")
        self._refreshing: dict[str, concurrent.futures.Future] = {}
        self._known_cells: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        if preload_vectors:
            self.preload_vectors()

    # --- lifecycle -------------------------------------------------------------------------------------

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.catalog.in_transaction:
            self.rollback()
        self._pool.shutdown(wait=True)
        self._drop_cache()

    def begin(self) -> None:
        self._lock.acquire()
        try:
            self.catalog.begin()
        except BaseException:
            self._lock.release()
            raise

    def commit(self) -> None:
        self.catalog.commit()
        self._lock.release()
        self._drop_cache()
        self._maintain()

    def rollback(self) -> None:
        self.catalog.rollback()
        self._lock.release()
        self._drop_cache()

    def vacuum(self, versions: int = 1) -> int:
        """Remove what none of the last versions needs; returns how many folders went. Readers of older versions must have ended."""
        with self._lock:
            return self.catalog.vacuum(versions)

    @contextlib.contextmanager
    def transaction(self):
        """Commit at the end, roll back on an error. Transactions don't nest."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    def register(self, name: str, df: DataFrame) -> None:
        """Make a frame readable as a table of that name."""
        self.views[name] = df

    def _atomically(self, change):
        with self._lock:
            out = self.catalog.atomically(change)
        self._drop_cache()
        self._maintain()
        return out

    # --- statements ------------------------------------------------------------------------------------

    def query(self, text: str, params: dict | None = None) -> QueryResult:
        if params is not None and not isinstance(params, dict):
            raise ValueError("parameters are given by name")
        if not params:
            found = self._admin(text)
            if found is not None:
                return found
        if C.is_vector_call(text):
            return self._call(C.parse_vector_call(text), params)
        if C.is_cypher(text):
            return self._cypher(C.parse(text), params)
        parsed = vector_query(text)
        if parsed:
            return self._sql_vector(parsed, params)
        return self._sql(text, params)

    def executemany(self, text: str, params_seq: list[dict]) -> QueryResult:
        """Run one write for each set of parameters, all in one version."""
        params_seq = list(params_seq)
        if any(not isinstance(p, dict) for p in params_seq):
            raise ValueError("parameters are given by name")
        if C.is_cypher(text) or C.is_vector_call(text):
            raise ValueError("executemany is for SQL writes")
        s = sqltext.shape(text)
        if s.statement not in ("INSERT", "UPDATE", "DELETE"):
            raise ValueError("executemany is for SQL writes")
        work = routing.classify_sql(s)
        if not params_seq:
            return QueryResult(None, "sql", work, 0)
        stmt = D.parse(text)

        def change() -> int:
            if isinstance(stmt, D.Insert) and stmt.rows:
                return self._insert_values(stmt, params_seq)
            if not isinstance(stmt, D.Insert) and (keyed := _keyed(stmt)):
                return self._write_keyed(stmt, keyed, params_seq)
            return sum(self._write(stmt, p) for p in params_seq)

        return QueryResult(None, "sql", work, self._atomically(change))

    # --- SQL -------------------------------------------------------------------------------------------

    def _frames(self) -> dict[str, Callable[[], DataFrame]]:
        """What makes each table that a read may name."""
        cat = self.catalog
        frames = {n: (lambda df=df: df) for n, df in self.views.items()}
        frames |= {n: (lambda n=n: cat.frame(n)) for n in cat.names()}
        nodes, edges = (lambda: cat.frame("__nodes")), (lambda: cat.frame("__edges"))
        return frames | {
            "graph_nodes": lambda: nodes().select("id", "label"),
            "graph_edges": lambda: edges().select("id", "type", F.col("src").alias("from_node_id"), F.col("dst").alias("to_node_id")),
            "graph_node_properties": lambda: G.eav(nodes(), "node_id"),
            "graph_edge_properties": lambda: G.eav(edges(), "edge_id"),
        }

    def _run_sql(self, text: str, params: dict | None) -> DataFrame:
        return reads.run(self.spark, text, self._frames(), params)

    def _sql(self, text: str, params: dict | None) -> QueryResult:
        s = sqltext.shape(text)
        work = routing.classify_sql(s)
        if s.statement == "SELECT":
            return QueryResult(self._run_sql(text, params), "sql", work)
        stmt = D.parse(text)
        if stmt is None:
            raise ValueError("a CTE that writes is not supported")
        return QueryResult(None, "sql", work, self._atomically(lambda: self._write(stmt, params)))

    def _write(self, stmt, params: dict | None) -> int:
        cat = self.catalog
        if isinstance(stmt, D.CreateTable):
            exists = any(n.lower() == stmt.table.lower() for n in cat.names())
            if exists and stmt.if_not_exists:
                return 0
            cat.create(stmt.table, stmt.schema, stmt.key, stmt.not_null, stmt.unique)
            return 0
        if isinstance(stmt, D.CreateIndex):
            entry = cat.entry(stmt.table)
            known = {f["name"].lower() for f in entry["schema"]["fields"]}
            if any(c.lower() not in known for c in stmt.columns):
                raise ValueError("an index column doesn't exist")
            if stmt.unique and list(stmt.columns) not in entry["unique"]:
                entry["unique"].append(list(stmt.columns))
                cat.check(stmt.table, cat.frame(stmt.table), None, [], set(stmt.columns))
            return 0
        if isinstance(stmt, D.Insert):
            if stmt.rows:
                return self._insert_values(stmt, [params or {}])
            rows = self._run_sql(stmt.query, params)
            names = list(stmt.columns or self.catalog.schema(stmt.table).names)
            if len(rows.columns) != len(names):
                raise ValueError("the query's columns don't fit the table's")
            return self._insert(stmt.table, rows.toDF(*names))
        frame = cat.located(stmt.table)
        where = stmt.where
        hit = F.coalesce(self._expr(where, params), F.lit(False)) if where else F.lit(True)
        return self._change(stmt, lambda rows: rows.withColumn("__hit", hit), frame, {c: self._expr(v, params) for c, v in getattr(stmt, "sets", ())})

    def _change(self, stmt, mark: Callable[[DataFrame], DataFrame], located: DataFrame, values: dict[str, Column]) -> int:
        """DELETE or UPDATE of the rows that ``mark`` gives a true __hit: only the folders that hold one are written anew.

        values: what each column that is set gets, in terms of the marked rows.
        """
        cat = self.catalog
        columns = cat.schema(stmt.table).names
        names = {n.lower(): n for n in columns}
        for column in values:
            if column.lower() not in names:
                raise ValueError(f"no column {column!r}")
        found = cat.folders(stmt.table, mark(located).filter("__hit"))
        many = sum(found.values())
        if not many:
            return 0
        rows = mark(cat.frame(stmt.table, list(found)))
        if isinstance(stmt, D.Delete):
            cat.replace(stmt.table, rows.filter("NOT coalesce(__hit, false)").select(*columns), list(found), many)
            return many
        new = {names[c.lower()]: F.when(F.col("__hit"), v.cast(located.schema[names[c.lower()]].dataType)).otherwise(F.col(f"`{names[c.lower()]}`")) for c, v in values.items()}
        cat.replace(stmt.table, rows.select(*(new.get(n, F.col(f"`{n}`")).alias(n) for n in columns)), list(found), 0, set(new))
        if "embedding" in new:
            self._check_dimensions(cat.frame(stmt.table, cat.entry(stmt.table)["paths"][-1:]).select("embedding"))
        return many

    def _write_keyed(self, stmt, keyed: tuple[str, str], params_seq: list[dict]) -> int:
        """UPDATE or DELETE ... WHERE column = $key for many keys: one join and one new version. Of repeated keys the last counts."""
        column, param = keyed
        frame = self.catalog.frame(stmt.table)
        names = {n.lower(): n for n in frame.columns}
        sets = [(c, e) for c, e in getattr(stmt, "sets", ())]
        for c in [column, *(c for c, _ in sets)]:
            if c.lower() not in names:
                raise ValueError(f"no column {c!r}")
        rows = {C.bind(C.Param(param), p): [_simple(e, p) for _, e in sets] for p in params_seq}
        kinds = [frame.schema[names[c.lower()]].dataType.simpleString() for c in (column, *(c for c, _ in sets))]
        values = [(k, *map(_cell, v)) for k, v in rows.items() if k is not None]
        if not values:
            return 0
        ddl = ", ".join(f"__v{i} {_loose(k, [v[i] for v in values])}" for i, k in enumerate(kinds))
        new = self.spark.createDataFrame(values, ddl)
        new = new.select(*(F.col(f"__v{i}").cast(k).alias(f"__v{i}") for i, k in enumerate(kinds)), F.lit(True).alias("__hit"))
        key = names[column.lower()]
        return self._change(stmt, lambda rows: rows.join(new, rows[key] == new["__v0"], "left"), self.catalog.located(stmt.table), {c: F.col(f"__v{i + 1}") for i, (c, _) in enumerate(sets)})

    def _expr(self, text: str, params: dict | None):
        """An expression with its parameters bound as literals, each in the place of its own token."""
        named = sqltext.params_in(text)
        for name in named:
            if not params or name not in params:
                raise ValueError(f"missing parameter ${name}")
        vectors = [n for n in named if isinstance(params[n], (list, tuple))]
        if vectors:
            if len(sqltext.tokens(text)) > 1:
                raise ValueError("a vector parameter stands alone")
            return F.array(*(F.lit(float(x)) for x in params[vectors[0]])).cast("array<float>")
        return F.expr(sqltext.to_spark(text, {n: _sql_literal(params[n]) for n in named}))

    def _insert_values(self, stmt: D.Insert, params_seq: list[dict]) -> int:
        """Rows of VALUES. Plain literals and parameters become one local table, whatever their number."""
        schema = self.catalog.schema(stmt.table)
        names = list(stmt.columns or schema.names)
        if len(stmt.rows[0]) != len(names):
            raise ValueError("the rows of VALUES don't fit the columns")
        known = {f.name.lower(): f for f in schema.fields}
        if any(n.lower() not in known for n in names):
            raise ValueError(f"no column {next(n for n in names if n.lower() not in known)!r}")
        plain, other = [], []
        for params in params_seq:
            for row in stmt.rows:
                values = [_simple(e, params) for e in row]
                (plain if all(v is not _COMPLEX for v in values) else other).append((row, params, values))
        key = self.catalog.entry(stmt.table)["key"]
        if plain and not other and key and known[key.lower()].dataType.simpleString() == "bigint":
            self._number(stmt.table, key, names, plain)
        frames = []
        if plain:
            kinds = ", ".join(f"`{known[n.lower()].name}` {_loose(known[n.lower()].dataType.simpleString(), [v[2][i] for v in plain])}" for i, n in enumerate(names))
            frames.append(self.spark.createDataFrame([tuple(_cell(x) for x in v) for _, _, v in plain], kinds))
        for row, params, _ in other:
            frames.append(self.spark.range(1).select(*(self._expr(e, params).cast(known[n.lower()].dataType).alias(known[n.lower()].name) for e, n in zip(row, names, strict=True))))
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.select(*(F.col(f"`{c}`").cast(known[c.lower()].dataType) for c in rows.columns)).unionByName(f.select(*(F.col(f"`{c}`").cast(known[c.lower()].dataType) for c in f.columns)))
        return self._insert(stmt.table, rows)

    def _number(self, table: str, key: str, names: list[str], rows: list[tuple]) -> None:
        """Give local rows without a key the next ones, in their order."""
        at = next((i for i, n in enumerate(names) if n.lower() == key.lower()), None)
        if at is None:
            names.append(key)
            for _, _, values in rows:
                values.append(None)
            at = len(names) - 1
        missing = [v for _, _, v in rows if v[at] is None]
        given = [v[at] for _, _, v in rows if isinstance(v[at], int)]
        if missing:
            stored = self.catalog.frame(table).agg(F.max(key)).first()[0]
            first = self.catalog.next_ids("table:" + table, len(missing), max([stored or 0, *given]))
            for i, values in enumerate(missing):
                values[at] = first + i

    def _insert(self, table: str, rows: DataFrame) -> int:
        """Append rows; an INTEGER PRIMARY KEY that is absent or null gets the next ids."""
        cat = self.catalog
        entry, schema = cat.entry(table), cat.schema(table)
        own = {c.lower() for c in rows.columns}
        key = entry["key"]
        out = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name.lower() in own else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
        staged = cat.stage(table, out)
        found = cat.measure(table, staged.frame)
        if key and schema[key].dataType.simpleString() == "bigint":
            many = found.nulls[key]
            if many:
                stored = cat.frame(table).agg(F.max(key)).first()[0]
                first = cat.next_ids("table:" + table, many, max(found.most or 0, stored or 0))
                numbered = with_dense_ids(staged.frame.filter(F.col(key).isNull()).drop(key), key, first)
                staged = cat.stage(table, staged.frame.filter(F.col(key).isNotNull()).unionByName(numbered.select(*out.columns)))
                found = None
            cat.used_id("table:" + table, (found.most if found else None))
        many = cat.append(table, staged, found)
        if "embedding" in schema.names:
            self._check_dimensions(staged.frame.select("embedding"))
        return many

    # --- graph -----------------------------------------------------------------------------------------

    def graph(self) -> G.StoredGraph:
        return G.StoredGraph(self.catalog.frame("__nodes"), self.catalog.frame("__edges"))

    def _cypher(self, s: C.Statement, params: dict | None) -> QueryResult:
        work = routing.classify_graph(s.read_only)
        if s.read_only:
            return QueryResult(G.Matcher(self.graph(), s, params).result(), "cypher", work)
        out = self._atomically(lambda: self._graph_write(s, params))
        if isinstance(out, DataFrame):
            return QueryResult(out, "cypher", work, 1)
        return QueryResult(None, "cypher", work, out)

    def _node_row(self, node: C.Node, params: dict | None) -> tuple[int, str, dict]:
        if node.label is None:
            raise ValueError("a new node needs a label")
        props = G.tagged_props(node.props, params)
        return self.catalog.next_ids("node", 1), node.label, props

    def _one_type(self, rel: C.Rel) -> str:
        if len(rel.types) != 1:
            raise ValueError("a new relationship has one type")
        return rel.types[0]

    def _graph_write(self, s: C.Statement, params: dict | None):
        if s.kind == "create":
            return self._create(s.create, params)
        if s.kind == "match_create":
            return self._match_create(s, params)
        matcher = G.Matcher(self.graph(), s, params)
        target = s.delete or s.sets[0][0]
        if s.sets and any(a != target for a, _, _ in s.sets):
            raise ValueError("SET changes one alias")
        kind = matcher.kinds[target]
        table = "__nodes" if kind == "node" else "__edges"
        cat = self.catalog
        hits = cat.stage(table, matcher.frame().select(F.col(f"`{target}`")["id"].alias("id")).distinct().withColumns({f.name: F.lit(None).cast(f.dataType) for f in cat.schema(table).fields if f.name != "id"})).frame.select("id")
        found = cat.folders(table, cat.located(table).join(hits, "id", "left_semi"))
        many = sum(found.values())
        if not many:
            return 0
        frame = cat.frame(table, list(found))
        if s.kind == "match_delete":
            cat.replace(table, frame.join(hits, "id", "left_anti"), list(found), many)
            if kind == "node":
                ends = F.explode(F.array_distinct(F.array("src", "dst"))).alias("end")
                loose = cat.located("__edges").select("id", "__folder", ends).join(hits.withColumnRenamed("id", "end"), "end", "left_semi").select("id", "__folder").distinct()
                touched = cat.folders("__edges", loose)
                if touched:
                    cat.replace("__edges", cat.frame("__edges", list(touched)).join(loose.select("id"), "id", "left_anti"), list(touched), sum(touched.values()))
            return many
        changes = G.tagged_props(tuple((k, v) for _, k, v in s.sets), params)
        vector = any(v["t"] == "vector" for v in changes.values())
        if kind == "rel" and vector:
            raise ValueError("relationships hold no vectors")
        new = G.with_props(F.col("props"), G.props_literal(changes), list(changes))
        marked = frame.join(hits.withColumn("__hit", F.lit(True)), "id", "left")
        out = marked.withColumn("props", F.when(F.col("__hit"), new).otherwise(F.col("props"))).drop("__hit")
        if kind == "node" and vector:
            several = F.size(F.map_filter("props", lambda k, v: v["t"] == "vector")) > 1
            if out.filter(several).limit(1).count():
                raise ValueError("a node has one vector property at most")
        cat.replace(table, out, list(found), 0)
        if kind == "node" and vector:
            self._check_dimensions(_node_vectors(cat.frame(table, cat.entry(table)["paths"][-1:])).select("embedding"))
        return many

    def _append_rows(self, table: str, rows: list[tuple]) -> None:
        self.catalog.append(table, self.spark.createDataFrame(rows, self.catalog.schema(table)))

    def _create(self, patterns: tuple, params: dict | None) -> DataFrame:
        made: dict[str, tuple] = {}
        seen: dict[str, C.Node] = {}

        # An alias that is written twice is declared where it has its label.
        order = [x for p in patterns for x in ((p,) if isinstance(p, C.Node) else (p.left, p.right))]
        for n in sorted(order, key=lambda x: x.label is None):
            seen.setdefault(n.alias, n)

        def node(n: C.Node) -> int:
            if n.alias not in made:
                made[n.alias] = self._node_row(seen[n.alias], params)
            if n.alias in made:
                same = not n.props and n.label in (None, seen[n.alias].label) or n == seen[n.alias]
                if not same:
                    raise ValueError(f"{n.alias!r} is declared twice")
            return made[n.alias][0]

        paths = [p for p in patterns if isinstance(p, C.Path)]
        alone = [p for p in patterns if isinstance(p, C.Node)]
        if len(patterns) == 1 and alone:
            names, values = ["node_id"], [node(alone[0])]
        elif len(paths) == 1 and len(alone) in (0, 2) and patterns[-1] is paths[0]:
            if len({n.alias for n in alone}) < len(alone):
                raise ValueError(f"{alone[0].alias!r} is declared twice")
            for n in alone:
                node(n)
            p = paths[0]
            if alone and {p.left.alias, p.right.alias} != {n.alias for n in alone}:
                raise ValueError("the relationship must connect the two created nodes")
            a, b = node(p.left), node(p.right)
            props = G.tagged_props(p.rel.props, params)
            if any(v["t"] == "vector" for v in props.values()):
                raise ValueError("relationships hold no vectors")
            edge = self.catalog.next_ids("edge", 1)
            self._append_rows("__edges", [(edge, self._one_type(p.rel), a, b, props)])
            names, values = ["from_id", "edge_id", "to_id"], [a, edge, b]
        else:
            raise ValueError("CREATE takes a node, a relationship, or two nodes and a relationship between them")
        self._append_rows("__nodes", list(made.values()))
        for vector in (v["v"] for m in made.values() for v in m[2].values() if v["t"] == "vector"):
            self._check_size(len(vector))
        return self.spark.createDataFrame([tuple(values)], ", ".join(f"{n} bigint" for n in names))

    def _match_create(self, s: C.Statement, params: dict | None) -> int:
        if len(s.create) != 1 or not isinstance(s.create[0], C.Path):
            raise ValueError("MATCH ... CREATE makes one relationship")
        p = s.create[0]
        if any(not isinstance(m, C.Node) for m in s.match) or len(s.match) > 2:
            raise ValueError("MATCH ... CREATE matches one or two nodes")
        matcher = G.Matcher(self.graph(), s, params)
        known = [n.alias in matcher.kinds for n in (p.left, p.right)]
        if not any(known) or len(s.match) == 2 and {p.left.alias, p.right.alias} != set(matcher.kinds):
            raise ValueError("the new relationship must connect what is matched")
        for n in (p.left, p.right):
            if n.alias in matcher.kinds and (n.label or n.props):
                raise ValueError(f"{n.alias!r} is matched already")
        kind = self._one_type(p.rel)
        props = G.tagged_props(p.rel.props, params)
        id_of = lambda n, new: F.col(f"`{n.alias}`")["id"] if n.alias in matcher.kinds else new
        none = F.lit(None).cast("bigint")
        pairs = matcher.frame().select(id_of(p.left, none).alias("src"), id_of(p.right, none).alias("dst"))
        pairs = self.catalog.stage("__edges", pairs.select(F.lit(None).cast("bigint").alias("id"), F.lit(kind).alias("type"), "src", "dst", G.props_literal(props).alias("props"))).frame
        many = pairs.count()
        if not many:
            return 0
        edges = with_dense_ids(pairs.drop("id"), "id", self.catalog.next_ids("edge", many))
        if not all(known):
            fresh = p.right if known[0] else p.left
            if fresh.label is None:
                raise ValueError("a new node needs a label")
            new = G.tagged_props(fresh.props, params)
            first = self.catalog.next_ids("node", many)
            edges = with_dense_ids(edges, "__node", first)
            end = "dst" if known[0] else "src"
            edges = self.catalog.stage("__edges", edges.withColumn(end, F.col("__node"))).frame
            self.catalog.append("__nodes", edges.select(F.col(end).alias("id"), F.lit(fresh.label).alias("label"), G.props_literal(new).alias("props")))
            for vector in (v["v"] for v in new.values() if v["t"] == "vector"):
                self._check_size(len(vector))
        self.catalog.append("__edges", edges)
        return many

    # --- vectors ---------------------------------------------------------------------------------------

    def _vector_sources(self) -> dict[tuple[str, str], tuple[str, Callable[[list[str] | None], DataFrame]]]:
        """(target, namespace) -> the table, and what reads its vectors from some of its folders (all by default), with each row's ``__folder``."""
        cat = self.catalog
        none = F.create_map().cast(T.PROPS)
        shaped = lambda rows, target, name, own, meta: rows.select(F.lit(target).alias("target"), F.lit(name).alias("namespace"), own.cast("bigint").alias("target_id"), "embedding", meta.alias("metadata"), "__folder")
        out = {("direct", ""): ("__vectors", lambda paths=None: shaped(cat.located("__vectors", paths), "direct", "", F.col("target_id"), F.col("metadata")))}
        for n in cat.names():
            schema, key = cat.schema(n), cat.entry(n)["key"]
            if "embedding" in schema.names and schema["embedding"].dataType.simpleString() == "array<float>":
                own = key or next((c for c in _ID_NAMES if c in schema.names), None)
                if own:
                    out["sql_row", n] = (n, lambda paths=None, n=n, own=own: shaped(cat.located(n, paths).filter("embedding IS NOT NULL"), "sql_row", n, F.col(own), none))
        out["graph_node", ""] = ("__nodes", lambda paths=None: shaped(_node_vectors(cat.located("__nodes", paths)), "graph_node", "", F.col("id"), none))
        return out

    def _located_vectors(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, (make(None) for _, make in self._vector_sources().values()))

    def vectors(self) -> DataFrame:
        """(target, namespace, target_id, embedding, metadata) of direct vectors, SQL rows and graph nodes."""
        if self._cached and self._cached[0] == self._mark():
            return self._cached[1]
        return self._located_vectors().drop("__folder")

    def _mark(self) -> str:
        return json.dumps([self.catalog.state["version"], {n: e["paths"] for n, e in self.catalog.state["tables"].items()}])

    def _drop_cache(self) -> None:
        if self._cached:
            self._cached[1].unpersist()
            self._cached = None

    def preload_vectors(self) -> bool:
        """Keep the vectors in executor memory until the next write; False where there are none."""
        self._drop_cache()
        frame = self.vectors().persist()
        self._cached = (self._mark(), frame)
        return frame.count() > 0

    def vectors_cached(self) -> bool:
        return self._cached is not None

    def _dimensions(self) -> int | None:
        """The dimension of all vectors: kept in the manifest, else looked up."""
        if self.catalog.state.get("dimensions"):
            return self.catalog.state["dimensions"]
        row = self.vectors().select(F.size("embedding")).first()
        return row[0] if row else None

    def _check_dimensions(self, new: DataFrame) -> None:
        """Hold new vectors (embedding) to the dimension of the others. Only they are read."""
        sizes = [r[0] for r in new.filter("embedding IS NOT NULL").select(F.size("embedding")).distinct().limit(3).collect()]
        if len(sizes) > 1 or 0 in sizes:
            raise ValueError(f"all vectors have one dimension, found {sorted(sizes)}")
        for size in sizes:
            self._check_size(size)

    def _check_size(self, size: int) -> None:
        known = self.catalog.state.get("dimensions")
        if known != size and self.vectors().filter(F.size("embedding") != size).limit(1).count():
            raise ValueError(f"all vectors have one dimension, found {size} beside others")
        self.catalog.state["dimensions"] = size

    def insert_vectors(self, rows) -> list[int]:
        """Store direct vectors: a list, (id, vector), or {embedding, metadata?, target_id?}. Returns their ids."""
        found: list[tuple[int | None, list[float], dict]] = []
        for r in rows:
            if isinstance(r, dict):
                extra = set(r) - {"embedding", "metadata", "target_id"}
                if extra or "embedding" not in r:
                    raise ValueError("a vector row has embedding, metadata and target_id")
                found.append((r.get("target_id"), r["embedding"], r.get("metadata") or {}))
            elif isinstance(r, tuple) and len(r) == 2 and isinstance(r[0], int) and not isinstance(r[1], (int, float)):
                found.append((r[0], r[1], {}))
            else:
                found.append((None, r, {}))
        if not found:
            return []
        given = [i for i, _, _ in found if i is not None]
        if any(isinstance(i, bool) or not isinstance(i, int) for i in given):
            raise ValueError("a vector's id is an integer")
        if len(set(given)) < len(given):
            raise ValueError("a vector id is given twice")

        def change() -> list[int]:
            direct = self.catalog.frame("__vectors")
            largest = direct.agg(F.max("target_id")).first()[0] or 0
            if given and direct.filter(F.col("target_id").isin(*given)).limit(1).count():
                raise ValueError("a vector of that id exists already")
            auto = iter(range(first := self.catalog.next_ids("vector", len(found) - len(given), max(largest, *given, 0) if given else largest), first + len(found)))
            ids = [i if i is not None else next(auto) for i, _, _ in found]
            rows = [("direct", "", i, [float(x) for x in e], {k: T.tagged(v) for k, v in m.items()}) for i, (_, e, m) in zip(ids, found, strict=True)]
            if any(not e for *_, e, _ in rows):
                raise ValueError("a vector must not be empty")
            self.catalog.used_id("vector", max(ids))
            self._append_rows("__vectors", rows)
            for size in {len(r[3]) for r in rows}:
                self._check_size(size)
            return ids

        return self._atomically(change)

    def insert_vector_frame(self, rows: DataFrame) -> int:
        """Store a frame (target_id, embedding[, metadata]) of direct vectors, at any size."""

        def change() -> int:
            own = rows.select(F.lit("direct").alias("target"), F.lit("").alias("namespace"), "target_id", "embedding", F.col("metadata") if "metadata" in rows.columns else F.create_map().cast(T.PROPS).alias("metadata"))
            staged = self.catalog.stage("__vectors", own)
            new = staged.frame
            keys = ["target", "namespace", "target_id"]
            stored = bool(self.catalog.entry("__vectors")["paths"])
            if new.groupBy(*keys).count().filter("count > 1").limit(1).count() or stored and new.join(self.catalog.frame("__vectors"), keys, "left_semi").limit(1).count():
                raise ValueError("a vector id occurs twice")
            many = self.catalog.append("__vectors", staged)
            self.catalog.used_id("vector", new.agg(F.max("target_id")).first()[0])
            self._check_dimensions(new.select("embedding"))
            return many

        return self._atomically(change)

    def delete_vectors(self, ids) -> int:
        ids = list(dict.fromkeys(ids))
        if not ids:
            return 0

        def change() -> int:
            cat = self.catalog
            gone = self.spark.createDataFrame([(i,) for i in ids], "target_id bigint")
            found = cat.folders("__vectors", cat.located("__vectors").join(gone, "target_id", "left_semi"))
            many = sum(found.values())
            if many:
                cat.replace("__vectors", cat.frame("__vectors", list(found)).join(gone, "target_id", "left_anti"), list(found), many)
            return many

        return self._atomically(change)

    def set_vector_metadata(self, rows) -> int:
        """rows: (id, {key: value}) or {target_id, metadata}; returns the number of pairs written."""
        found = [(r["target_id"], r["metadata"]) if isinstance(r, dict) else tuple(r) for r in rows]
        pairs = sum(len(m) for _, m in found)
        if not found:
            return 0

        def change() -> int:
            cat = self.catalog
            merged: dict[int, dict] = {}
            for i, m in found:
                merged.setdefault(i, {}).update({k: T.tagged(v) for k, v in m.items()})
            new = self.spark.createDataFrame(list(merged.items()), f"target_id bigint, new {T.PROPS}")
            held = cat.folders("__vectors", cat.located("__vectors").join(new, "target_id", "left_semi"))
            if sum(held.values()) < len(merged):
                raise ValueError("a vector of that id doesn't exist")
            joined = cat.frame("__vectors", list(held)).join(new, "target_id", "left")
            kept = F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys("new"), k))
            out = joined.withColumn("metadata", F.when(F.col("new").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, "new"))).drop("new")
            cat.replace("__vectors", out, list(held), 0)
            return pairs

        return self._atomically(change)

    def search_vectors(self, query, *, top_k: int = 10, metric: str = "cosine", filters: dict | None = None) -> QueryResult:
        """The best direct vectors; ``filters`` are equalities of metadata, strict in type, all of which must hold."""
        rows = self.vectors().filter("target = 'direct'")
        if filters is not None:
            if not filters:
                rows = rows.filter(F.lit(False))
            for k, v in filters.items():
                rows = rows.filter(T.Prop(F.col("metadata")[k]).equals(v))
        return QueryResult(self._search(rows, query, top_k, metric, "direct" if filters is None else None), "vector", routing.VECTOR)

    def _search(self, rows: DataFrame, query, k: int, metric: str, target: str | None = None) -> DataFrame:
        """The best of rows. ``target``: rows are all vectors of that target, so that an index may be used."""
        dims = self._dimensions()
        if dims is not None and len(query) != dims:  # vectors of another dimension may be gone since
            row = self.vectors().select(F.size("embedding")).first()
            dims = row[0] if row else None
        q = V.query_vector(query, dims, metric)
        index = self._live_index(metric) if target else None
        if not index:
            return V.top_k(rows, q, k, metric)
        # Vectors of the nearest cells and those that the snapshot lacks are ranked first; then those of all cells
        # whose bound reaches the k-th best of them, so that no neighbour is lost.
        keys = ("target", "namespace", "target_id")
        current, delta = self._celled(index, target)
        centres, radii = self._cells(index)
        cells = V.probed_cells(q, centres, metric)
        parts = [V.top_k(current.filter(F.col("cell").isin(*cells)), q, k, metric)]
        found = V.merge_best(parts + ([V.top_k(delta, q, k, metric)] if delta is not None else []), keys, k)
        best = found.collect()
        found = self.spark.createDataFrame(best, found.schema)
        bounds = V.cell_bounds(np.array([q]), centres, radii, metric)[0]
        more = [i for i, x in enumerate(bounds.tolist()) if i not in set(cells) and (len(best) < k or x >= best[-1]["score"])]
        if not more:
            return found.orderBy(F.col("score").desc(), *keys)
        return V.merge_best([found, V.top_k(current.filter(F.col("cell").isin(*more)), q, k, metric)], keys, k)

    def _live_index(self, metric: str) -> dict | None:
        return next((i for i in self.catalog.state["indexes"].values() if i["metric"] == metric and i["enabled"] and i["snapshot"]), None)

    def _cells(self, index: dict) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii of a snapshot's cells, read once."""
        if index["snapshot"] not in self._known_cells:
            rows = self.spark.read.parquet(f"{self.base_path}/{index['snapshot']}/cells").orderBy("cell").collect()
            self._known_cells = {index["snapshot"]: (np.array([r["centre"] for r in rows], float), np.array([r["radius"] for r in rows], float))}
        return self._known_cells[index["snapshot"]]

    def _celled(self, index: dict, target: str) -> tuple[DataFrame, DataFrame | None]:
        """The snapshot's vectors that are as they were, with their cells, and the vectors that it lacks, if there may be any.

        The manifest says which folders came after the snapshot and which are gone: a vector is as it was if its
        folder is still there. Nothing is joined, and only what changed is read besides the cells.
        """
        still, new = [], []
        for (kind, name), (table, make) in self._vector_sources().items():
            if kind == target:
                paths, known = self.catalog.entry(table)["paths"], set(index["sources"].get(table, ()))
                still += [p.rpartition("/")[2] for p in paths if p in known]
                later = [p for p in paths if p not in known]
                if later:
                    new.append(make(later))
        snapshot = self.spark.read.parquet(f"{self.base_path}/{index['snapshot']}/vectors").filter(F.col("target") == target)
        current = snapshot.filter(F.col("__folder").isin(*still)) if still else snapshot.filter(F.lit(False))
        return current, functools.reduce(DataFrame.unionByName, new) if new else None

    def search_vectors_many(self, queries: DataFrame, *, top_k: int = 10, metric: str = "cosine", block: int = 1024) -> DataFrame:
        """queries (query_id, embedding) as (query_id, target, namespace, target_id, score): the best direct vectors of each query.

        Queries are searched ``block`` at a time, which bounds what the driver and a worker hold.
        """
        rows, dims, keys = self.vectors().filter("target = 'direct'"), self._dimensions(), ("target", "namespace", "target_id")
        index = self._live_index(metric)
        current, delta = self._celled(index, "direct") if index else (None, rows)
        centres, radii = self._cells(index) if index else (None, None)
        parts, asked = [], queries.select("query_id", "embedding").toLocalIterator()
        while some := list(itertools.islice(asked, block)):
            q = np.array([V.query_vector(r["embedding"], dims, metric) for r in some])
            floor = np.full(len(q), -np.inf)
            found = [V.best_of_cells(delta, q, None, floor, top_k, metric, keys)] if delta is not None else []
            if index:
                near = np.zeros((len(q), len(centres)), bool)
                for i, x in enumerate(q.tolist()):
                    near[i, V.probed_cells(x, centres, metric)] = True
                first = functools.reduce(DataFrame.unionByName, found, V.best_of_cells(current, q, near, floor, top_k, metric, keys))
                least = F.sort_array(F.collect_list("score"), asc=False)
                ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("nth").orderBy(F.col("score").desc(), *keys))).filter(F.col("rank") <= top_k).drop("rank")
                kth = ranked.groupBy("nth").agg(F.get(least, top_k - 1).alias("kth")).filter("kth IS NOT NULL")
                for r in kth.collect():
                    floor[r["nth"]] = r["kth"]
                wanted = V.cell_bounds(q, centres, radii, metric) >= floor[:, None]
                found.append(V.best_of_cells(current, q, wanted | near, floor - 1e-9 * (1 + np.abs(floor)), top_k, metric, keys))
            names = self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(some)], f"nth int, query_id {queries.schema['query_id'].dataType.simpleString()}")
            both = functools.reduce(DataFrame.unionByName, found)
            ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("nth").orderBy(F.col("score").desc(), *keys))).filter(F.col("rank") <= top_k)
            parts.append(ranked.join(F.broadcast(names), "nth").select("query_id", *keys, "score"))
        if not parts:
            return rows.crossJoin(queries.select("query_id")).select("query_id", *keys, F.lit(0.0).alias("score")).limit(0)
        return functools.reduce(DataFrame.unionByName, parts)

    def _sql_vector(self, parsed: dict, params: dict | None) -> QueryResult:
        params = params or {}
        query, k = C.bind(C.Param(parsed["param"]), params), parsed["limit"]
        k = C.bind(C.Param(k), params) if isinstance(k, str) else k
        ids = self._run_sql(parsed["candidates"], {n: v for n, v in params.items() if n in sqltext.params_in(parsed["candidates"])})
        ids = ids.select(F.col(f"`{_id_column(ids.columns)}`").cast("bigint").alias("target_id")).distinct()
        rows = self.vectors().filter((F.col("target") == "sql_row") & (F.lower("namespace") == parsed["table"].lower())).join(ids, "target_id", "left_semi")
        return QueryResult(self._search(rows, query, k, parsed["metric"]), "vector", routing.VECTOR)

    def _call(self, call: C.VectorCall, params: dict | None) -> QueryResult:
        k, query = C.bind(call.k, params), C.bind(call.query, params)
        if call.index not in self.catalog.state["indexes"]:
            log.warning("no vector index %r: cosine is used", call.index)
        metric = self.catalog.state["indexes"].get(call.index, {}).get("metric", "cosine")
        rows = self.vectors().filter("target = 'graph_node'")
        if call.candidates is not None:
            found = G.Matcher(self.graph(), call.candidates, params).frame().select(F.col("node")["id"].alias("target_id")).distinct()
            rows = rows.join(found, "target_id", "left_semi")
        out = self._search(rows, query, k, metric, "graph_node" if call.candidates is None else None).select(F.col("target_id").alias("node.id"), "score")
        if call.order:
            out = out.orderBy(*(F.col(f"`{n}`").desc() if desc else F.col(f"`{n}`").asc() for n, desc in call.order))
        return QueryResult(out.select(*(F.col(f"`{n}`") for n in call.items)), "vector", routing.VECTOR)

    # --- vector indexes --------------------------------------------------------------------------------

    def _index(self, name: str) -> dict:
        if name not in self.catalog.state["indexes"]:
            raise ValueError(f"no vector index {name!r}")
        return self.catalog.state["indexes"][name]

    def create_vector_index(self, name: str, metric: str = "cosine", if_not_exists: bool = False) -> None:
        def change() -> None:
            indexes = self.catalog.state["indexes"]
            if name in indexes and indexes[name]["enabled"]:
                if if_not_exists:
                    return
                raise ValueError(f"vector index {name!r} already exists")
            if metric not in V.METRICS:
                raise ValueError(f"unsupported metric {metric!r}")
            other = next((n for n, i in indexes.items() if i["metric"] == metric and i["enabled"] and n != name), None)
            if other:
                raise ValueError(f"metric {metric} has the index {other!r}")
            indexes[name] = {"metric": metric, "enabled": True, "paused": False, "snapshot": None, "rows": 0, "generation": 0, "sources": {}, "tried": 0}
            self._build(name)

        self._atomically(change)

    def _sources(self) -> dict[str, list[str]]:
        """The folders of each table that holds vectors."""
        return {table: list(self.catalog.entry(table)["paths"]) for table, _ in self._vector_sources().values()}

    def _snapshot(self, rows: DataFrame, metric: str, path: str, least: int) -> int:
        """Write the vectors by cell, and the cells, below ``path``; 0 and nothing if there are fewer than ``least``."""
        many = rows.count()
        if many < max(least, 256):
            return 0
        centres = V.fit_cells(rows, metric, many)
        top = f"{self.base_path}/{path}"
        celled = V.with_cells(rows.select("target", "namespace", "target_id", "embedding", "__folder"), centres, metric)
        celled.repartition("cell").write.partitionBy("cell").parquet(f"{top}/vectors")
        far = {r["cell"]: r["far"] for r in self.spark.read.parquet(f"{top}/vectors").groupBy("cell").agg(F.max("far").alias("far")).collect()}
        cells = [(i, [float(x) for x in c], float(far.get(i, 0.0))) for i, c in enumerate(centres)]
        self.spark.createDataFrame(cells, "cell int, centre array<double>, radius double").coalesce(1).write.parquet(f"{top}/cells")
        return many

    def _build(self, name: str, force: bool = False) -> None:
        index = self._index(name)
        path = f"index/{name}/{uuid.uuid4().hex}"
        index["tried"] = self._vector_rows()
        many = self._snapshot(self._located_vectors(), index["metric"], path, 1 if force else self.ann_threshold)
        if many:
            index.update(snapshot=path, rows=many, sources=self._sources(), generation=index["generation"] + 1)

    def _vector_rows(self) -> int:
        """Rows of the folders that may hold vectors, by the manifest."""
        return sum(sum(self.catalog.entry(t).get("rows", {}).values()) for t in self._sources())

    def _drift(self, index: dict) -> int:
        """Rows of folders that came after the snapshot, and those of folders that are gone, at most as many as it has."""
        now = self._sources()
        rows = {p: n for t in now for p, n in self.catalog.entry(t).get("rows", {}).items()}
        known = {p for paths in index["sources"].values() for p in paths}
        later = sum(rows.get(p, 0) for paths in now.values() for p in paths if p not in known)
        kept = sum(rows.get(p, 0) for paths in now.values() for p in paths if p in known)
        return later + max(0, index["rows"] - kept)

    def _maintain(self) -> None:
        """Start the refresh of indexes that have drifted by the threshold, or that grew beyond it, in the background.

        One worker builds a snapshot of the version at hand while statements go on. A paused or dropped index isn't maintained.
        """
        if self.catalog.in_transaction:
            return
        for name, index in self.catalog.committed["indexes"].items():
            running = self._refreshing.get(name)
            if not index["enabled"] or index["paused"] or running and not running.done():
                continue
            due = self._drift(index) if index["snapshot"] else self._vector_rows() - index.get("tried", 0)
            if due >= max(self.ann_threshold, 256):
                job = (self._located_vectors(), index["metric"], f"index/{name}/{uuid.uuid4().hex}", self._sources(), index["generation"], self._vector_rows())
                self._refreshing[name] = self._pool.submit(self._refresh, name, *job)

    def _refresh(self, name: str, rows: DataFrame, metric: str, path: str, sources: dict, generation: int, tried: int) -> bool:
        """Build a snapshot and make it the index's, unless the index was rebuilt, paused or dropped meanwhile."""
        many = self._snapshot(rows, metric, path, self.ann_threshold)
        with self._lock:
            index = self.catalog.committed["indexes"].get(name)
            if index and index["enabled"] and not index["paused"] and index["generation"] == generation:
                change = {"tried": tried} | ({"snapshot": path, "rows": many, "sources": sources, "generation": generation + 1} if many else {})
                self.catalog.atomically(lambda: self._index(name).update(change))
                if many:
                    return True
        self.catalog.files.delete(path)
        return False

    def build_vector_index(self, name: str) -> dict:
        """Build the snapshot if there is none."""
        if not self._index(name)["snapshot"]:
            self._atomically(lambda: self._build(name, True))
        return self.inspect_vector_index(name)

    def refresh_vector_index(self, name: str) -> dict:
        """Build the snapshot anew; enables a dropped index again."""

        def change() -> None:
            self._index(name)["enabled"] = True
            self._build(name, True)

        self._atomically(change)
        return self.inspect_vector_index(name)

    def _flag(self, name: str, **flags) -> dict:
        self._atomically(lambda: self._index(name).update(flags))
        return self.inspect_vector_index(name)

    def pause_vector_index(self, name: str) -> dict:
        return self._flag(name, paused=True)

    def resume_vector_index(self, name: str) -> dict:
        return self._flag(name, paused=False)

    def drop_vector_index(self, name: str) -> dict:
        """Search is exact from now on; the snapshot's folder is removed, at the latest by ``vacuum``."""
        path = self._index(name)["snapshot"]
        out = self._flag(name, enabled=False, snapshot=None, rows=0, sources={})
        if path and not self.catalog.in_transaction:
            self.catalog.files.delete(path)
        return out

    @contextlib.contextmanager
    def deferred_vector_index_maintenance(self, name: str):
        """Pause an index's maintenance for a block of writes and build it anew afterwards."""
        self.pause_vector_index(name)
        try:
            yield self
        finally:
            self.resume_vector_index(name)
        self.refresh_vector_index(name)

    def await_vector_index_refresh(self, name: str, timeout: float | None = None) -> bool:
        """Wait for a refresh in the background; False if it hasn't ended in time. A transaction doesn't wait, since the refresh ends after it."""
        self._index(name)
        running = self._refreshing.get(name)
        if running is None:
            return True
        try:
            running.result(0 if self.catalog.in_transaction else timeout)
        except concurrent.futures.TimeoutError:
            return False
        return True

    def inspect_vector_index(self, name: str) -> dict:
        index, rows = self._index(name), self.vectors()
        total = rows.count()
        delta = gone = 0
        if index["snapshot"]:
            keys = ["target", "namespace", "target_id"]
            snap = self.spark.read.parquet(f"{self.base_path}/{index['snapshot']}/vectors")
            marked = keys + ["h"]
            a, b = rows.select(*keys, F.hash("embedding").alias("h")), snap.select(*keys, F.hash("embedding").alias("h"))
            delta, gone = a.join(b, marked, "left_anti").count(), b.join(a, marked, "left_anti").count()
        running = name in self._refreshing and not self._refreshing[name].done()
        state = "disabled" if not index["enabled"] else "refreshing" if running else "ready" if index["snapshot"] else "exact_only"
        values = (name, index["metric"], index["enabled"], state, total, total - delta if index["snapshot"] else 0, index["rows"], delta, gone, self.ann_threshold, running, index["snapshot"], index["generation"], index["paused"])
        return dict(zip(INDEX_COLUMNS, values, strict=True))

    def vector_indexes(self) -> DataFrame:
        rows = [tuple(self.inspect_vector_index(n).values()) for n in sorted(self.catalog.state["indexes"])]
        return self.spark.createDataFrame(rows, _INDEX_DDL)

    def _admin(self, text: str) -> QueryResult | None:
        """Statements about vector indexes, or None."""
        work = routing.Workload("vector_index", False, "row", "a statement about vector indexes")
        for pattern, action in _ADMIN:
            m = pattern.match(text)
            if m:
                out = action(self, m.groupdict())
                return QueryResult(out if isinstance(out, DataFrame) else self.vector_indexes(), "vector", work)
        return None

    # --- ingest ----------------------------------------------------------------------------------------

    def import_table(self, table: str, path: str, *, columns: list[str] | None = None, header: bool = True, delimiter: str = ",", chunk_size: int = 1000, encoding: str = "utf-8") -> int:
        """Load a CSV file into a table; all of it or nothing. ``chunk_size`` is checked and otherwise left to Spark."""
        self._check_chunk(chunk_size)
        schema = self.catalog.schema(table)
        rows = csvfiles.read_text_columns(self.spark, path, columns, header, delimiter, encoding)
        known = {f.name: f.dataType.simpleString() for f in schema.fields}
        unknown = [c for c in rows.columns if c not in known]
        if unknown:
            raise ValueError(f"{table} has no column {unknown[0]!r}")
        own = [csvfiles.as_boolean(F.col(f"`{c}`"), c).alias(c) if known[c] == "boolean" else F.col(f"`{c}`").cast(known[c]).alias(c) for c in rows.columns]
        return self._atomically(lambda: self._insert(table, rows.select(*own)))

    @staticmethod
    def _check_chunk(chunk_size: int) -> None:
        if chunk_size < 1:
            raise ValueError("chunk_size must be 1 at least")

    def import_nodes(self, label: str, path: str, *, id_column: str | None = None, property_columns: list[str] | None = None, property_types: dict[str, str] | None = None, columns: list[str] | None = None, header: bool = True, delimiter: str = ",", chunk_size: int = 1000, encoding: str = "utf-8") -> int:
        """Load nodes from a CSV file, with their ids from ``id_column`` or the next free ones."""
        self._check_chunk(chunk_size)
        rows = csvfiles.read_text_columns(self.spark, path, columns, header, delimiter, encoding)
        for c in [*([id_column] if id_column else []), *(property_columns or [])]:
            if c not in rows.columns:
                raise ValueError(f"the file has no column {c!r}")
        props = property_columns if property_columns is not None else [c for c in rows.columns if c != id_column]
        made = csvfiles.property_map(props, property_types or {})

        def change() -> int:
            own = rows.select(csvfiles.as_number(F.col(f"`{id_column}`"), "bigint", id_column).alias("id") if id_column else F.lit(None).cast("bigint").alias("id"), F.lit(label).alias("label"), made.alias("props"))
            cat = self.catalog
            staged = cat.stage("__nodes", own)
            new = staged.frame
            if not id_column:
                many = new.count()
                return cat.append("__nodes", with_dense_ids(new.drop("id"), "id", cat.next_ids("node", many)))
            many, most, distinct = new.agg(F.count("*"), F.max("id"), F.count_distinct("id")).first()
            known = bool(cat.entry("__nodes")["paths"])
            if distinct < many or known and new.join(cat.frame("__nodes"), "id", "left_semi").limit(1).count():
                raise ValueError("a node id occurs twice")
            cat.used_id("node", most)
            return cat.append("__nodes", staged, Measured(many, None, {}))

        return self._atomically(change)

    def import_edges(self, rel_type: str, path: str, *, source_id_column: str, target_id_column: str, property_columns: list[str] | None = None, property_types: dict[str, str] | None = None, columns: list[str] | None = None, header: bool = True, delimiter: str = ",", chunk_size: int = 1000, encoding: str = "utf-8") -> int:
        """Load edges from a CSV file; every endpoint must exist. Ids are dense, in the file's order."""
        self._check_chunk(chunk_size)
        rows = csvfiles.read_text_columns(self.spark, path, columns, header, delimiter, encoding)
        ends = [source_id_column, target_id_column]
        for c in [*ends, *(property_columns or [])]:
            if c not in rows.columns:
                raise ValueError(f"the file has no column {c!r}")
        props = property_columns if property_columns is not None else [c for c in rows.columns if c not in ends]
        made = csvfiles.property_map(props, property_types or {})

        def change() -> int:
            own = rows.select(F.lit(rel_type).alias("type"), csvfiles.as_number(F.col(f"`{ends[0]}`"), "bigint", ends[0]).alias("src"), csvfiles.as_number(F.col(f"`{ends[1]}`"), "bigint", ends[1]).alias("dst"), made.alias("props"))
            numbered = with_dense_ids(own, "id", first := self.catalog.next_ids("edge", 0))
            staged = self.catalog.stage("__edges", numbered)
            new = staged.frame
            many = new.count()
            self.catalog.used_id("edge", first + many - 1 if many else None)
            named = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            if named.join(self.catalog.frame("__nodes").select("id"), "id", "left_anti").limit(1).count():
                raise ValueError("an edge's end doesn't exist")
            return self.catalog.append("__edges", staged, Measured(many, None, {}))

        return self._atomically(change)


def _node_vectors(nodes: DataFrame) -> DataFrame:
    """Nodes that have a vector property, with it as embedding."""
    held = nodes.withColumn("v", F.map_values(F.map_filter("props", lambda k, v: v["t"] == "vector"))).filter(F.size("v") > 0)
    return held.withColumn("embedding", F.col("v")[0]["v"])


_COMPLEX = object()


def _simple(expression: str, params: dict):
    """The value of a literal or a parameter, else _COMPLEX."""
    ts = sqltext.tokens(expression)
    sign = 1
    if len(ts) == 2 and ts[0].key in ("-", "+") and ts[1].kind == "number":
        sign, ts = -1 if ts[0].key == "-" else 1, ts[1:]
    if len(ts) != 1:
        return _COMPLEX
    t = ts[0]
    if t.kind == "param":
        return C.bind(C.Param(t.text[1:]), params)
    if t.kind == "string":
        return sqltext.literal(t)
    if t.kind == "number":
        return sign * (int(t.text) if t.text.isdigit() else float(t.text))
    return {"NULL": None, "TRUE": True, "FALSE": False}.get(t.key, _COMPLEX)


def _keyed(stmt) -> tuple[str, str] | None:
    """(column, parameter) of WHERE column = $parameter, if all that is set is a literal or a parameter too."""
    if not stmt.where:
        return None
    ts = sqltext.tokens(stmt.where)
    simple = all(len(sqltext.tokens(e)) == 1 and sqltext.tokens(e)[0].kind in ("param", "string", "number") for _, e in getattr(stmt, "sets", ()))
    if len(ts) == 3 and ts[0].kind in ("word", "quoted") and ts[1].key == "=" and ts[2].kind == "param" and simple:
        return sqltext.name_of(ts[0]), ts[2].text[1:]
    return None


def _loose(kind: str, values: list) -> str:
    """The column's type if all values are of it, else text, which Spark then casts."""
    fits = {"bigint": (int,), "double": (int, float), "string": (str,), "boolean": (bool,)}.get(kind)
    if kind.startswith("array"):
        return kind
    present = [v for v in values if v is not None]
    if fits and all(isinstance(v, fits) and (kind == "boolean" or not isinstance(v, bool)) for v in present) and not (kind == "double" and any(isinstance(v, int) for v in present)):
        return kind
    return "string"


def _cell(value):
    if isinstance(value, (list, tuple)) or type(value).__module__ == "numpy":
        return [float(x) for x in value]
    return value



def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L" if value >= 0 else f"({value}L)"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return sqltext.quoted(str(value))


def _id_column(columns: list[str]) -> str:
    """Which column of a candidate query has the ids."""
    low = {c.lower(): c for c in columns}
    for name in _ID_NAMES:
        if name in low:
            return low[name]
    if len(columns) == 1:
        return columns[0]
    raise ValueError("a vector query selects id, item_id or one column")


def vector_query(text: str) -> dict | None:
    """A SELECT ordered by embedding <op> $query LIMIT k, taken apart; None for other statements."""
    try:
        ts = sqltext.tokens(text)
    except ValueError:
        return None
    at = next((i for i, t in enumerate(ts) if t.key in OPERATORS), None)
    if at is None or not ts or ts[0].key not in ("SELECT", "WITH"):
        return None
    depth = sqltext.depths(ts)
    order = next((i for i in range(at, -1, -1) if ts[i].key == "ORDER" and i + 1 < len(ts) and ts[i + 1].key == "BY"), None)
    if order is None or depth[order]:
        raise ValueError("a vector operator stands in the statement's ORDER BY")
    left, tail = ts[order + 2 : at], ts[at + 1 :]
    if not left or sqltext.name_of(left[-1]).lower() != "embedding" or len(left) not in (1, 3):
        raise ValueError("vector search orders by the column embedding")
    if len(tail) != 3 or tail[0].kind != "param" or tail[1].key != "LIMIT" or tail[2].kind not in ("number", "param"):
        raise ValueError("vector search ends in $query LIMIT k")
    froms = [i for i in range(order) if ts[i].key == "FROM" and not depth[i]]
    if len(froms) != 1 or any(ts[i].key in ("JOIN", ",") and not depth[i] for i in range(froms[0], order)) or ts[froms[0] + 1].key == "(":
        raise ValueError("vector search reads one table")
    table = sqltext.name_of(ts[froms[0] + 1])
    limit = tail[2].text[1:] if tail[2].kind == "param" else int(tail[2].text)
    return {"candidates": text[: ts[order].start], "table": table, "metric": OPERATORS[ts[at].key], "param": tail[0].text[1:], "limit": limit}


def _created(engine: Engine, g: dict) -> None:
    metric = _OPS.get((g.get("metric") or "cosine").strip("'\" ").lower())
    if metric is None:
        raise ValueError(f"unsupported metric {g['metric']!r}")
    engine.create_vector_index(g["name"], metric, bool(g.get("absent")))


def _options(engine: Engine, g: dict) -> None:
    found = re.search(r"\b(cosine|euclidean|l2|dot|ip|inner_product)\b", g.get("options") or "", re.I)
    _created(engine, g | {"metric": found[1] if found else "cosine"})


_N = r"(?P<name>[A-Za-z_]\w*)"
_IF = r"(?P<absent>IF\s+NOT\s+EXISTS\s+)?"


def _pattern(text: str) -> re.Pattern:
    return re.compile(r"^\s*" + text + r"\s*;?\s*$", re.I | re.S)


_ADMIN = (
    (_pattern(rf"CREATE\s+INDEX\s+{_IF}{_N}\s+ON\s+\w+\s+USING\s+(?:ivfpq|ivfflat|ivf)\s*\(\s*embedding\s+(?P<metric>vector_\w+_ops)\s*\)(?:\s+WITH\s*\([^)]*\))?"), _created),
    (_pattern(rf"CREATE\s+INDEX\s+{_IF}{_N}\s+ON\s+VECTOR\s*\(\s*embedding\s*\)(?:\s+WITH\s*\((?P<options>[^)]*)\))?"), _options),
    (_pattern(rf"CREATE\s+VECTOR\s+INDEX\s+{_IF}{_N}(?:\s+FOR\s+(?P<metric>\w+))?"), _created),
    (_pattern(rf"CREATE\s+VECTOR\s+INDEX\s+{_N}\s+{_IF}FOR\s*\(\s*\w+\s*:\s*\w+\s*\)\s+ON\s*\(?\s*\w+\.\w+\s*\)?(?:\s+OPTIONS\s*(?P<options>\{{.*\}}))?"), _options),
    (_pattern(rf"REFRESH\s+VECTOR\s+INDEX\s+{_N}"), lambda e, g: e.refresh_vector_index(g["name"])),
    (_pattern(rf"REBUILD\s+VECTOR\s+INDEX\s+{_N}"), lambda e, g: e.build_vector_index(g["name"])),
    (_pattern(rf"ALTER\s+VECTOR\s+INDEX\s+{_N}\s+PAUSE\s+MAINTENANCE"), lambda e, g: e.pause_vector_index(g["name"])),
    (_pattern(rf"ALTER\s+VECTOR\s+INDEX\s+{_N}\s+RESUME\s+MAINTENANCE"), lambda e, g: e.resume_vector_index(g["name"])),
    (_pattern(rf"DROP\s+(?:VECTOR\s+)?INDEX\s+(?:IF\s+EXISTS\s+)?{_N}"), lambda e, g: e.drop_vector_index(g["name"])),
    (_pattern(r"SELECT\s+\*\s+FROM\s+tessera_vector_indexes"), lambda e, g: e.vector_indexes()),
    (_pattern(r"SHOW\s+VECTOR\s+INDEXES"), lambda e, g: e.vector_indexes()),
)
