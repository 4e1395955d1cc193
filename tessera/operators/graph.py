"""Property-graph operators: patterns over node and edge frames, and the rows that updates write.

A graph is where nodes and edges come from. ``StoredGraph`` reads the catalog's tagged properties;
``TypedGraph`` lays a graph over typed tables, so that filters and columns are pushed into their scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tagged as T
from ..plans import cypher as C


class StoredGraph:
    """nodes (id, label, props) and edges (id, type, src, dst, props) with tagged properties."""

    typed = False

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self._nodes, self._edges = nodes, edges

    def nodes(self, label: str | None, keys: set[str], among: set[str] | None = None) -> DataFrame:
        return self._nodes if label is None else self._nodes.filter(F.col("label") == label)

    def edges(self, types: tuple[str, ...], keys: set[str], src: str | None = None, dst: str | None = None) -> DataFrame:
        return self._edges.filter(F.col("type").isin(*types)) if types else self._edges

    def ends(self, types: tuple[str, ...], src: str | None, dst: str | None) -> None:
        """What labels the ends may have isn't known."""
        return None

    def prop(self, row: Column, key: str) -> T.Prop:
        return T.Prop(row["props"][key])


@dataclass(frozen=True)
class Rel:
    """A table of relationships between nodes of two labels: ``make`` gives a frame with id, src, dst and properties."""

    type: str
    src: str
    dst: str
    make: Callable[[], DataFrame]


@dataclass
class TypedGraph:
    """labels: label -> function that gives a frame with id and property columns. rels: tables of relationships.

    ``types`` has the tag of each property key, the same for all labels that have it; other labels get nulls. A
    pattern reads only those tables whose labels and types fit it at both ends.
    """

    typed = True
    labels: dict[str, Callable[[], DataFrame]]
    rels: tuple[Rel, ...]
    types: dict[str, str] = field(default_factory=dict)

    def _union(self, parts: list[tuple[str, Callable[[], DataFrame]]], name: str, base: tuple[str, ...], keys: set[str]) -> DataFrame:
        frames = []
        for k, make in parts:
            part = make()
            known = set(part.columns)
            cols = [F.col(c) for c in base]
            cols += [(F.col(p) if p in known else F.lit(None)).cast(T.SPARK_TYPES[self.types[p]]).alias(p) for p in sorted(keys) if p in self.types]
            frames.append(part.select(F.lit(k).alias(name), *cols))
        return reduce(lambda a, b: a.unionByName(b), frames)

    def nodes(self, label: str | None, keys: set[str], among: set[str] | None = None) -> DataFrame:
        """The nodes of a label, or of the labels ``among``."""
        parts = [(k, make) for k, make in self.labels.items() if (label is None or k == label) and (among is None or k in among)]
        none = not parts
        out = self._union(parts or list(self.labels.items())[:1], "label", ("id",), keys)
        return out.filter(F.lit(False)) if none else out

    def _fitting(self, types: tuple[str, ...], src: str | None, dst: str | None) -> list[Rel]:
        return [r for r in self.rels if (not types or r.type in types) and src in (None, r.src) and dst in (None, r.dst)]

    def edges(self, types: tuple[str, ...], keys: set[str], src: str | None = None, dst: str | None = None) -> DataFrame:
        """The relationships of these types (of all, where none is given) between nodes of these labels."""
        parts = [(r.type, r.make) for r in self._fitting(types, src, dst)]
        out = self._union(parts or [(self.rels[0].type, self.rels[0].make)], "type", ("id", "src", "dst"), keys)
        return out if parts else out.filter(F.lit(False))

    def ends(self, types: tuple[str, ...], src: str | None, dst: str | None) -> tuple[set[str], set[str]]:
        """The labels that either end can have."""
        found = self._fitting(types, src, dst)
        return {r.src for r in found}, {r.dst for r in found}

    def prop(self, row: Column, key: str) -> T.Prop:
        return T.Prop(row[key], self.types[key]) if key in self.types else T.Prop(F.lit(None).cast("string"), "string")


def _keys(s: C.Statement) -> dict[str, set[str]]:
    """Property keys by alias that a statement reads."""
    out: dict[str, set[str]] = {}
    for p in s.match:
        for x in (p,) if isinstance(p, C.Node) else (p.left, p.rel, p.right):
            out.setdefault(x.alias, set()).update(k for k, _ in x.props)
    used = [(t.alias, t.field) for t in C.tests_of(s.where)]
    if s.result:
        used += [*s.result.items, *((a, f) for a, f, _ in s.result.order)]
    for alias, name in used:
        out.setdefault(alias, set()).add(name)
    return {a: k - {"id", "label", "type"} for a, k in out.items()}


class Matcher:
    """Builds the frame of a statement's matches: one struct column for each alias."""

    def __init__(self, graph, statement: C.Statement, params: dict | None):
        self.graph, self.s, self.params = graph, statement, params
        self.kinds = C.aliases(statement.match)
        self.keys = _keys(statement)
        rel_named = any(isinstance(p, C.Path) and p.rel.named for p in statement.match)
        self.coerced = C.has_or(statement.where) and not rel_named

    def _inline(self, frame: DataFrame, row: Column, x) -> DataFrame:
        for key, value in x.props:
            frame = frame.filter(self.graph.prop(row, key).equals(C.bind(value, self.params)))
        return frame

    def node(self, n: C.Node, among: set[str] | None = None) -> DataFrame:
        frame = self.graph.nodes(n.label, self.keys.get(n.alias, set()), among)
        frame = frame.select(F.struct(*frame.columns).alias(n.alias))
        return self._inline(frame, F.col(f"`{n.alias}`"), n)

    def path(self, p: C.Path) -> DataFrame:
        edges = self.graph.edges(p.rel.types, self.keys.get(p.rel.alias, set()), p.left.label, p.right.label)
        ends = self.graph.ends(p.rel.types, p.left.label, p.right.label)
        edges = self._inline(edges.select(F.struct(*edges.columns).alias(p.rel.alias)), F.col(f"`{p.rel.alias}`"), p.rel)
        e = F.col(f"`{p.rel.alias}`")
        loop = p.left.alias == p.right.alias
        out = edges.filter(e["src"] == e["dst"]) if loop else edges
        for n, end in ((p.left, "src"),) if loop else ((p.left, "src"), (p.right, "dst")):
            among = None if ends is None else ends[0] & ends[1] if loop else ends[end == "dst"]
            out = out.join(self.node(n, among), e[end] == F.col(f"`{n.alias}`")["id"])
        return out

    def condition(self, where) -> Column:
        if isinstance(where, C.Bool):
            parts = [self.condition(p) for p in where.parts]
            return reduce(lambda a, b: a & b if where.op == "and" else a | b, parts)
        row = F.col(f"`{where.alias}`")
        kind = self.kinds[where.alias]
        if where.field == "id" or where.field == ("label" if kind == "node" else "type"):
            value = C.bind(where.value, self.params)
            own = row[where.field]
            if value is None:
                return F.lit(False)
            ops = {"=": own == value, "<": own < value, "<=": own <= value, ">": own > value, ">=": own >= value}
            return ops[where.op]
        prop = self.graph.prop(row, where.field)
        if where.op == "IS NULL":
            return prop.is_null()
        if where.op == "IS NOT NULL":
            return ~prop.is_null()
        value = C.bind(where.value, self.params)
        if where.op == "=":
            return prop.equals(value, self.coerced)
        if where.op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            return prop.matches(where.op, value)
        return prop.compares(where.op, value)

    def frame(self) -> DataFrame:
        frames = [self.node(p) if isinstance(p, C.Node) else self.path(p) for p in self.s.match]
        # Two patterns are only admitted to connect all their matches; equalities of WHERE are pushed into it.
        out = reduce(lambda a, b: a.crossJoin(b), frames)
        return out.filter(self.condition(self.s.where)) if self.s.where is not None else out

    def field(self, alias: str, name: str) -> Column:
        row = F.col(f"`{alias}`")
        if name == "id" or name == ("label" if self.kinds[alias] == "node" else "type"):
            return row[name]
        prop = self.graph.prop(row, name)
        # An explicit null reads as null.
        return prop.column if prop.tag else F.when(prop.column["t"] != "null", prop.column)

    def sort_keys(self, alias: str, name: str, desc: bool) -> list[Column]:
        row = F.col(f"`{alias}`")
        if name == "id" or name == ("label" if self.kinds[alias] == "node" else "type"):
            return [row[name].desc_nulls_last() if desc else row[name].asc_nulls_first()]
        return self.graph.prop(row, name).sort_keys(desc)

    def result(self) -> DataFrame:
        """Columns are named alias.field. A tagged property stays a tagged struct; ``QueryResult`` reads it."""
        r, frame = self.s.result, self.frame()
        names = [f"{a}.{f}" for a, f in r.items]
        cols = [self.field(a, f).alias(n) for (a, f), n in zip(r.items, names, strict=True)]
        if r.distinct:
            missing = [f"{a}.{f}" for a, f, _ in r.order if f"{a}.{f}" not in names]
            if missing:
                raise ValueError(f"DISTINCT orders by what it returns; {', '.join(missing)} isn't returned")
            out = frame.select(*cols).distinct()
            order = []
            for (alias, name), desc in [((a, f), d) for a, f, d in r.order] or [(i, False) for i in r.items]:
                own = F.col(f"`{alias}.{name}`")
                if dict(out.dtypes)[f"{alias}.{name}"] == T.TAGGED:
                    order += T.Prop(own).sort_keys(desc)
                else:
                    order.append(own.desc_nulls_last() if desc else own.asc_nulls_first())
            out = out.orderBy(*order)
        else:
            keys = [k for a, f, d in r.order for k in self.sort_keys(a, f, d)]
            out = (frame.orderBy(*keys) if keys else frame).select(*cols)
        if r.skip:
            out = out.offset(r.skip)
        return out.limit(r.limit) if r.limit is not None else out


def tagged_props(props: tuple, params: dict | None) -> dict[str, dict]:
    """Bound properties as tagged values; at most one vector."""
    out = {k: T.tagged(C.bind(v, params)) for k, v in props}
    if sum(v["t"] == "vector" for v in out.values()) > 1:
        raise ValueError("a node has one vector property at most")
    return out


def props_literal(props: dict[str, dict]) -> Column:
    """A literal property map."""
    if not props:
        return F.create_map().cast(T.PROPS)
    return F.create_map(*(c for k, v in props.items() for c in (F.lit(k), T.literal(T.untag(v))))).cast(T.PROPS)


def with_props(props: Column, changes: Column, keys: list[str]) -> Column:
    """A property map with some keys replaced."""
    return F.map_concat(F.map_filter(props, lambda k, v: ~k.isin(*keys)), changes)


def eav(frame: DataFrame, owner: str) -> DataFrame:
    """Properties as rows (owner, key, value, value_type)."""
    rows = frame.select(F.col("id").alias(owner), F.explode("props").alias("key", "p"))
    value = F.coalesce(F.col("p.s"), F.col("p.i").cast("string"), F.col("p.d").cast("string"), F.col("p.b").cast("string"), F.concat(F.lit("["), F.concat_ws(",", F.col("p.v").cast("array<string>")), F.lit("]")))
    return rows.select(owner, "key", F.when(F.col("p.t") != "null", value).alias("value"), F.col("p.t").alias("value_type"))
