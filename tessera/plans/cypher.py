"""Parser of the graph language: one MATCH and/or one updating clause over single-hop patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

_LEXER = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^'\\]|\\.)*')
    |(?P<param>\$[A-Za-z_]\w*)
    |(?P<number>\d+\.\d+|\d+)
    |(?P<word>[^\W\d]\w*)
    |(?P<op><=|>=|<-|->|<|>|[-()\[\]{}:,.|=+*])""",
    re.S | re.X,
)
#: Clauses that the subset leaves out.
REJECTED = ("WITH", "OPTIONAL", "MERGE", "UNWIND", "FOREACH", "UNION", "REMOVE")
_STARTS = re.compile(r"^\s*(?:MATCH\b|CREATE\s*\(|CREATE\s+\(|OPTIONAL\s+MATCH\b|MERGE\b|UNWIND\b)")
_CALL = re.compile(r"^\s*CALL\s+db\.index\.vector\.queryNodes\s*\(", re.I)


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Node:
    alias: str
    label: str | None = None
    props: tuple[tuple[str, object], ...] = ()
    named: bool = True


@dataclass(frozen=True)
class Rel:
    alias: str
    types: tuple[str, ...] = ()
    props: tuple[tuple[str, object], ...] = ()
    named: bool = True


@dataclass(frozen=True)
class Path:
    """From left to right, however it was written."""

    left: Node
    rel: Rel
    right: Node


@dataclass(frozen=True)
class Test:
    """op: = < <= > >= 'STARTS WITH' 'ENDS WITH' CONTAINS 'IS NULL' 'IS NOT NULL'."""

    alias: str
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Bool:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Return:
    items: tuple[tuple[str, str], ...]
    distinct: bool = False
    order: tuple[tuple[str, str, bool], ...] = ()
    skip: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Statement:
    """kind: create, match_return, match_set, match_delete or match_create."""

    kind: str
    match: tuple = ()
    where: object = None
    result: Return | None = None
    create: tuple = ()
    sets: tuple[tuple[str, str, object], ...] = ()
    delete: str | None = None
    detach: bool = False

    @property
    def read_only(self) -> bool:
        return self.kind == "match_return"


@dataclass(frozen=True)
class VectorCall:
    index: str
    k: object
    query: Param
    candidates: Statement | None
    items: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]


def is_cypher(text: str) -> bool:
    return bool(_STARTS.match(text))


def is_vector_call(text: str) -> bool:
    return bool(_CALL.match(text))


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEXER.match(text, at)
            if not m:
                raise ValueError(f"cannot read the query at {at}: {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        self.made = 0

    def peek(self, *keys: str) -> bool:
        """Whether the next tokens are these (words in any case)."""
        got = self.tokens[self.at : self.at + len(keys)]
        return len(got) == len(keys) and all(kind != "string" and text.upper() == key for (kind, text), key in zip(got, keys, strict=True))

    def take(self, *keys: str) -> bool:
        if self.peek(*keys):
            self.at += len(keys)
            return True
        return False

    def need(self, *keys: str) -> None:
        if not self.take(*keys):
            raise ValueError(f"{' '.join(keys)} was expected at {self.rest()!r}")

    def rest(self) -> str:
        return " ".join(t for _, t in self.tokens[self.at : self.at + 6])

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise ValueError(f"a name was expected at {self.rest()!r}")

    def fresh(self) -> str:
        self.made += 1
        return f"__anon{self.made}"

    def value(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        sign = 1
        if text == "-" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "number":
            sign, self.at = -1, self.at + 1
            kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return text[1:-1].replace("\\'", "'")
        if kind == "number":
            return sign * (float(text) if "." in text else int(text))
        if kind == "param":
            return Param(text[1:])
        if kind == "word" and text.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text.lower()]
        self.at -= 1
        raise ValueError(f"a literal or a parameter was expected at {self.rest()!r}")

    def props(self) -> tuple:
        out = []
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out.append((key, self.value()))
                if not self.peek("}"):
                    self.need(",")
        if len({k for k, _ in out}) < len(out):
            raise ValueError("a property is named twice")
        return tuple(out)

    def node(self) -> Node:
        self.need("(")
        named = self.at < len(self.tokens) and self.tokens[self.at][0] == "word"
        alias = self.name() if named else self.fresh()
        label = None
        if self.take(":"):
            label = self.name()
            if self.peek(":"):
                raise ValueError("a node has one label")
        props = self.props()
        self.need(")")
        return Node(alias, label, props, named)

    def rel(self) -> Rel:
        self.need("[")
        named = self.at < len(self.tokens) and self.tokens[self.at][0] == "word"
        alias = self.name() if named else self.fresh()
        types = []
        if self.take(":"):
            types.append(self.name())
            while self.take("|"):
                self.take(":")
                types.append(self.name())
        if self.peek("*"):
            raise ValueError("paths of variable length are not supported")
        props = self.props()
        self.need("]")
        return Rel(alias, tuple(types), props, named)

    def pattern(self) -> Node | Path:
        left = self.node()
        if self.take("<-"):
            rel = self.rel()
            self.need("-")
            path = Path(self.node(), rel, left)
        elif self.take("-"):
            rel = self.rel()
            self.need("->")
            path = Path(left, rel, self.node())
        else:
            return left
        if self.peek("-") or self.peek("<-"):
            raise ValueError("only single-hop patterns are supported")
        return path

    def patterns(self) -> tuple:
        out = [self.pattern()]
        while self.take(","):
            out.append(self.pattern())
        return tuple(out)

    def field(self) -> tuple[str, str]:
        alias = self.name()
        self.need(".")
        return alias, self.name()

    def expression(self):
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Bool("or", tuple(parts))

    def conjunction(self):
        parts = [self.term()]
        while self.take("AND"):
            parts.append(self.term())
        return parts[0] if len(parts) == 1 else Bool("and", tuple(parts))

    def term(self):
        if self.peek("NOT"):
            raise ValueError("NOT is not supported")
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        alias, field = self.field()
        for words in (("IS", "NOT", "NULL"), ("IS", "NULL")):
            if self.take(*words):
                return Test(alias, field, " ".join(words))
        for words in (("STARTS", "WITH"), ("ENDS", "WITH"), ("CONTAINS",)):
            if self.take(*words):
                return Test(alias, field, " ".join(words), self.value())
        for op in ("<=", ">=", "=", "<", ">"):
            if self.take(op):
                return Test(alias, field, op, self.value())
        raise ValueError(f"a predicate was expected at {self.rest()!r}")

    def count(self, least: int, what: str) -> int:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "number" or "." in text or int(text) < least:
            raise ValueError(f"{what} needs an integer of {least} at least")
        self.at += 1
        return int(text)

    def result(self) -> Return:
        distinct = self.take("DISTINCT")
        items = [self.field()]
        while self.take(","):
            items.append(self.field())
        order, skip, limit = [], None, None
        if self.take("ORDER", "BY"):
            while True:
                alias, field = self.field()
                desc = self.take("DESC") or self.take("DESCENDING")
                if not desc:
                    self.take("ASC") or self.take("ASCENDING")
                order.append((alias, field, desc))
                if not self.take(","):
                    break
        if self.take("SKIP") or self.take("OFFSET"):
            skip = self.count(0, "SKIP")
        if self.take("LIMIT"):
            limit = self.count(1, "LIMIT")
        return Return(tuple(items), distinct, tuple(order), skip, limit)

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.rest()!r}")

    def statement(self) -> Statement:
        for word in REJECTED:
            if self.peek(word):
                raise ValueError(f"{word} is not supported")
        if self.take("CREATE"):
            made = self.patterns()
            self.end()
            return Statement("create", create=made)
        self.need("MATCH")
        match = self.patterns()
        where = self.expression() if self.take("WHERE") else None
        if self.take("RETURN"):
            if len(match) > 1:
                raise ValueError("a MATCH ... RETURN has one pattern")
            out = Statement("match_return", match, where, self.result())
        elif self.take("SET"):
            sets = []
            while True:
                alias, field = self.field()
                self.need("=")
                sets.append((alias, field, self.value()))
                if not self.take(","):
                    break
            out = Statement("match_set", match, where, sets=tuple(sets))
        elif self.peek("DETACH") or self.peek("DELETE"):
            detach = self.take("DETACH")
            self.need("DELETE")
            out = Statement("match_delete", match, where, delete=self.name(), detach=detach)
        elif self.take("CREATE"):
            out = Statement("match_create", match, where, create=self.patterns())
        else:
            raise ValueError(f"RETURN, SET, DELETE or CREATE was expected at {self.rest()!r}")
        self.end()
        return out


def aliases(patterns: tuple) -> dict[str, str]:
    """Alias to "node" or "rel"."""
    out: dict[str, str] = {}
    for p in patterns:
        for x in (p,) if isinstance(p, Node) else (p.left, p.rel, p.right):
            out[x.alias] = "rel" if isinstance(x, Rel) else "node"
    return out


def tests_of(where) -> list[Test]:
    if where is None:
        return []
    return [where] if isinstance(where, Test) else [t for p in where.parts for t in tests_of(p)]


def has_or(where) -> bool:
    return isinstance(where, Bool) and (where.op == "or" or any(map(has_or, where.parts)))


@lru_cache(256)
def parse(text: str) -> Statement:
    """The statement, with its aliases and predicates checked; ValueError for what the subset leaves out."""
    p = _Parser(text.strip().rstrip(";"))
    s = p.statement()
    known = aliases(s.match)
    used = [(t.alias, t.field) for t in tests_of(s.where)] + [(a, f) for a, f, _ in s.sets]
    if s.result:
        used += [*s.result.items, *((a, f) for a, f, _ in s.result.order)]
    for alias, _ in used:
        if alias not in known:
            raise ValueError(f"unknown alias {alias!r}")
    for t in tests_of(s.where):
        kind = "type" if known[t.alias] == "rel" else "label"
        if t.field == "id" and (t.op not in ("=", "<", "<=", ">", ">=")):
            raise ValueError(f"id does not support {t.op}")
        if t.field == kind and t.op != "=":
            raise ValueError(f"{kind} only supports =")
    if s.delete is not None:
        if s.delete not in known:
            raise ValueError(f"unknown alias {s.delete!r}")
        if known[s.delete] == "node" and not s.detach:
            raise ValueError("a node is deleted with DETACH DELETE")
        if known[s.delete] == "rel" and s.detach:
            raise ValueError("DETACH DELETE is for nodes")
    if any(f in ("id", "label", "type") for _, f, _ in s.sets):
        raise ValueError("id, label and type can't be set")
    return s


@lru_cache(256)
def parse_vector_call(text: str) -> VectorCall:
    p = _Parser(text.strip().rstrip(";"))
    for word in ("CALL", "DB", ".", "INDEX", ".", "VECTOR", ".", "QUERYNODES", "("):
        p.need(word)
    index = p.value()
    if not isinstance(index, str):
        raise ValueError("queryNodes needs a quoted index name")
    p.need(",")
    k = p.value()
    p.need(",")
    query = p.value()
    if not isinstance(query, Param):
        raise ValueError("queryNodes needs a named parameter as its query vector")
    p.need(")")
    for word in ("YIELD", "NODE", ",", "SCORE"):
        p.need(word)
    match: tuple = ()
    where = None
    if p.take("MATCH"):
        match = (p.pattern(),)
    if p.take("WHERE"):
        where = p.expression()
    p.need("RETURN")
    items, order = [], []

    def item() -> str:
        if p.take("NODE", ".", "ID"):
            return "node.id"
        p.need("SCORE")
        return "score"

    items.append(item())
    while p.take(","):
        items.append(item())
    if p.take("ORDER", "BY"):
        while True:
            key = item()
            desc = p.take("DESC")
            if not desc:
                p.take("ASC")
            order.append((key, desc))
            if not p.take(","):
                break
    p.end()
    candidates = None
    if match or where is not None:
        match = match or (Node("node"),)
        if "node" not in aliases(match):
            raise ValueError("the MATCH of queryNodes needs the alias node")
        candidates = Statement("match_return", match, where, Return((("node", "id"),), True))
        for t in tests_of(where):
            if t.alias not in aliases(match):
                raise ValueError(f"unknown alias {t.alias!r}")
    return VectorCall(index, k, query, candidates, tuple(items), tuple(order))


def bind(value, params: dict | None):
    """A literal, or a parameter's value."""
    if isinstance(value, Param):
        if not params or value.name not in params:
            raise ValueError(f"missing parameter ${value.name}")
        return params[value.name]
    return value
