"""Operator 4: secret scans through a trigram index. DataFrame functions only.

For each rule's regular expression a Boolean query of trigrams is derived that every text with a match
satisfies. The index has a posting (trigram, document) for each trigram of these queries that a document
holds; a rule's candidates are the documents whose postings satisfy its query, and only they are verified by
the expression itself. A rule without mandatory trigrams (such as bare hexadecimal runs) scans all documents.

Defined results: a null text counts as empty and has no spans; rows with one id are separate documents, and
rows that repeat a document get the same spans; a null id is an id of its own. Spans count code points, the
end is exclusive. Texts are scanned whole. Other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace
from re import _parser as sre

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole


@dataclass(frozen=True)
class Rule:
    """``regex``: what Java and Python both read. ``group`` must have ``least`` characters for a match to count."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three base kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further public token formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9a-zA-Z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: What is replaced: of a private key its body and END line too, where one follows before any other line of dashes.
REDACTED = tuple(replace(r, regex=r.regex + r"(?:[^-]*(?:-[^-]+){0,20}-----END [A-Z ]{0,30}PRIVATE KEY-----)?") if r.kind == "private_key" else r for r in RULES)

# --- Boolean trigram queries ---------------------------------------------------------------------------
# A query is True, a trigram, or ("and" | "or", queries).

TRUE = True
_MOST = 24  # strings of a set; a larger one is given up


def _join(op: str, queries) -> object:
    flat: list = []
    for q in queries:
        for x in q[1] if isinstance(q, tuple) and q[0] == op else [q]:
            if x is TRUE:
                if op == "or":
                    return TRUE
            elif x not in flat:
                flat.append(x)
    if op == "or":  # a branch that asks for all that another asks for, and more, adds nothing
        asked = [frozenset(x[1]) if isinstance(x, tuple) and x[0] == "and" else frozenset([x]) for x in flat]
        flat = [x for i, x in enumerate(flat) if not any(a < asked[i] for a in asked)]
    return TRUE if not flat else flat[0] if len(flat) == 1 else (op, tuple(flat))


def _grams(strings) -> object:
    """What holds if one of the strings occurs."""
    if not strings:
        return TRUE
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass(frozen=True)
class _Info:
    """exact: all strings that match, or None; starts and ends: one of each begins or ends every match; match: holds for every match."""

    exact: frozenset | None
    starts: frozenset
    ends: frozenset
    match: object = TRUE

    def query(self) -> object:
        return _join("and", [self.match, _grams(self.exact) if self.exact is not None else _join("and", [_grams(self.starts), _grams(self.ends)])])


_ANY = _Info(None, frozenset([""]), frozenset([""]))


def _exact(strings) -> _Info:
    s = frozenset(strings)
    return _Info(s, s, s) if len(s) <= _MOST else _ANY


def _then(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _MOST:
        return _exact(x + y for x in a.exact for y in b.exact)
    across = frozenset(x + y for x in a.ends for y in b.starts)
    starts = frozenset(x + y for x in a.exact for y in b.starts) if a.exact is not None else a.starts
    ends = frozenset(x + y for x in a.ends for y in b.exact) if b.exact is not None else b.ends
    match = _join("and", [a.match, b.match, _grams(a.exact) if a.exact is not None else TRUE, _grams(b.exact) if b.exact is not None else TRUE, _grams(across) if len(across) <= _MOST else TRUE])
    keep = lambda s, cut: frozenset(map(cut, s)) if len(s) <= _MOST else frozenset([""])
    return _Info(None, keep(starts, lambda x: x[:8]), keep(ends, lambda x: x[-8:]), match)


def _either(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= _MOST:
        return _exact(a.exact | b.exact)
    return _Info(None, a.starts | b.starts, a.ends | b.ends, _join("or", [a.query(), b.query()]))


def _chars(items) -> set | None:
    """The characters of a class in lower case, or None if there are many."""
    found: set = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            found.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(parsed) -> _Info:
    out = _exact([""])
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            info = _exact([chr(value).lower()])
        elif name == "IN":
            own = _chars(value)
            info = _exact(own) if own else _ANY
        elif name == "SUBPATTERN":
            info = _walk(value[-1])
        elif name == "BRANCH":
            parts = [_walk(p) for p in value[1]]
            info = parts[0]
            for p in parts[1:]:
                info = _either(info, p)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            one = _walk(inner)
            if low == 0:
                info = _exact(one.exact | {""}) if high == 1 and one.exact is not None else _ANY
            elif high == low and one.exact is not None and len(one.exact) ** low <= _MOST:
                info = _exact("".join(p) for p in itertools.product(one.exact, repeat=low))
            else:
                info = _Info(None, one.starts, one.ends, one.query())
        elif name == "AT":
            continue
        else:
            info = _ANY
        out = _then(out, info)
    return out


def trigram_query(regex: str) -> object:
    """A Boolean query of lower-case trigrams that every text with a match satisfies; True where none is mandatory."""
    return _walk(sre.parse(regex)).query()


def trigrams_of(query) -> set[str]:
    if query is TRUE:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# --- the index -----------------------------------------------------------------------------------------


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """docs (k, c, t) as postings (gram, k, c): one row for each of the trigrams that a document holds. gram is its place in ``grams``."""
    low = docs.select("k", "c", F.lower("t").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(g), F.lit(i)) for i, g in enumerate(grams))))
    return low.select(F.explode(held).alias("gram"), "k", "c")


def _satisfied(query, place: dict[str, int]) -> Column:
    if isinstance(query, str):
        word, bit = divmod(place[query], 62)
        return F.col(f"w{word}").bitwiseAND(F.lit(1 << bit)) != 0
    parts = [_satisfied(q, place) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k, c, rules): the documents that satisfy the query of some rule, with a bit for each such rule.

    A document's postings meet in one bit map, made before the shuffle by partial aggregation.
    """
    queries = [trigram_query(r.regex) for r in rules]
    grams = sorted(set().union(*map(trigrams_of, queries)))
    place = {g: i for i, g in enumerate(grams)}
    words = range((len(grams) + 61) // 62)
    maps = [F.bit_or(F.when((F.col("gram") >= 62 * w) & (F.col("gram") < 62 * w + 62), F.expr(f"shiftleft(1L, gram - {62 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    met = postings(docs, grams).groupBy("k", "c").agg(*maps)
    bits = F.lit(0)
    for i, q in enumerate(queries):
        if q is not TRUE:
            bits = bits + F.when(_satisfied(q, place), 1 << i).otherwise(0)
    return met.select("k", "c", bits.alias("rules")).filter("rules != 0")


def matches(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (k, c, t) as (k, c, nth, kind, start, end) for all matches that count; c is a digest of t."""
    found = candidates(docs, rules).withColumnRenamed("k", "ck").withColumnRenamed("c", "cc")
    mask = 0
    for i, r in enumerate(rules):
        mask |= (trigram_query(r.regex) is TRUE) << i
    both = docs.join(found, F.col("k").eqNullSafe(F.col("ck")) & (F.col("c") == F.col("cc")), "left")
    bits = F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(mask))

    def hits(i: int, r: Rule) -> Column:
        rx, t = F.lit(r.regex), F.col("t")
        gap = F.transform(F.split(t, r.regex, -1), lambda x: F.length(x))
        own = F.transform(F.regexp_extract_all(t, rx, F.lit(0)), lambda x: F.length(x))
        key = F.transform(F.regexp_extract_all(t, rx, F.lit(r.group)), lambda x: F.length(x)) if r.group else own
        rows = F.zip_with(gap, F.zip_with(own, key, lambda a, b: F.struct(a.alias("size"), b.alias("held"))), lambda g, s: F.struct(F.lit(i).alias("nth"), g.alias("gap"), s["size"].alias("size"), s["held"].alias("held")))
        none = F.array().cast("array<struct<nth:int,gap:int,size:int,held:int>>")
        return F.when((F.col("bits").bitwiseAND(F.lit(1 << i)) != 0) & t.rlike(r.regex), rows).otherwise(none)

    rows = both.select("k", "c", "t", bits.alias("bits"))
    rows = rows.select("k", "c", *(hits(i, r).alias(f"h{i}") for i, r in enumerate(rules)))
    some = F.lit(False)
    for i in range(len(rules)):
        some = some | (F.size(f"h{i}") > 0)
    rows = rows.filter(some).dropDuplicates(["k", "c"])
    rows = rows.select("k", "c", F.explode(F.array(*(F.col(f"h{i}") for i in range(len(rules))))).alias("h")).filter(F.size("h") > 0)
    rows = rows.select("k", "c", F.posexplode("h").alias("at", "m")).select("k", "c", "at", "m.*")
    # The last gap of each kind has no match after it; sizes before a match give its place.
    so_far = Window.partitionBy("k", "c", "nth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far) - F.coalesce("size", F.lit(0))
    rows = rows.withColumn("start", start).filter("size IS NOT NULL")
    counts = F.lit(False)
    for i, r in enumerate(rules):
        counts = counts | ((F.col("nth") == i) & (F.col("held") >= r.least))
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("nth") + 1)
    return rows.filter(counts).select("k", "c", "nth", kind.alias("kind"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end"))


def _base(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), whole(text).alias("t")).withColumn("c", F.md5("t"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: key, and found, the array of (start, nth, kind, end) in order, empty where there are none."""
    base = _base(docs, key, text)
    found = matches(base, rules).groupBy("k", "c").agg(F.sort_array(F.collect_list(F.struct("start", "nth", "kind", "end"))).alias("found"))
    found = found.withColumnRenamed("k", "fk").withColumnRenamed("c", "fc")
    both = base.select("k", "c").join(found, F.col("k").eqNullSafe(F.col("fk")) & (F.col("c") == F.col("fc")), "left")
    none = F.array().cast("array<struct<start:bigint,nth:int,kind:string,end:bigint>>")
    return both.select(F.col("k").alias(key), F.coalesce("found", none).alias("found"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = REDACTED, mark: str = "[SECRET]") -> DataFrame:
    """(k, c, clean) for the documents with secrets: the text with each run of overlapping spans replaced by ``mark``."""
    base = _base(docs, key, text)
    w = Window.partitionBy("k", "c").orderBy("start", "end", "nth")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = matches(base, rules).withColumn("new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(w)).groupBy("k", "c", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("k", "c").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")).withColumnRenamed("k", "rk").withColumnRenamed("c", "rc")
    both = base.join(runs, F.col("k").eqNullSafe(F.col("rk")) & (F.col("c") == F.col("rc"))).dropDuplicates(["k", "c"])
    n = F.size("runs")

    def piece(i):
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("runs", i - 1)["end"])
        end = F.when(i == n, F.length("t")).otherwise(F.get("runs", i)["start"])
        return F.substring(F.col("t"), (start + 1).cast("int"), (end - start).cast("int"))

    return both.select("k", "c", F.array_join(F.transform(F.sequence(F.lit(0), n), piece), mark).alias("clean"))


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = REDACTED, mark: str = "[SECRET]") -> DataFrame:
    """All documents, with all their columns; secrets in their text are replaced by ``mark``."""
    clean = redact(docs, key, text, rules, mark).select(F.col("k").alias("secret_k"), F.col("c").alias("secret_c"), F.col("clean").alias("secret_clean"))
    both = docs.join(clean, F.col(key).eqNullSafe(F.col("secret_k")) & (F.md5(whole(text)) == F.col("secret_c")), "left")
    return both.withColumn(text, F.coalesce("secret_clean", text)).select(*docs.columns)


def _listed(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    many = lambda i: F.size(F.filter("found", lambda s: s["nth"] == i)).cast("long")
    base = F.filter("found", lambda s: s["nth"] < len(BASE))
    return found.select("doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def spans_in_python(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, int]]:
    """The brute-force version that tests compare with: (start, nth, kind, end)."""
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.regex, text, re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return sorted(out)
