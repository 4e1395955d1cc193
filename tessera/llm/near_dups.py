"""Operator 6: near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. IDF. A shingle's document frequency counts all documents. Frequencies below ``FLOOR`` of the documents
   count as that share, so that only the more frequent shingles must be known. Each chunk of documents
   reports the shingles that reach half the floor in it; a shingle that reaches the floor over all documents
   must gather half of it in such reports, and at most 2 / FLOOR times the mean number of shingles of a
   document can. These candidates, of a number that doesn't grow with the corpus, are then counted exactly.
2. ICWS. Each text gets ``BANDS * ROWS`` samples; two texts share a sample with a chance equal to the
   weighted Jaccard similarity of their shingles. Exact copies are one content from here on.
3. Buckets. Each band of samples is a key. In each bucket the most central content (the one whose buckets
   hold the most) is the pivot; every other member is compared with it, never all with all.
4. Verification by exact weighted Jaccard similarity of the whole texts. Pairs at the threshold or above are
   links. Groups with a member of another class than the pivot's are compared with a second, more central
   pivot (``centred``). Members that are still of another class can only be linked with a member that differs
   from the pivot in the same shingles; such pairs are found through these shingles, without loss
   (``open_pairs``), and verified too. No step is quadratic in a group, and no group needs a task of its own.
5. Classes are the connected components of the links, by star contraction in DataFrames.

Defined results: a null text counts as empty; texts without words are only classed with equal texts; a text
of fewer than five words is one shingle; rows with one id are separate documents; null ids are classed, and
a class's id is its smallest known id (null where none is known). Other columns aren't read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, mix, shingle_hashes, ship, whole

WIDTH = 5
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
#: Share of the documents below which frequencies count alike.
FLOOR = 0.01
#: How much more a rare shingle weighs than one that every document has: 1 + STRENGTH.
STRENGTH = 0.5
#: Members of a group that are dealt to one part of it.
PART = 64
#: The last bit of a token: set for a shingle that a text lacks of its pivot, else it has it besides.
_LACKS = np.uint64(1)
#: What rounding may take from a similarity that is the threshold.
EQUAL = 1e-9
CHUNK = 1 << 20  # shingles that are counted at a time
RUN = 1 << 16  # words that are hashed at a time
_TABLE = 16  # bits of an entry of the tables of random numbers


class Weights:
    """Weight of a shingle by its document frequency: 1 + strength * ln(n / df) / ln(1 / floor), df at least floor * n."""

    def __init__(self, n_docs: int, hashes: np.ndarray, df: np.ndarray, strength: float = STRENGTH, floor: float = FLOOR):
        order = np.argsort(hashes)
        self.hashes, self.most = hashes[order], 1 + strength
        share = np.clip(df[order] / max(1, n_docs), floor, 1.0)
        self.weights = 1 + strength * np.log(1 / share) / np.log(1 / floor)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.most)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[at] == h
            out[same] = self.weights[at[same]]
        return out


def _uniform(k: int, j: int) -> np.ndarray:
    x = mix(np.arange(1 << _TABLE, dtype=np.uint64) + np.uint64((k * 8 + j + 1) << 32))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@lru_cache(1)
def _tables():
    """For each sample: the multiplier that picks an entry, and r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    odd = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    return [
        (
            odd[k],
            (-np.log(_uniform(k, 0) * _uniform(k, 1))).astype(np.float32),
            np.log(-np.log(_uniform(k, 2) * _uniform(k, 3))).astype(np.float32),
            _uniform(k, 4).astype(np.float32),
        )
        for k in range(SAMPLES)
    ]


def weighted_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, their counts, and how many each text has."""
    h, n = shingle_hashes(texts, WIDTH)
    ends = np.cumsum(n)
    found = [np.unique(h[e - k : e], return_counts=True) for e, k in zip(ends, n, strict=True)]
    if not found:
        return h, np.zeros(0, np.int64), n
    return np.concatenate([u for u, _ in found]), np.concatenate([c for _, c in found]), np.array([len(u) for u, _ in found], np.int64)


def sketch(h: np.ndarray, weights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SAMPLES numbers of 32 bits for each text that has shingles (n > 0), in the order of those texts."""
    n = n[n > 0]
    if not len(n):
        return np.zeros((0, SAMPLES), np.uint32)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    text_of = np.repeat(np.arange(len(n)), n)
    lw = np.log(weights).astype(np.float32)
    out = np.zeros((len(n), SAMPLES), np.uint32)
    for k, (odd, r_all, lc_all, beta_all) in enumerate(_tables()):
        entry = ((h * odd) >> np.uint64(64 - _TABLE)).astype(np.int32)
        r, beta = r_all[entry], beta_all[entry]
        t = np.floor(lw / r + beta)
        ln_a = lc_all[entry] - r * (t - beta + 1)
        least = np.minimum.reduceat(ln_a, first)
        hit = np.flatnonzero(ln_a == least[text_of])
        at = np.zeros(len(n), np.int64)
        at[text_of[hit[::-1]]] = hit[::-1]
        out[:, k] = mix(h[at] + (t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) + np.uint64(k)).astype(np.uint32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    """Weighted Jaccard similarity of two weighted sets (sorted hashes, counts)."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    w = weights.of(both)
    shared = float((w * np.minimum(a[1][ia], b[1][ib])).sum())
    total = float((weights.of(a[0]) * a[1]).sum() + (weights.of(b[0]) * b[1]).sum()) - shared
    return shared / total if total else 0.0


def _chunks(column, most: int = RUN):
    """Texts of a column in runs of about so many words at most."""
    run, size = [], 0
    for t in column.to_pylist():
        run.append(t)
        size += len(t) // 6 + 1
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def document_frequencies(texts: DataFrame, strength: float = STRENGTH, floor: float = FLOOR) -> Weights:
    """Weights from one text column over all its rows."""
    ship(texts.sparkSession)

    def report(batches):
        pend: list[np.ndarray] = []
        docs = size = 0

        def close():
            u, c = np.unique(np.concatenate(pend), return_counts=True) if pend else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = c >= max(1, floor / 2 * docs)
            u, c = np.append(u[some], np.uint64(0)), np.append(c[some], docs)
            flag = np.zeros(len(u), bool)
            flag[-1] = True
            return pa.RecordBatch.from_arrays([pa.array(flag), pa.array(u.astype(np.int64)), pa.array(c.astype(np.int64))], ["total", "h", "n"])

        for batch in batches:
            for run in _chunks(batch.column(0)):
                u, _, _ = weighted_sets(run)
                pend.append(u)
                docs, size = docs + len(run), size + len(u)
                if size >= CHUNK:
                    yield close()
                    pend, docs, size = [], 0, 0
        yield close()

    got = texts.mapInArrow(report, "total boolean, h bigint, n bigint").groupBy("total", "h").agg(F.sum("n").alias("n"))
    got = keep(got)
    n_docs = (got.filter("total").agg(F.sum("n")).first()[0]) or 0
    rows = got.filter(~F.col("total") & (F.col("n") >= floor / 2 * n_docs)).select("h").orderBy("h").collect()
    candidates = np.array([r.h for r in rows], np.int64).astype(np.uint64)
    candidates.sort()

    def count(batches):
        sums = np.zeros(len(candidates), np.int64)
        for batch in batches:
            for run in _chunks(batch.column(0)):
                u, _, _ = weighted_sets(run)
                at = np.minimum(np.searchsorted(candidates, u), len(candidates) - 1)
                sums += np.bincount(at[candidates[at] == u], minlength=len(candidates))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(sums[some])], ["at", "n"])

    df = np.zeros(len(candidates), np.int64)
    if len(candidates):
        for r in texts.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            df[r["at"]] = r["n"]
    return Weights(n_docs, candidates, df, strength, floor)


def sketches(docs: DataFrame, weights: Weights) -> DataFrame:
    """docs (k, t) as (k, c, sketch): c identifies the content, the sketch is null where the text has no words."""
    ship(docs.sparkSession)
    base = docs.select("k", F.unhex(F.md5("t")).alias("c"), "t")
    kind = base.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(2)):
                h, c, n = weighted_sets(texts)
                found = iter(sketch(h, weights.of(h) * c, n))
                cells = [next(found).tobytes() if k else None for k in n]
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.binary())], ["k", "c", "sketch"])
                at += len(texts)

    return base.mapInArrow(run, f"k {kind}, c binary, sketch binary")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The contents ``wanted`` (c, rep) with their texts (c, t), one row for each.

    Always a merge join: the list of contents grows with the corpus.
    """
    found = docs.select("k", "t", F.unhex(F.md5("t")).alias("dc")).join(wanted.hint("merge"), F.col("k").eqNullSafe(F.col("rep")) & (F.col("dc") == F.col("c")))
    return keep(found.select("c", "t").dropDuplicates(["c"]))


def parted(groups: DataFrame) -> DataFrame:
    """groups (p, n, ...) with a row for each part of at most about PART members, as ``part``: the other side of a join on (p, part)."""
    return groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART).cast("int") - 1)))


def with_part(members: DataFrame) -> DataFrame:
    """members (p, c, n, ...) with the part of the group that each is dealt to, so that no group needs a task of its own."""
    return members.withColumn("part", F.pmod(F.xxhash64("c"), F.ceil(F.col("n") / PART)).cast("int"))


def differences(own: tuple[np.ndarray, np.ndarray], pivot: tuple[np.ndarray, np.ndarray], weights: Weights) -> tuple[float, float, float, np.ndarray, np.ndarray]:
    """What a text lacks of its pivot's weight, what it has besides, the pivot's weight, and both as tokens with their weights."""
    _, i, j = np.intersect1d(own[0], pivot[0], assume_unique=True, return_indices=True)
    least = np.minimum(own[1][i], pivot[1][j])
    more, less = own[1].copy(), pivot[1].copy()
    more[i] -= least
    less[j] -= least
    of_pivot = weights.of(pivot[0])
    r, m = weights.of(own[0][more > 0]) * more[more > 0], of_pivot[less > 0] * less[less > 0]
    tokens = np.concatenate((own[0][more > 0] & ~_LACKS, pivot[0][less > 0] | _LACKS))
    return float(m.sum()), float(r.sum()), float((of_pivot * pivot[1]).sum()), tokens, np.concatenate((r, m))


_COMPARED = pa.schema([("p", pa.binary()), ("c", pa.binary()), ("s", pa.float64()), ("m", pa.float64()), ("r", pa.float64()), ("wp", pa.float64()), ("tokens", pa.list_(pa.int64())), ("token_weights", pa.list_(pa.float64()))])


def compare(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """pairs (p, c, n, part) with s, the exact weighted Jaccard similarity of their whole texts, and how they differ.

    m and r are the weights that c lacks of p and has besides, wp is the weight of p. Groups of several
    members have the differences also as tokens with their weights. Each part of a group is a sorted run of
    rows that begins with its pivot's text, so that texts are streamed and the pivot's isn't copied to every row.
    """
    members = pairs.join(texts.hint("merge"), "c").select("p", "part", F.lit(1).alias("kind"), "c", (F.col("n") > 1).alias("many"), "t")
    heads = parted(pairs.groupBy("p").agg(F.max("n").alias("n")).join(texts.withColumnRenamed("c", "p").hint("merge"), "p")).select("p", "part", F.lit(0).alias("kind"), F.col("p").alias("c"), F.lit(False).alias("many"), "t")

    def run(batches):
        pivot = None
        for batch in batches:
            at = 0
            for texts_of_run in _chunks(batch.column(5)):
                h, count, n = weighted_sets(texts_of_run)
                ends = np.cumsum(n)
                part = batch.slice(at, len(texts_of_run))
                at += len(texts_of_run)
                rows = []
                for p, kind, c, many, e, k in zip(*(part.column(x).to_pylist() for x in (0, 2, 3, 4)), ends, n, strict=True):
                    own = h[e - k : e], count[e - k : e]
                    if not kind:
                        pivot = own[0].copy(), own[1].copy()
                        continue
                    m, r, wp, tokens, token_weights = differences(own, pivot, weights)
                    rows.append((p, c, (wp - m) / (wp + r) if wp + r else 0.0, m, r, wp, tokens.astype(np.int64) if many else None, token_weights if many else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _COMPARED, strict=True)], schema=_COMPARED)

    dealt = heads.unionByName(members).repartition("p", "part").sortWithinPartitions("p", "part", "kind", "c")
    return keep(dealt.mapInArrow(run, "p binary, c binary, s double, m double, r double, wp double, tokens array<bigint>, token_weights array<double>"))


def centred(placed: DataFrame, compared: DataFrame) -> DataFrame:
    """The members of open groups as (p, c, n, part) with a better pivot each: the member nearest to what most of its group have.

    placed: (p, c, n, part) of the open groups. The distance from what more than half of the members have in
    common is, but for a constant of the group, the weight of a member's tokens less twice that of the common ones.
    """
    each = placed.join(compared.select("p", "c", "tokens", "token_weights"), ["p", "c"]).select("p", "c", "n", "part", F.explode(F.arrays_zip("tokens", "token_weights")).alias("x"))
    each = each.select("p", "c", "n", "part", F.col("x.tokens").alias("h"), F.col("x.token_weights").alias("w"))
    common = keep(each.groupBy("p", "h").agg(F.count("*").alias("held"), F.max("n").alias("of")).filter("held * 2 > of").select("p", "h", F.lit(1.0).alias("common")))
    far = each.join(common, ["p", "h"], "left").groupBy("p", "c").agg(F.sum(F.col("w") * (1 - 2 * F.coalesce("common", F.lit(0.0)))).alias("far"))
    best = far.groupBy("p").agg(F.min(F.struct("far", "c")).alias("best"))
    # The pivot has no tokens and so stands at 0; so does a member that equals it word for word.
    sizes = placed.groupBy("p").agg(F.max("n").alias("n")).join(best, "p", "left")
    chosen = keep(sizes.select("p", "n", F.when(F.col("best.far") < 0, F.col("best.c")).otherwise(F.col("p")).alias("q")))
    own = placed.join(parted(chosen).select("p", "part", "q"), ["p", "part"]).select("q", "c").union(chosen.select("q", F.col("p").alias("c")))
    pairs = keep(own.filter("q != c").select(F.col("q").alias("p"), "c").distinct())
    return keep(with_part(pairs.join(keep(pairs.groupBy("p").agg(F.count("*").alias("n"))), "p")))


def open_pairs(placed: DataFrame, compared: DataFrame, threshold: float) -> DataFrame:
    """Pairs (p, c) of members of one group, of different classes, that the comparison with their pivot leaves open.

    placed: (p, c, root, main) of the groups with a member of another class than the pivot's. Let m be the
    weight that c or d lacks of the pivot, r what it has besides, and g what they have in common of either.
    Their similarity is exactly (wp - m_c - m_d + g) / (wp + r_c + r_d - g), and the threshold t asks for

        (1 + t) g >= o_c + t r_d + m_d, where o_c = t r_c + m_c - (1 - t) wp.

    A member that isn't linked with the pivot has o_c > 0, so that it is linked with another only if they
    share tokens. Pairs are made at the rarest token that they share of what they have besides, or, where they
    share none of these, of what they lack: g can't be above the weights of tokens at least as common
    (``rest``), and what they lack in common (l). No pair is lost; one that shares little but common tokens isn't made.
    """
    slack = EQUAL * 1000
    rows = placed.join(compared.select("p", "c", "m", "r", "wp", "tokens", "token_weights"), ["p", "c"])
    over = F.lit(threshold) * F.col("r") + F.col("m") - F.lit(1 - threshold) * F.col("wp")
    rows = rows.withColumns({"o": over, "cost": F.lit(threshold) * F.col("r") + F.col("m")})
    each = rows.select("p", "c", "root", "main", "o", "cost", F.explode(F.arrays_zip("tokens", "token_weights")).alias("x"))
    each = keep(each.select("p", "c", "root", "main", "o", "cost", F.col("x.tokens").alias("h"), F.col("x.token_weights").alias("w")))
    held = keep(each.groupBy("p", "h").agg(F.count("*").alias("held")).filter("held > 1"))
    lacks = F.col("h").bitwiseAND(F.lit(1)) == 1
    own = Window.partitionBy("p", "c")
    shared = each.join(held, ["p", "h"]).withColumn("l", F.sum(F.when(lacks, F.col("w")).otherwise(0.0)).over(own))
    shared = shared.withColumn("rest", F.sum("w").over(Window.partitionBy("p", "c", lacks).orderBy(F.desc("held"), "h").rowsBetween(Window.unboundedPreceding, 0)))
    shared = keep(shared.select("p", "h", "c", "root", "main", "o", "cost", "l", "rest"))
    more = lambda x: F.when(lacks, 0.0).otherwise(x)
    of_c = (1 + threshold) * F.col("rest") + more(threshold * F.col("l")) >= F.col("o") - slack
    of_d = (1 + threshold) * (F.col("rest") + more(F.col("l"))) >= F.col("cost") - slack
    left = shared.filter((F.col("root") != F.col("main")) & of_c).select("p", "h", *(F.col(x).alias(x + "_c") for x in ("c", "root", "o", "l", "rest")))
    right = shared.filter(of_d).select("p", "h", *(F.col(x).alias(x + "_d") for x in ("c", "root", "cost", "l", "rest")))
    possible = (1 + threshold) * (F.least("rest_c", "rest_d") + more(F.least("l_c", "l_d"))) >= F.col("o_c") + F.col("cost_d") - slack
    both = left.join(right, ["p", "h"]).filter((F.col("root_c") != F.col("root_d")) & possible)
    return both.select(F.greatest("c_c", "c_d").alias("p"), F.least("c_c", "c_d").alias("c")).distinct()


def star_components(links: DataFrame) -> DataFrame:
    """links (c, p) of members with pivots as (c, root) for each linked node.

    A member that is no pivot itself hangs on its smallest pivot and connects its pivots; only these are
    contracted, so that a hub with many members is a node of few edges.
    """
    pivots = keep(links.select(F.col("p").alias("c")).distinct())
    least = keep(links.groupBy("c").agg(F.min("p").alias("one")))
    between = links.join(least, "c").filter("p != one").select(F.col("one").alias("a"), F.col("p").alias("b"))
    among = least.join(pivots, "c", "left_semi").select(F.col("c").alias("a"), F.col("one").alias("b"))
    found = components(between.union(among))
    roots = keep(pivots.join(found, "c", "left").select("c", F.coalesce("root", "c").alias("root")))
    hung = least.join(pivots, "c", "left_anti").join(roots.withColumnRenamed("c", "one"), "one").select("c", "root")
    return keep(roots.union(hung))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) as (c, root) for each linked node: connected components by alternating large and small stars.

    Nothing is collected but a count and a checksum for each round; hubs are joined with one row each.
    """
    edges = keep(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("c"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("c"), F.col("v").alias("root"))).distinct()


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, strength: float = STRENGTH, floor: float = FLOOR) -> DataFrame:
    """One row for each document: k, c (a digest of its text), class_id, class_size, n_verified and kept."""
    ship(docs.sparkSession)
    base = docs.select(F.col(key).alias("k"), whole(text).alias("t"))
    weights = document_frequencies(base.select("t"), strength, floor)
    sketched = keep(sketches(base, weights))
    contents = keep(sketched.groupBy("c").agg(F.min("k").alias("rep"), F.count("*").alias("copies"), F.max("sketch").alias("sketch")))

    # Sizes and pivots are written, so that a join with them is one that Spark splits where a bucket is hot.
    band = F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))).alias("key")
    rows = contents.filter("sketch IS NOT NULL").select("c", band)
    sizes = keep(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = keep(rows.join(sizes, "key"))
    central = members.groupBy("c").agg(F.sum("n").alias("central"))
    members = keep(members.select("key", "c").join(central, "c"))
    pivots = keep(members.groupBy("key").agg(F.max(F.struct("central", "c"))["c"].alias("p")))
    starred = keep(members.join(pivots, "key").filter("c != p").select("p", "c").distinct())
    groups = keep(starred.groupBy("p").agg(F.count("*").alias("n")))
    starred = keep(with_part(starred.join(groups, "p")))
    texts = texts_of(starred.select("c").union(starred.select("p")).distinct().join(contents.select("c", "rep"), "c"), base)
    compared = compare(starred, texts, weights)
    first = compared.filter(F.col("s") >= threshold - EQUAL).select("c", "p")

    # What the pivots left open: members of another class than their group's pivot. Open groups get a more
    # central pivot, and then what is still open is settled by pairs.
    def root(name, to):
        return F.coalesce(F.col(to), F.col(name)).alias(to)

    def placed_in(stars, classes):
        """stars (p, c, n, part) of groups that are open still, with the classes of c and p as root and main."""
        mains = stars.groupBy("p").agg(F.max("n").alias("n")).join(classes.select(F.col("c").alias("p"), F.col("root").alias("main")), "p", "left").select("p", "n", root("p", "main"))
        placed = stars.join(classes, "c", "left").select("p", "c", "n", "part", root("c", "root"))
        placed = keep(placed.filter("n > 1").join(parted(keep(mains)).select("p", "part", "main"), ["p", "part"]))
        astray = keep(placed.filter("root != main").groupBy("p").agg(F.max("n").alias("n")))
        return keep(placed.join(parted(astray).select("p", "part"), ["p", "part"], "left_semi"))

    classes = star_components(first)
    again = centred(placed_in(starred, classes).select("p", "c", "n", "part"), compared)
    known = keep(again.select("p", "c").join(compared.filter("tokens IS NOT NULL"), ["p", "c"]))
    anew = compare(keep(again.join(known.select("p", "c"), ["p", "c"], "left_anti")), texts, weights)
    links = keep(first.union(anew.filter(F.col("s") >= threshold - EQUAL).select("c", "p")))
    classes = star_components(links)
    rest = keep(open_pairs(placed_in(again, classes).select("p", "c", "root", "main"), known.unionByName(anew), threshold))
    second = compare(keep(with_part(rest.join(keep(rest.groupBy("p").agg(F.count("*").alias("n"))), "p"))), texts, weights).filter(F.col("s") >= threshold - EQUAL).select("c", "p")

    # The last links connect classes.
    named = second.join(classes, "c", "left").select("p", root("c", "root")).join(classes.select(F.col("c").alias("p"), F.col("root").alias("main")), "p", "left").select("root", root("p", "main"))
    joined = keep(components(named.select(F.col("root").alias("a"), F.col("main").alias("b"))).select(F.col("c").alias("root"), F.col("root").alias("last")))
    links = links.union(second).select(F.greatest("c", "p").alias("c"), F.least("c", "p").alias("p")).distinct()
    degree = links.select("c").union(links.select("p")).groupBy("c").agg(F.count("*").alias("n_verified"))
    mapped = contents.select("c", "rep", "copies").join(classes, "c", "left").select("c", "rep", "copies", root("c", "root"))
    mapped = mapped.join(joined, "root", "left").select("c", "rep", "copies", F.coalesce("last", "root").alias("root"))
    best = keep(mapped.groupBy("root").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull().alias("x"), "rep", "c"))["c"].alias("first"), F.sum("copies").alias("class_size")))
    mapped = mapped.join(best, "root").join(degree, "c", "left").select("c", "class_id", "class_size", F.coalesce("n_verified", F.lit(0)).alias("n_verified"), (F.col("c") == F.col("first")).alias("standing"), "rep")
    mapped = keep(mapped)
    found = sketched.select("k", "c").join(mapped, "c")
    return found.select("k", "c", "class_id", "class_size", "n_verified", (F.col("standing") & F.col("k").eqNullSafe(F.col("rep"))).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, strength: float = STRENGTH, floor: float = FLOOR) -> DataFrame:
    """One row for each document: key, class_id, class_size, n_verified and kept.

    n_verified: the pairs of this document's content that were compared and reach the threshold; a class is
    connected by such pairs, of which not all have to be compared. kept: true for the document that stands
    for its class (rows that repeat it exactly are kept with it). ``strength`` and ``floor`` shape the weights.
    """
    found = classes_of(docs, key, text, threshold, strength, floor)
    return found.select(F.col("k").alias(key), "class_id", "class_size", "n_verified", "kept")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents, with all their columns, of which one of each class stays; of repeated rows, one."""
    kept = classes_of(docs, key, text, threshold).filter("kept").groupBy(F.col("k").alias("near_k"), F.col("c").alias("near_c")).agg(F.count("*").alias("near_n"))
    kept = keep(kept)
    digest = F.unhex(F.md5(whole(text)))
    found = docs.withColumn("near_digest", digest).join(kept, F.col(key).eqNullSafe(F.col("near_k")) & (F.col("near_digest") == F.col("near_c")))
    if kept.filter("near_n > 1").limit(1).count():
        found = found.dropDuplicates(["near_k", "near_c"])
    return found.select(*docs.columns)


def op6_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
