"""Operator 9: document fingerprints by a randomised edit embedding.

A pointer walks over the characters of a text. At each step the character under it is written out, and a
random bit, shared by all texts and drawn from the step's number and the character, says whether the pointer
moves on. Walks over texts of small edit distance fall into step again soon after each edit, so that their
outputs have a small Hamming distance. The fingerprint samples the output: ``SAMPLES`` places of each octave
of steps, the same for every text, each place as a byte drawn from the last four characters written. The
share of equal samples, weighted by the steps that they stand for, estimates the likeness of two texts.

Two fingerprints are linked if they share a band of samples and their likeness, compared over all samples,
reaches the threshold. The query links each document with its edited text and with the next document;
``near_links`` finds the links of a whole table through the bands.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, alike (1.0) only to
itself; equal texts have equal fingerprints; ids are of any type that can be ordered; a null id stands after
all others; rows with one id stand in the order of a hash of their texts. Texts are walked whole. Other
columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, mix, ship, whole
from .near_dups import components

#: Sampled places of each octave of steps.
SAMPLES = 64
#: Samples that are no part of a band, because every text of one language begins alike, and samples of a band.
SKIP, WIDTH = 64, 4
#: Likeness from which on texts that share a band are linked.
THRESHOLD = 0.8
#: Documents of a range, and ranges at most: ranges grow beyond PART_ROWS where there would be more.
PART_ROWS, MOST_PARTS = 5_000, 20_000
#: Characters that are walked at a time, which bounds what a worker holds.
CHUNK = 12 << 20
PAD = 0xFFFFFFFF


def places(octaves: int = 40) -> tuple[list[int], np.ndarray]:
    """The sampled steps and the number of steps that each stands for."""
    at, weight = [0], [1.0]
    for k in range(octaves):
        low = 1 << k
        if low <= SAMPLES:
            own = list(range(low, 2 * low))
        else:
            h = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(k * SAMPLES + 1))
            cell = low // SAMPLES
            own = [low + j * cell + int(x) % cell for j, x in enumerate(h)]
        at += own
        weight += [low / len(own)] * len(own)
    return at, np.array(weight)


PLACES, WEIGHTS = places()


def samples(texts: list[str]) -> np.ndarray:
    """A row of sampled bytes for each text; 0 past the end of its walk."""
    if not texts:
        return np.zeros((0, 0), np.uint8)
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    pad = PAD.to_bytes(4, "little")
    cp = np.frombuffer(pad.join([*raw, b""]), np.uint32)
    sizes = np.array([len(r) // 4 for r in raw], np.int64)
    start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    alive = np.flatnonzero(sizes)
    at = start[alive]
    seen = np.zeros(len(alive), np.uint32)
    out: list[np.ndarray] = []
    step, nth, pad32 = 0, 0, np.uint32(PAD)
    block = 256
    while len(alive):
        seeds = mix(np.arange(step, step + block, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
        for s in seeds:
            c = cp[at]
            seen <<= 8
            seen |= (c * np.uint32(0x9E3779B1)) >> np.uint32(24)
            if step == PLACES[nth]:
                row = np.zeros(len(texts), np.uint8)
                row[alive] = np.where(c == pad32, 0, 1 + mix(seen.astype(np.uint64)) % np.uint64(255))
                out.append(row)
                nth += 1
            move = ((c ^ s) * np.uint32(0x85EBCA6B)) >> np.uint32(31)
            move[c == pad32] = 0
            at += move
            step += 1
        on = cp[at] != pad32
        if not on.all():
            alive, at, seen = alive[on], at[on], seen[on]
    return np.stack(out, 1) if out else np.zeros((len(texts), 0), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted share of equal samples, row by row, between 0 and 1."""
    w = WEIGHTS[: a.shape[1]]
    both = ((a > 0) | (b > 0)) @ w if a.shape[1] else np.zeros(len(a))
    same = ((a == b) & (a > 0)) @ w if a.shape[1] else np.zeros(len(a))
    return np.where(both > 0, same / np.where(both > 0, both, 1), 1.0)


def share_band(a: np.ndarray, b: np.ndarray, skip: int = SKIP, width: int = WIDTH) -> np.ndarray:
    """Whether two rows of samples share one of the bands that ``bands`` gives them."""
    n = a.shape[1]
    used = [(x > 0).sum(1) for x in (a, b)]
    small = np.minimum(*used) < skip + width
    out = small & (used[0] == used[1]) & (a == b).all(1)
    if n >= skip + width:
        last = skip + (n - skip) // width * width
        same = ((a == b) & (a > 0))[:, skip:last].reshape(len(a), -1, width).all(2).any(1)
        out |= ~small & same
    return out


def as_text(row: np.ndarray) -> str:
    """A fingerprint as text: its samples up to the last, in base 64."""
    used = np.flatnonzero(row)
    return base64.b64encode(row[: used[-1] + 1].tobytes()).decode() if len(used) else ""


def from_text(fingerprint: str, width: int = 0) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    return np.concatenate((raw, np.zeros(max(0, width - len(raw)), np.uint8)))


def edited(text: str, other: str) -> str:
    """The last half of the text, rounded down, replaced by as much of the start of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep_columns`` with fingerprint, without any shuffle."""
    ship(docs.sparkSession)
    base = docs.select(*keep_columns, whole(text).alias("print_text"))
    n = len(keep_columns)

    def run(batches):
        for batch in batches:
            at = 0
            texts = batch.column(n).to_pylist()
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size == 0 or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end]) + 1
                    end += 1
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([as_text(r) for r in samples(texts[at:end])], pa.string())], [*keep_columns, "fingerprint"])
                at = end

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n])
    return base.mapInArrow(run, f"{fields}, fingerprint string")


def bands(prints: DataFrame, skip: int = SKIP, width: int = WIDTH, fingerprint: str = "fingerprint") -> DataFrame:
    """Bit-sampled banding: one row for each run of ``width`` samples, with its place, as ``band`` and ``band_key``.

    Texts of likeness s share a given band with a chance of about s to the power of ``width``. Bands begin
    ``skip`` samples in, past the first steps, which every text of one language begins alike; shorter
    fingerprints have all their samples as one band.
    """
    raw = F.unbase64(fingerprint)
    n = F.octet_length(raw)
    starts = F.when(n >= skip + width, F.sequence(F.lit(skip), n - width, F.lit(width))).otherwise(F.array(F.lit(0)))
    size = F.when(n >= skip + width, F.lit(width)).otherwise(n)
    made = prints.withColumn("band_set", F.transform(starts, lambda k: F.struct(k.alias("band"), F.xxhash64(k, F.substring(raw, k + 1, size)).alias("band_key"))))
    return made.select(*prints.columns, F.explode("band_set").alias("b")).select(*prints.columns, "b.band", "b.band_key")


def _scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) of fingerprints with their likeness s, the weight w of a's samples and the distance h: the weight of the places where a and b differ."""
    both = pairs.join(nodes.select(F.col("c").alias("a"), F.col("f").alias("fa")), "a").join(nodes.select(F.col("c").alias("b"), F.col("f").alias("fb")), "b")

    def run(batches):
        for batch in batches:
            fa, fb = ([from_text(x) for x in batch.column(i).to_pylist()] for i in (2, 3))
            width = max([len(x) for x in (*fa, *fb)], default=0)
            ra, rb = (np.array([np.pad(x, (0, width - len(x))) for x in f], np.uint8).reshape(len(f), width) for f in (fa, fb))
            w = WEIGHTS[:width]
            cols = [pa.array(x.astype(float)) for x in (likeness(ra, rb), (ra > 0) @ w, (ra != rb) @ w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["a", "b", "s", "w", "h"])

    return keep(both.select("a", "b", "fa", "fb").mapInArrow(run, "a binary, b binary, s double, w double, h double"))


def near_links(prints: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Links (key, other, likeness): any two fingerprints that share a band and reach the threshold are connected by them.

    Equal fingerprints are linked with the smallest key among them, which alone is compared with others (a null
    key stands after all; a link within one id has it twice). Each bucket is compared with its smallest key.
    What that leaves open, a member of another class, is compared with the bucket's members unless their
    weights or their distances from the smallest key, by the triangle inequality, keep them below the threshold.
    """
    ship(prints.sparkSession)
    rows = prints.select(F.col(key).alias("k"), F.col(fingerprint).alias("f")).withColumn("c", F.unhex(F.md5("f")))
    nodes = keep(rows.groupBy("c").agg(F.first("f").alias("f"), F.min(F.struct(F.col("k").isNull().alias("x"), "k"))["k"].alias("rep")))
    copies = rows.groupBy("c", "k").agg(F.count("*").alias("n")).join(nodes.select("c", "rep"), "c").filter("NOT k <=> rep OR n > 1")
    own = bands(nodes, fingerprint="f").select("c", "rep", "band", "band_key")
    first = own.groupBy("band", "band_key").agg(F.min(F.struct(F.col("rep").isNull().alias("x"), "rep", "c"))["c"].alias("p"))
    starred = keep(own.join(first, ["band", "band_key"]).filter("c != p").select("p", "c").distinct())
    scored = _scored(starred.select(F.col("c").alias("a"), F.col("p").alias("b")), nodes)
    links = scored.filter(F.col("s") >= threshold).select("a", "b", "s")

    classes = keep(components(links.select("a", "b")))
    root = nodes.select("c").join(classes, "c", "left").select("c", F.coalesce("root", "c").alias("root"))
    placed = scored.select(F.col("a").alias("c"), F.col("b").alias("p"), "w", "h").join(root, "c").join(root.select(F.col("c").alias("p"), F.col("root").alias("main")), "p")
    placed = keep(placed)
    left, right = (placed.select("p", *(F.col(n).alias(n + end) for n in ("c", "root", "main", "w", "h"))) for end in ("_a", "_b"))
    most = F.greatest("w_a", "w_b")
    apart = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main_b")) | (F.col("c_a") < F.col("c_b")))
    possible = (F.least("w_a", "w_b") >= (threshold - 1e-9) * most) & (F.abs(F.col("h_a") - F.col("h_b")) <= (1 - threshold + 1e-9) * most)
    rest = left.filter("root_a != main_a").join(right, "p").filter(apart & possible).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()
    links = links.unionByName(_scored(rest, nodes).filter(F.col("s") >= threshold).select("a", "b", "s"))

    named = links.join(nodes.select(F.col("c").alias("a"), F.col("rep").alias("ka")), "a").join(nodes.select(F.col("c").alias("b"), F.col("rep").alias("kb")), "b")
    swap = F.col("ka").isNotNull() & (F.col("kb").isNull() | (F.col("ka") < F.col("kb")))
    named = named.select(F.when(swap, F.col("kb")).otherwise(F.col("ka")).alias(key), F.when(swap, F.col("ka")).otherwise(F.col("kb")).alias("other"), F.col("s").alias("likeness"))
    return named.unionByName(copies.select(F.col("k").alias(key), F.col("rep").alias("other"), F.lit(1.0).alias("likeness")))


def _place(cuts: list, rank, shape: str):
    """The number of cuts (in order) below rank, a struct of that shape, looked up in two steps."""
    cells = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    value = lambda c: F.struct(*map(F.lit, c)).cast(shape)
    below = lambda held: F.size(F.filter(held, lambda x: x < rank))
    if not cells:
        return F.lit(0)
    cell = F.greatest(below(F.array(*(value(c[0]) for c in cells))) - 1, F.lit(0))
    return cell * 64 + below(F.get(F.array(*(F.array(*map(value, c)) for c in cells)), cell))


def deal_keys(spark, parts: int) -> list[int]:
    """For each of so many partitions a number that Spark's hash deals to it, so that no two ranges meet in one task."""
    rows = spark.range(0, 16 * parts + 64, 1, 1).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"), F.col("id").alias("k"))
    found = {r["p"]: r["k"] for r in rows.groupBy("p").agg(F.min("k").alias("k")).collect()}
    return [found.get(p, p) for p in range(parts)]


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Rows (part, tail, k, t) dealt and sorted so that each row's next one in descending key follows it.

    The rows are cut into ranges of about the same number of characters by a sample of their ranks (id, then a
    hash of the text, so that rows of one id can be cut too); one extra row (tail = 1) at the end of each range
    repeats the first row of the range after it, and the last range is followed by the first.
    """
    base = docs.select(F.col(key).alias("k"), whole(text).alias("t"))
    kind = base.schema["k"].dataType
    h = F.xxhash64("t")
    known = F.struct(F.col("k").isNotNull().alias("x"), F.col("k").alias("k"), h.alias("h"))
    many = base.count()
    parts = max(1, min(MOST_PARTS, -(-many // part_rows)))
    asked = max(20 * parts, 10_000)
    few = base if many <= asked else base.sample(asked / many, 11)
    # A bounded sample of ranks; it decides only where ranges end.
    rows = few.select(F.col("k").isNotNull().alias("x"), "k", h.alias("h"), F.length("t").alias("n")).orderBy("x", "k", "h").collect() if parts > 1 else []
    total, seen, cuts = sum(r["n"] + 100 for r in rows), 0, []
    for r in rows:
        seen += r["n"] + 100
        if seen * parts >= total * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append((r["x"], r["k"], r["h"]))
    cuts = sorted(set(cuts), key=lambda c: (c[0], c[1] if c[0] else 0, c[2]))
    shape = f"struct<x:boolean,k:{kind.simpleString()},h:bigint>"
    typed = known.cast(shape)
    place = _place(cuts, typed, shape)
    if not cuts and many == 0:
        return base.select(F.lit(0).alias("part"), F.lit(0).alias("tail"), "k", "t")
    base = base.withColumn("rank", typed).withColumn("part", place)
    # One row for each range.
    heads = {r["part"]: r["rank"] for r in base.groupBy("part").agg(F.max("rank").alias("rank")).collect()}
    order = sorted(heads, reverse=True)
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    to = F.get(F.array(*(F.lit(before.get(p, -1)) for p in range(max(order) + 1))), F.col("part"))
    ranks = F.array(*((F.struct(*(F.lit(x) for x in heads[p])) if p in heads else F.struct(F.lit(None), F.lit(None), F.lit(None))).cast(shape) for p in range(max(order) + 1)))
    here = F.struct(F.col("part"), F.lit(0).alias("tail"))
    dealt = base.select(F.explode(F.when(F.col("rank").eqNullSafe(F.get(ranks, F.col("part"))), F.array(here, F.struct(to.alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(here))).alias("p"), "k", "t", "rank")
    deal = F.get(F.array(*map(F.lit, deal_keys(docs.sparkSession, max(order) + 1))), F.col("part")).cast("int").alias("deal")
    dealt = dealt.select("p.part", "p.tail", "k", "t", "rank").select("*", deal).repartition(max(order) + 1, "deal")
    return dealt.sortWithinPartitions("part", "tail", F.col("rank").desc()).select("part", "tail", "k", "t")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, part_rows: int = PART_ROWS) -> DataFrame:
    """For each row its fingerprint, that of its text edited with the next row's, both likenesses, and whether bands and likeness link them."""
    ship(docs.sparkSession)
    base = beside_next(docs, key, text, part_rows)
    kind = base.schema["k"].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "linked_edited", "linked_next"]

    def compare(keys: list, texts: list[str], kind) -> pa.RecordBatch:
        """texts: one more than keys, each row's next one after it."""
        n = len(keys)
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        s = samples([*texts, *changed])
        own, nxt, new = s[:n], s[1 : n + 1], s[n + 1 :]
        near = [likeness(own, other) for other in (new, nxt)]
        linked = [share_band(own, other) & (x >= threshold) for other, x in zip((new, nxt), near, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, kind),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([as_text(r) for r in own], pa.string()),
                pa.array([as_text(r) for r in new], pa.string()),
                *map(pa.array, (*near, *linked)),
            ],
            names,
        )

    def run(batches):
        keys: list = []
        texts: list[str] = []
        size, now, ended, kind = 0, None, False, None
        for batch in batches:
            kind = batch.column(2).type
            for p, tail, k, t in zip(*(batch.column(i) for i in range(4)), strict=True):
                p = p.as_py()
                if p != now:
                    keys, texts, size, now, ended = [], [], 0, p, False
                if ended:
                    continue
                text = t.as_py()
                texts.append(text)
                size += len(text) + 1
                ended = bool(tail.as_py())
                if ended or size >= CHUNK and len(texts) > 1:
                    yield compare(keys, texts, kind)
                    texts, size = texts[-1:], len(text) + 1
                    keys = []
                if not ended:
                    keys.append(k.as_py())

    return base.mapInArrow(run, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, linked_edited boolean, linked_next boolean")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
