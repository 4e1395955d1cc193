"""Operator 7: removal of repeated lines or paragraphs, and of repeated passages inside them.

Each unit (a line or a paragraph) is normalised (lower case, runs of white space as one space, trimmed) and
hashed to 128 bits. The digests of all documents are grouped; of each, the earliest occurrence, by document id
and then by place, is kept and the others are removed, with their spans in the original text.

A passage is often set into a line between other words; the line as a whole is then new everywhere. So the
sentences of each unit are hashed the same way, and a run of repeated sentences goes too if it has
``passage_words`` words or more together. Single sentences that come again by chance stay.

Only digests that occur more than once are joined with the occurrences again. They are reduced to one row each
and written first, so that the join is one that Spark splits: a line of a third of all documents needs no task
of its own.

Defined results: a null text counts as empty; a unit without words is always kept; rows are told apart by id
and text, so that rows of one id that differ lose only what repeats, and rows that repeat one another wholly
are one document and keep the same; rows of one id rank by a hash of their text, and a null id ranks last. A
unit all of whose sentences go is removed with its separator. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship, whole

#: What ends a unit.
ENDS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
#: A sentence ends with the unit, with a line, or with the space after its mark.
SENTENCE_ENDS = re.compile(r"\n|(?<=[.!?]) ")
#: Words of a run of repeated sentences that is removed from a unit that is new as a whole.
PASSAGE_WORDS = 20
#: Digests of one output batch.
BATCH_UNITS = 50_000


def _cut(ends: re.Pattern, text: str, begin: int, end: int) -> list[tuple[int, int]]:
    spans, at = [], begin
    for m in ends.finditer(text, begin, end):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, end))
    return spans


def units_of(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """Spans (begin, end) of the units, in code points, without what separates them."""
    return _cut(ENDS[unit], text, 0, len(text))


def sentences_of(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Spans of the sentences of one unit."""
    return _cut(SENTENCE_ENDS, text, begin, end)


def digest_of(part: str, kind: bytes = b"unit") -> bytes | None:
    """128 bits of a normalised unit or sentence; None where it has no words."""
    words = part.lower().split()
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16, person=kind).digest() if words else None


def digests_of(text: str, unit: str, passages: bool):
    """(begin, whether it is a sentence, digest) of all units and, where asked for, their sentences."""
    for a, b in units_of(text, unit):
        d = digest_of(text[a:b])
        if d is None:
            continue
        yield a, False, d
        if passages:
            for x, y in sentences_of(text, a, b):
                d = digest_of(text[x:y], b"sentence")
                if d is not None:
                    yield x, True, d


def without(text: str, units_gone: set[int], sentences_gone: set[int], unit: str = "line", passage_words: int | None = PASSAGE_WORDS) -> tuple[list[tuple[int, int]], str, int]:
    """Removed spans, the rest of the text, and its number of units, given where repeated units and sentences begin.

    What goes takes the separator before it along, or, at the start of its unit or of the text, the one after it.
    """
    units = units_of(text, unit)
    removed: list[tuple[int, int]] = []
    kept: list[str] = []
    for n, (a, b) in enumerate(units):
        part = text[a:b]
        if a in units_gone:
            removed.append((a, b))
            continue
        if passage_words is not None and sentences_gone:
            own = sentences_of(text, a, b)
            gone = _runs(text, own, sentences_gone, passage_words)
            if gone:
                removed += [(own[i][0], own[j][1]) for i, j in gone]
                left = [i for i in range(len(own)) if not any(x <= i <= y for x, y in gone)]
                if not left:
                    continue
                part = "".join((text[own[i - 1][1] : own[i][0]] if k else "") + text[own[i][0] : own[i][1]] for k, i in enumerate(left))
        kept.append((text[units[n - 1][1] : a] if kept else "") + part)
    return removed, "".join(kept), len(units)


def _runs(text: str, spans: list[tuple[int, int]], gone: set[int], words: int) -> list[tuple[int, int]]:
    """First and last of each longest run of repeated sentences that has so many words together."""
    out, first, total = [], None, 0
    for i, (a, b) in enumerate([*spans, (-1, -1)]):
        if a in gone:
            first = i if first is None else first
            total += len(text[a:b].split())
        else:
            if first is not None and total >= words:
                out.append((first, i - 1))
            first, total = None, 0
    return out


def _base(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, r, t): r tells rows of one id apart."""
    return docs.select(F.col(key).alias("k"), whole(text).alias("t")).select("k", F.xxhash64("t").alias("r"), "t")


def repeated_parts(base: DataFrame, unit: str = "line", passages: bool = True) -> DataFrame:
    """base (k, r, t) as (k, r, begin, sentence) of each unit and sentence that occurred earlier."""
    ship(base.sparkSession)
    kind = base.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            owner: list[int] = []
            begins: list[int] = []
            kinds: list[bool] = []
            digests: list[bytes] = []
            for row, t in enumerate(batch.column(2)):
                for a, sentence, d in digests_of(t.as_py(), unit, passages):
                    owner.append(row)
                    begins.append(a)
                    kinds.append(sentence)
                    digests.append(d)
                if len(digests) >= BATCH_UNITS or row == batch.num_rows - 1 and digests:
                    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    at = pa.array(owner)
                    cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(begins, pa.int32()), pa.array(kinds), *(pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1))]
                    yield pa.RecordBatch.from_arrays(cols, ["k", "r", "begin", "sentence", "d1", "d2"])
                    owner, begins, kinds, digests = [], [], [], []

    # Hashed twice rather than kept: a table of all digests would be as large as the texts.
    parts = base.mapInArrow(run, f"k {kind}, r bigint, begin int, sentence boolean, d1 bigint, d2 bigint")
    rank = F.struct(F.col("k").isNull().alias("unknown"), F.col("k").alias("k"), F.col("r").alias("r"), F.col("begin").alias("begin"))
    firsts = keep(parts.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("d1", "d2", F.col("first.k").alias("fk"), F.col("first.r").alias("fr"), F.col("first.begin").alias("fb")))
    first = F.col("k").eqNullSafe(F.col("fk")) & (F.col("r") == F.col("fr")) & (F.col("begin") == F.col("fb"))
    return parts.join(firsts, ["d1", "d2"]).filter(~first).select("k", "r", "begin", "sentence")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """One row for each document: key, n_units, removed (spans in order) and kept_text. ``passage_words`` None: units only."""
    ship(docs.sparkSession)
    base = _base(docs, key, text)
    found = repeated_parts(base, unit, passage_words is not None)
    gone = found.groupBy("k", "r").agg(*(F.collect_set(F.when(F.col("sentence") == s, F.col("begin"))).alias(n) for s, n in ((False, "units_gone"), (True, "sentences_gone"))))
    gone = gone.withColumnsRenamed({"k": "gk", "r": "gr"})
    both = base.join(gone, F.col("k").eqNullSafe(F.col("gk")) & (F.col("r") == F.col("gr")), "left").select("k", "t", "units_gone", "sentences_gone")
    kind = both.schema["k"].dataType.simpleString()
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                many, kept, spans = [], [], []
                for t, units, sentences in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    removed, rest, n = without(t, set(units or ()), set(sentences or ()), unit, passage_words)
                    many.append(n)
                    spans.append([{"begin": a, "end": b} for a, b in removed])
                    kept.append(rest)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(many, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], [key, "n_units", "removed", "kept_text"])

    return both.mapInArrow(run, f"`{key}` {kind}, n_units bigint, removed array<struct<begin:bigint,end:bigint>>, kept_text string")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), listed.alias("removed_spans"), "kept_text")
