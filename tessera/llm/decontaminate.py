"""Operator 8: benchmark decontamination by SimHash windows. DataFrame functions only.

A document is contaminated by a benchmark item if one of its windows of the item's number of words has a
weighted Jaccard similarity of 0.8 or more with the item, over shingles of five words.

1. Windows. A window of similarity t holds a weight of t times the item's of the item's shingles at least. So
   it holds one of the item's rarest shingles that weigh more than 1 - t of it together; these are looked up in
   the documents. In the documents with a find, all windows are slid over the item's shingles by sums of what
   enters and leaves, and those that hold enough are the item's windows. None that reaches the threshold is
   left out. Equal windows, such as a passage that many documents share, are one window from here on.
2. SimHash. Windows and items get a fingerprint of 64 bits from their weighted shingles.
3. Multi-index. Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS bits agree in one block at
   least, so that joining on (item, block, value) finds all pairs within the radius among an item and its
   windows. At the threshold the distance is about 9.7 bits, with a deviation of 2.9: the radius leaves out
   1 pair in 10,000.
4. Verification by the exact weighted similarity.

All steps grow with the finds, never with documents times items.

A shingle's weight is 1 + ln(items / items that hold it), and that of an unknown shingle 1 + ln(items).

Defined results: a null text counts as empty and is never contaminated, nor does an item without words
contaminate; a text or item of fewer than five words is one shingle, and such an item is looked up in the runs
of as many words of the texts of five words or more (a shorter text must equal it); a document shorter than an
item is compared whole; rows with one id are separate documents; items with one id are one (any of their texts
counts); ids are of any type that can be ordered, and items without an id are one that contaminates but isn't
listed; of equally similar items the smallest is the best. Texts are searched whole. Other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, whole

WIDTH = 5
RADIUS = 20
#: Rows that are broadcast at most: shingles of items, and ids of documents with a find (about 50 bytes each). Beyond it the join is shuffled, with the same result.
BROADCAST_ROWS = 500_000


#: What rounding may take from a similarity that is the threshold.
EQUAL = 1e-9


def short_runs(text: str, n: int) -> Column:
    """The hashes of the runs of n < WIDTH words, each as shingled() gives it for a text of these words; none for a text of fewer than WIDTH words."""
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[\s\p{Punct}]+", -1), "")
    runs = F.transform(
        F.array(F.transform(words, lambda w: F.xxhash64(w))),
        lambda h: F.when(F.size(h) >= WIDTH, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(h, i + k).cast("string") for k in range(n)))))).otherwise(F.array().cast("array<bigint>")),
    )
    return F.get(runs, 0)


def shingled(text: str | Column) -> Column:
    """The hashes of the shingles of a text, in order; one for a text of fewer than WIDTH words, none for one without words."""
    words = F.array_remove(F.split(F.lower(text if isinstance(text, Column) else F.col(text)), r"[\s\p{Punct}]+", -1), "")
    # The words' hashes are bound to a lambda variable, so that they are computed once for each text.
    grams = F.transform(
        F.array(F.transform(words, lambda w: F.xxhash64(w))),
        lambda h: F.when(F.size(h) >= WIDTH, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WIDTH, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WIDTH)))))
        .when(F.size(h) > 0, F.array(F.xxhash64(F.concat_ws(" ", F.transform(h, lambda x: x.cast("string"))))))
        .otherwise(F.array().cast("array<bigint>")),
    )
    return F.get(grams, 0)


def _n_words(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.lower(F.col(text)), r"[\s\p{Punct}]+", -1), ""))


def simhash(weighted: str) -> Column:
    """64 bits from an array of (g, w): a bit is set where the weights of the shingles that have it outweigh the others."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | CASE WHEN aggregate({weighted}, 0D, (s, x) -> s + CASE WHEN (shiftright(x.g, b) & 1L) = 1L THEN x.w ELSE -x.w END) > 0 "
        "THEN shiftleft(1L, b) ELSE 0L END)"
    )


def blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """(block, value) of RADIUS + 1 blocks that cover the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def item_texts(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, float]:
    """items (item, t) as (tid, item, n), their weighted shingles (tid, n, g, tf, weight, total, rare), and the weight of an unknown shingle.

    tid is a digest of the text. ``rare`` marks the rarest shingles, of which every text that holds a weight of
    threshold * total of the item's shingles has one.
    """
    tokens = items.select("item", F.md5("t").alias("tid"), _n_words("t").alias("n"), shingled("t").alias("grams")).filter("n > 0")
    tokens = keep(tokens.select("item", "tid", "n", F.explode("grams").alias("g")))
    named = F.struct(F.col("item").isNull().alias("x"), "item")
    n_items = float(max(1, tokens.select(named.alias("i")).distinct().count()))
    weights = tokens.groupBy("g").agg((F.lit(1.0) + F.log(F.lit(n_items) / F.countDistinct(named))).alias("weight"))
    texts = keep(tokens.select("tid", "item", "n").distinct())
    # Each text once, whatever the number of items that have it.
    many = tokens.groupBy("tid", "n", "g", named.alias("i")).agg(F.count("*").alias("tf")).groupBy("tid", "n", "g").agg(F.min("tf").alias("tf")).join(weights, "g")
    own = Window.partitionBy("tid")
    held = F.col("tf") * F.col("weight")
    before = F.sum(held).over(own.orderBy(F.desc("weight"), "g").rowsBetween(Window.unboundedPreceding, 0)) - held
    many = many.withColumn("total", F.sum(held).over(own)).withColumn("rare", before <= (1 - threshold + 1e-9) * F.col("total"))
    return texts, keep(many), 1 + math.log(n_items)


def windows_of(docs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """docs (k, c, t) as (k, c, tid, n, start, own): the windows that hold a weight of threshold * total of an item's shingles."""
    small = shingles.count() <= BROADCAST_ROWS
    sized = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    grams = docs.select("k", "c", shingled("t").alias("grams"))
    found = grams.select("k", "c", F.explode("grams").alias("g")).join(sized(shingles.filter("rare").select("g", "tid")), "g")
    found = keep(found.groupBy("k", "c").agg(F.collect_set("tid").alias("tids")).withColumnsRenamed({"k": "fk", "c": "fc"}))
    # Only the texts of documents with a find are needed again.
    same = F.col("k").eqNullSafe(F.col("fk")) & (F.col("c") == F.col("fc"))
    names = found.select("fk", "fc")
    if found.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    touched = docs.join(names, same, "left_semi").dropDuplicates(["k", "c"]).join(found, same)
    touched = keep(touched.select("k", "c", "tids", shingled("t").alias("grams")))
    size = F.greatest(F.col("n") - (WIDTH - 1), F.lit(1))
    last = F.greatest(F.lit(0), F.col("many") - F.col("size"))
    hits = touched.select("k", "c", "tids", F.size("grams").alias("many"), F.posexplode("grams").alias("pos", "g"))
    hits = hits.join(sized(shingles.select("g", "tid", "n", "weight", "total")), "g").filter(F.array_contains("tids", F.col("tid"))).withColumn("size", size)
    # A find counts for the windows that begin in (pos - size, pos]: it enters at the first and leaves after the last.
    steps = F.explode(F.array(F.struct((F.col("pos") - F.col("size") + 1).alias("at"), F.col("weight").alias("w")), F.struct((F.col("pos") + 1).alias("at"), (-F.col("weight")).alias("w")))).alias("e")
    by = ["k", "c", "tid", "n", "size", "many", "total"]
    summed = hits.select(*by, steps).groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.w").alias("w"))
    own = Window.partitionBy("k", "c", "tid").orderBy("at")
    held = summed.withColumn("held", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(own) - 1)
    held = held.filter(F.col("held") >= (threshold - 1e-6) * F.col("total")).withColumns({"at": F.greatest("at", F.lit(0)), "to": F.least("to", last)}).filter("at <= to")
    starts = held.select("k", "c", "tid", "n", "size", F.explode(F.sequence("at", "to")).alias("start")).withColumnsRenamed({"k": "wk", "c": "wc"})
    same = F.col("k").eqNullSafe(F.col("wk")) & (F.col("c") == F.col("wc"))
    cut = touched.select("k", "c", "grams").join(starts, same)
    return cut.select("k", "c", "tid", "n", "start", F.slice("grams", F.col("start") + 1, F.col("size")).alias("own"))


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """docs (k, c, t), where c is a digest of t, and items (item, t): rows (k, c, item, start, n_words, s), the windows at the threshold or above."""
    texts, shingles, unknown = item_texts(items, threshold)
    cut = windows_of(docs, shingles, threshold)
    # Items of fewer than WIDTH words, a run each: what is found is the window.
    for n in sorted(r["n"] for r in texts.filter(F.col("n") < WIDTH).select("n").distinct().collect()):
        runs = docs.select("k", "c", F.posexplode(short_runs("t", n)).alias("start", "g"))
        runs = runs.join(shingles.filter(F.col("n") == n).select("tid", "n", "g"), "g").select("k", "c", "tid", "n", "start", F.array("g").alias("own"))
        cut = cut.unionByName(runs.distinct())
    cut = keep(cut.withColumn("wk", F.md5(F.concat_ws(",", F.col("own").cast("array<string>")))))
    distinct = cut.groupBy("wk").agg(F.first("own").alias("own"))
    weights = shingles.groupBy("g").agg(F.max("weight").alias("weight"))
    counted = distinct.select("wk", F.explode("own").alias("g")).groupBy("wk", "g").agg(F.count("*").alias("tf")).join(weights, "g", "left")
    weighed = lambda rows, by: rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("g", (F.col("tf") * F.col("weight")).alias("w")))).alias("gw"), F.sum(F.col("tf") * F.col("weight")).alias("total"))
    prints = keep(weighed(counted.withColumn("weight", F.coalesce("weight", F.lit(unknown))), "wk").withColumn("print", simhash("gw")))
    item_prints = keep(weighed(shingles, "tid").withColumn("print", simhash("gw")))

    # The index: rows are narrow, the shingles are joined to what it finds.
    cells = lambda name: F.explode(blocks(name, radius)).alias("b")
    left = cut.select("tid", "wk").distinct().join(prints.select("wk", "print"), "wk").select("tid", "wk", "print", cells("print")).select("tid", "wk", "print", "b.*")
    right = item_prints.select("tid", F.col("print").alias("iprint"), cells("print")).select("tid", "iprint", "b.*")
    near = left.join(right, ["tid", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("iprint"))) <= radius).select("tid", "wk").distinct()
    both = near.join(prints.select("wk", "gw", "total"), "wk").join(item_prints.select("tid", F.col("gw").alias("igw"), F.col("total").alias("itotal")), "tid")
    shared = F.aggregate("gw", F.lit(0.0), lambda s, x: s + F.least(x["w"], F.coalesce(F.element_at(F.map_from_entries("igw"), x["g"]), F.lit(0.0))))
    scored = both.select("tid", "wk", (shared / (F.col("total") + F.col("itotal") - shared)).alias("s")).filter(F.col("s") >= threshold - EQUAL)
    found = cut.select("k", "c", "tid", "n", "start", "wk").join(keep(scored), ["tid", "wk"])
    return found.join(texts.select("tid", "item"), "tid").select("k", "c", "item", "start", F.col("n").alias("n_words"), "s")


def base_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("k"), whole(text).alias("t")).withColumn("c", F.md5("t"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each document: key, contaminated, items (sorted ids), best_item and best_similarity."""
    base = base_of(docs, key, text)
    found = contaminations(base, benchmark.select(F.col(item).alias("item"), whole(item_text).alias("t")), threshold)
    best = F.min(F.struct((-F.col("s")).alias("m"), F.col("item").isNull().alias("x"), "item"))
    per = found.groupBy(F.col("k").alias("pk"), F.col("c").alias("pc")).agg(F.sort_array(F.collect_set("item")).alias("items"), best.alias("best"))
    both = base.select("k", "c").join(per, F.col("k").eqNullSafe(F.col("pk")) & (F.col("c") == F.col("pc")), "left")
    kind = per.schema["items"].dataType.simpleString()
    return both.select(F.col("k").alias(key), F.col("pc").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(kind)).alias("items"), F.col("best.item").alias("best_item"), (-F.col("best.m")).alias("best_similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that no item contaminates."""
    found = contaminations(base_of(docs, key, text), benchmark.select(F.col(item).alias("item"), whole(item_text).alias("t")), threshold)
    found = found.select(F.col("k").alias("leak_k"), F.col("c").alias("leak_c")).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col("leak_k")) & (F.md5(whole(text)) == F.col("leak_c")), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.col("contaminated").cast("int").alias("contaminated"), F.concat_ws(",", F.col("items").cast("array<string>")).alias("item_ids"), "best_item", F.round("best_similarity", 6).alias("best_similarity"))
