"""Operator 1: a counterfactually regularised toxicity classifier.

A text is the set of its words and of their leading parts (``PREFIXES`` characters), so that unseen
inflections of a known insult still count. The features that separate the classes are chosen from counts
over the labelled rows; a logistic regression is then fitted with three terms besides the usual penalty:

* both classes weigh the same together, so that a score of 0.5 stands for even odds at even shares;
* each labelled row joins the loss a second time with its identity terms swapped (or, where it names no
  group, with a neutral mention put in) under its own label, so that every term is seen under both labels;
* for each labelled sentence that names a group, and each other term of that group, the squared change of
  the score by the swap is penalised; of rows that name no group, that of the neutral mention.

So naming a group, or one group rather than another, doesn't raise the score.

Defined results: null and empty texts have no features and get the score of the intercept; labelled rows
whose label is null, or without a document, aren't learned from; several labels of one document count as
several rows; without labels of both classes every score is next to 0. Other columns aren't read. The model
doesn't depend on the order or the partitions of the rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship, whole

#: Leading parts of a word that are features besides the word itself.
PREFIXES = (4, 5, 6, 7)
#: Groups of terms that may replace one another.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "natives", "refugees", "locals"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
)
_GROUP = {term: group for group in IDENTITY for term in group}
_WORDS = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_KNOWN = 1 << 16  # words that a worker remembers


def features_of(word: str) -> tuple[str, ...]:
    return ("=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k))


def words_of(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def swapped(words: set[str], turn: int) -> set[str]:
    """The words with each identity term replaced by another of its group; a neutral mention is added where there is none."""
    named = words & _GROUP.keys()
    if not named:
        group = IDENTITY[turn % len(IDENTITY)]
        return words | {group[turn // len(IDENTITY) % len(group)]}
    return (words - named) | {_GROUP[t][(_GROUP[t].index(t) + 1 + turn % (len(_GROUP[t]) - 1)) % len(_GROUP[t])] for t in named}


def swaps(text: str, turn: int):
    """(words, words after the swap) of each counterfactual pair: all swaps of one term in all sentences that name a group, else one neutral mention."""
    any_named = False
    if any(t in text.lower() for t in _GROUP):
        for sentence in _SENTENCE.findall(text):
            words = words_of(sentence)
            for term in sorted(words & _GROUP.keys()):
                any_named = True
                for other in _GROUP[term]:
                    if other not in words:
                        yield words, words - {term} | {other}
    if not any_named:
        yield set(), swapped(set(), turn)


class Model:
    """Weights by feature, and the intercept."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str) -> float:
        found: set[str] = set()
        known = self._known
        for word in set(_WORDS.findall(text.lower())):
            own = known.get(word)
            if own is None:
                if len(known) >= _KNOWN:
                    known.clear()
                own = known[word] = tuple(f for f in features_of(word) if f in self.weights)
            if own:
                found.update(own)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _counts(batches):
    """For each feature, the labelled rows of either class that have it."""
    pos: Counter = Counter()
    neg: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (pos if label else neg).update({f for w in words_of(text) for f in features_of(w)})
            if len(pos) + len(neg) > 200_000:
                yield _count_rows(pos, neg)
                pos, neg = Counter(), Counter()
    yield _count_rows(pos, neg)


def _count_rows(pos: Counter, neg: Counter) -> pa.RecordBatch:
    names = list(pos.keys() | neg.keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[n] for n in names], pa.int64()), pa.array([neg[n] for n in names], pa.int64())], ["feature", "pos", "neg"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 4096, min_gain: float = 8.0, ridge: float = 2e-6, fairness: float = 1.0, steps: int = 400) -> Model:
    """Fit on docs (id, text) and labels (id, label).

    ``max_rows``: the documented bound of the labelled rows that are learned from, those of the smallest
    hashes of their ids; so bounded, they are broadcast and the documents aren't shuffled.
    ``min_gain``: a feature's least gain in log-likelihood over knowing no feature, which keeps chance out of
    small samples. ``fairness``: weight of the penalty on counterfactual pairs.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col("label").isNotNull()).select("id", F.col("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    turn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int").alias("turn")
    sample = keep(docs.select("id", whole("text").alias("text")).join(F.broadcast(known), "id").select("text", "label", turn))
    many = max(1, spark.sparkContext.defaultParallelism)
    sample = sample.repartition(many)
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sum(n for k, n in total.items() if k), total.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, -1000.0)
    p, q = (F.col("pos") + 0.5) / (n_pos + 1), (F.col("neg") + 0.5) / (n_neg + 1)
    both = (F.col("pos") + F.col("neg") + 1.0) / (n_pos + n_neg + 2)
    gain = F.col("pos") * F.log(p / both) + F.col("neg") * F.log(q / both)
    chosen = (
        sample.mapInArrow(_counts, "feature string, pos bigint, neg bigint")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(gain >= min_gain)
        .orderBy(gain.desc(), "feature")
        .limit(max_features)
    )
    names = sorted({r["feature"] for r in chosen.collect()} | {"=" + t for t in _GROUP})
    place = {f: k for k, f in enumerate(names)}

    def listed(words: set[str]) -> list[int]:
        return sorted({place[f] for w in words for f in features_of(w) if f in place})

    def vectors(batches):
        """Feature lists of rows as they are and swapped (kind 0), and changes of features by a swap (kind 1)."""
        for batch in batches:
            rows = []
            for text, label, turn in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                rows += [(0, label, listed(words), []), (0, label, listed(swapped(words, turn)), [])]
                for a, b in swaps(text, turn):
                    old, new = listed(a), listed(b)
                    rows.append((1, 0, sorted(set(new) - set(old)), sorted(set(old) - set(new))))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "label", "more", "less"])

    # Two lists for each of at most max_rows rows, of at most max_features numbers and few in practice; pairs are few distinct ones.
    found = sample.mapInArrow(vectors, "kind int, label int, more array<int>, less array<int>")
    got = found.groupBy("kind", "label", "more", "less").agg(F.count("*").alias("n")).orderBy("kind", "label", "more", "less").collect()
    rows = [(r["more"], r["label"], r["n"]) for r in got if not r["kind"]]
    pairs = [(r["more"], r["less"], r["n"]) for r in got if r["kind"]]
    return train(rows, pairs, names, ridge, fairness, steps)


def train(rows, pairs, names, ridge: float, fairness: float, steps: int) -> Model:
    """Full-batch Adam on the mean logistic loss, both classes weighing the same, + fairness * mean (score change of a pair)^2 + ridge * |w|^2.

    rows: (features, label, how many); pairs: (features that a swap adds, features that it takes away, how many).
    """
    y = np.array([1.0 if v else 0.0 for _, v, _ in rows])
    share = np.array([n for _, _, n in rows], float)
    for v in (0.0, 1.0):
        share[y == v] /= 2 * share[y == v].sum()
    idx = np.array([k for f, _, _ in rows for k in f], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    pidx = np.array([k for more, less, _ in pairs for k in (*more, *less)], np.int64)
    psign = np.array([s for more, less, _ in pairs for s in (1.0,) * len(more) + (-1.0,) * len(less)])
    prow = np.repeat(np.arange(len(pairs)), [len(more) + len(less) for more, less, _ in pairs])
    pshare = np.array([n for _, _, n in pairs], float)
    pshare /= max(1.0, pshare.sum())
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[idx], minlength=len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * share
        grad = np.bincount(idx, err[row], minlength=len(names))
        if len(pidx) and fairness:
            change = np.bincount(prow, psign * w[pidx], minlength=len(pairs)) * pshare
            grad = grad + 2 * fairness * np.bincount(pidx, psign * change[prow], minlength=len(names))
        g = np.append(grad + 2 * ridge * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-6}, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep_columns`` with toxicity, the score of the whole text."""
    ship(docs.sparkSession)
    base = docs.select(*keep_columns, whole(text).alias("toxicity_text"))
    n = len(keep_columns)

    def run(batches):
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], [*keep_columns, "toxicity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n])
    return base.mapInArrow(run, f"{fields}, toxicity double")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_on_labels(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Learn ``labels.toxic`` from the labelled rows that aren't held out."""
    known = labels.filter(~held_out()).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return fit(docs.select(F.col("doc_id").alias("id"), "text"), known, **options)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
