"""Vector operators: exact top-k, restricted top-k, quantised top-k and an inverted-file index."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")
#: Cells of an index that are searched first; all others follow whose bound can hold a better neighbour.
PROBES = 8
#: Vectors that the cells' centres are fitted on at most.
TRAIN_ROWS = 100_000


def query_vector(query, dimensions: int | None = None, metric: str = "cosine") -> list[float]:
    """The query as floats; ValueError if it is empty, of another dimension, or zero under the cosine."""
    out = [float(x) for x in query]
    if not out:
        raise ValueError("a vector must not be empty")
    if dimensions is not None and len(out) != dimensions:
        raise ValueError(f"the query has {len(out)} dimensions, the vectors have {dimensions}")
    if metric not in METRICS:
        raise ValueError(f"unsupported metric {metric!r}")
    if metric == "cosine" and not any(out):
        raise ValueError("the cosine of a zero vector is not defined")
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score(embedding: Column, query: list[float], metric: str) -> Column:
    """cosine (0 for a zero row), inner product, or the negative squared distance; all in doubles."""
    e = embedding.cast("array<double>")
    q = F.array(*(F.lit(x) for x in query))
    if metric == "dot":
        return _dot(e, q)
    if metric == "l2":
        return F.lit(0.0) - F.aggregate(F.zip_with(e, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    norm = math.sqrt(sum(x * x for x in query))
    own = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(own > 0, _dot(e, q) / (own * norm)).otherwise(0.0)


def top_k(vectors: DataFrame, query, k: int, metric: str = "cosine", keys: tuple[str, ...] = ("target", "namespace", "target_id"), embedding: str = "embedding", dimensions: int | None = None) -> DataFrame:
    """The keys and score of the k best vectors, best first; ties are ordered by key.

    Each task keeps k rows only (TakeOrderedAndProject), so that nothing but these is moved.
    """
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("top_k must be an integer of 1 at least")
    q = query_vector(query, dimensions, metric)
    scored = vectors.select(*keys, score(F.col(embedding), q, metric).alias("score"))
    return scored.orderBy(F.col("score").desc(), *keys).limit(k)


def merge_best(parts: list[DataFrame], keys: tuple[str, ...], k: int) -> DataFrame:
    """The best score of each key over several results, then the k best."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(*keys).agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), *keys).limit(k)


def quantised(vectors: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, list[float]]:
    """int8 codes with one symmetric scale for each dimension (largest absolute value / 127), and the scales."""
    rows = vectors.select(F.posexplode(embedding).alias("dim", "x")).groupBy("dim").agg(F.max(F.abs("x").cast("double")).alias("m")).orderBy("dim").collect()
    scales = [(r["m"] / 127.0) or 1.0 for r in rows]
    s = F.array(*(F.lit(x) for x in scales))
    codes = F.zip_with(F.col(embedding).cast("array<double>"), s, lambda x, y: F.round(x / y).cast("tinyint"))
    return vectors.withColumn("code", codes).drop(embedding), scales


def top_k_quantised(vectors: DataFrame, query, k: int, metric: str = "cosine", keys: tuple[str, ...] = ("target", "namespace", "target_id"), embedding: str = "embedding") -> DataFrame:
    """Top-k over int8 codes, whose products are scaled back in the score."""
    codes, scales = quantised(vectors, embedding)
    s = F.array(*(F.lit(x) for x in scales))
    return top_k(codes.withColumn("approx", F.zip_with("code", s, lambda c, y: c.cast("double") * y)), query, k, metric, keys, "approx")


def normalised(embedding: Column) -> Column:
    e = embedding.cast("array<double>")
    n = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(e, lambda x: x / n)).otherwise(e)


def fit_cells(vectors: DataFrame, metric: str, many: int, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centres of k-means cells of ``many`` vectors, fitted on a bounded sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = cells or max(1, min(4096, round(math.sqrt(many))))
    own = normalised(F.col("embedding")) if metric == "cosine" else F.col("embedding").cast("array<double>")
    rows = vectors.select(own.alias("e"))
    if many > TRAIN_ROWS:
        rows = rows.sample(TRAIN_ROWS / many, seed)
    rows = rows.select(array_to_vector("e").alias("features"))
    return np.array([[float(x) for x in c] for c in KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters()])


def with_cells(vectors: DataFrame, centres: np.ndarray, metric: str, embedding: str = "embedding") -> DataFrame:
    """vectors with their cell, that of the nearest centre, and how far it is, by one matrix product for each batch.

    The centres go with the tasks: fit_cells bounds their number.
    """
    names = vectors.columns
    at = names.index(embedding)
    halves = (centres**2).sum(1) / 2

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            e = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            if metric == "cosine":
                norm = np.sqrt((e**2).sum(1, keepdims=True))
                e = np.where(norm > 0, e / np.where(norm > 0, norm, 1.0), e)
            cell = np.concatenate([np.argmin(halves - part @ centres.T, axis=1) for part in np.array_split(e, max(1, len(e) // 512))])
            far = np.sqrt(((e - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*names, "cell", "far"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{fields}, cell int, far double")


def probed_cells(query: list[float], centres: np.ndarray, metric: str, probes: int = PROBES) -> list[int]:
    """The cells nearest to the query; under the inner product those of the largest products."""
    q = np.array(query, float)
    if metric == "cosine":
        q = q / (np.linalg.norm(q) or 1.0)
    key = -(centres @ q) if metric == "dot" else ((centres - q) ** 2).sum(1)
    return [int(i) for i in np.argsort(key, kind="stable")[:probes]]


def cell_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, metric: str) -> np.ndarray:
    """For each query and cell a score that no vector of the cell is above."""
    c, r = centres.reshape(len(centres), queries.shape[1]), radii
    norm = np.linalg.norm(queries, axis=1, keepdims=True)
    if metric == "dot":
        bound = queries @ c.T + norm * r
    else:
        q = queries / norm if metric == "cosine" else queries
        least = np.maximum(0.0, np.stack([np.linalg.norm(c - x, axis=1) for x in q]) - r)
        bound = 1.0 - least**2 / 2 if metric == "cosine" else -(least**2)
    return bound + 1e-9 * (1.0 + np.abs(bound))  # rounding


def best_of_cells(celled: DataFrame, queries: np.ndarray, wanted: np.ndarray | None, floor: np.ndarray, k: int, metric: str, keys: tuple[str, ...]) -> DataFrame:
    """(nth, keys, score): from each batch of rows the k best of each query, among the cells wanted (queries x cells) for it, at its floor or above."""

    def run(batches):
        norm = np.sqrt((queries**2).sum(1))
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by([(n, "ascending") for n in keys])
            e = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            s = e @ queries.T
            own = (e**2).sum(1)
            if metric == "cosine":
                s = np.where(own[:, None] > 0, s / (np.sqrt(np.where(own > 0, own, 1.0))[:, None] * norm), 0.0)
            elif metric == "l2":
                s = -np.maximum(0.0, own[:, None] + norm**2 - 2 * s)
            s = np.where(s >= floor, s, -np.inf)
            if wanted is not None:
                s[~wanted[:, batch.column(len(keys) + 1).to_numpy()].T] = -np.inf
            best = np.argsort(-s, axis=0, kind="stable")[:k]
            nth = np.broadcast_to(np.arange(len(queries)), best.shape)
            score = np.take_along_axis(s, best, 0)
            held = score > -np.inf
            rows = batch.take(pa.array(best[held]))
            yield pa.RecordBatch.from_arrays([pa.array(nth[held].astype(np.int32)), *(rows.column(i) for i in range(len(keys))), pa.array(score[held])], ["nth", *keys, "score"])

    fields = ", ".join(f"`{n}` {celled.schema[n].dataType.simpleString()}" for n in keys)
    return celled.select(*keys, "embedding", *(["cell"] if wanted is not None else [])).mapInArrow(run, f"nth int, {fields}, score double")


def encode_blob(vector) -> bytes:
    """A vector as little-endian 32-bit floats, for exchange with stores that hold blobs."""
    out = [float(x) for x in vector]
    if not out:
        raise ValueError("a vector must not be empty")
    return struct.pack(f"<{len(out)}f", *out)


def decode_blob(blob: bytes) -> list[float]:
    if not blob or len(blob) % 4:
        raise ValueError("a vector blob has a positive multiple of 4 bytes")
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))
