"""Helpers that the operators share: code shipping, the shared folder and NumPy text hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of an Arrow batch that a Python worker gets, where the session has no setting of its own: documents are long.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: What Python workers start with, so that memory of large arrays goes back to the system once they are freed. Settings of the session's own stay.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from the repository, and get batches of bounded size.

    The size of batches is a setting of the session: one that still has Spark's default of 10000 rows gets BATCH_ROWS
    for its later queries too, because plans are lazy and run after this returns. Any other value is left alone.
    """
    if spark.conf.get(_ROWS_SETTING) == "10000":
        spark.conf.set(_ROWS_SETTING, BATCH_ROWS)
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    made = context._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(Path(tempfile.mkdtemp(prefix="tessera-")).as_uri())
        made = context._jsc.sc().getCheckpointDir()
    return made.get()


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again. It survives lost executors.

    The tables of an application are in one folder, which ``drop_kept`` removes.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Remove all tables that this application kept. Call it once its results are written: plans that read them end there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole(text) -> F.Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


# --- hashing words and shingles of many texts at once -------------------------------------------------

_M = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, m in enumerate((_M, _INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95]] = True
_WORD[128:] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text.

    A word is a run of letters, digits, underscores and non-ASCII characters, in lower case.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    in_word = _WORD[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], in_word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(r) + 1 for r in raw])
    n = np.diff(np.searchsorted(starts, np.concatenate(([0], bounds))))
    return h, n


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words and their number for each text; a shorter text is one shingle, an empty one none."""
    h, n = word_hashes(texts)
    total = len(h)
    start = np.concatenate(([0], np.cumsum(n)))
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    if not total:
        return h, count
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.concatenate(([0], np.cumsum(count)))
    pos = start[doc] + (np.arange(len(doc)) - first[doc])
    left = start[doc + 1] - pos
    out = np.zeros(len(doc), np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(left > k, padded[pos + k], np.uint64(0)) + np.uint64(k + 1)
    return mix(out), count
