"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents``. Between stages the table is written as Parquet in the shared folder and read again.

Defined results: extra columns of the input are left out; null texts count as empty; all empty texts are one
near-duplicate class, of which one stays; n_chars is counted again where a secret was replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_dups, secret_scan, sentencepieces, toxicity
from tessera.llm.common import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of this score or more are rejected.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of those at hand, does not reject."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep_columns=COLUMNS).filter(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dups.one_of_each(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    clean = secret_scan.redact_documents(docs.select(*COLUMNS).withColumn("pipeline_old", F.col("text")))
    same = F.col("text").eqNullSafe(F.col("pipeline_old"))
    return clean.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document with their spans of UTF-8 bytes, and a digest of the text that they decode to."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = sentencepieces.encode(docs.select(*COLUMNS), model, keep=("doc_id", "lang", "source"), decoded=True)
    return found.select("doc_id", "lang", "source", F.size("sp_ids").cast("long").alias("n_tokens"), F.col("sp_ids").alias("ids"), F.col("sp_begins").alias("begins"), F.col("sp_ends").alias("ends"), F.sha2("sp_decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", tokenise),
]
#: No stage but the secrets' could be stated in SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
