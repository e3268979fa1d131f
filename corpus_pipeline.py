"""From raw documents to token ids in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last returns the ids.

Null, empty and blank texts get no quality and go in the first stage; so none
gets further. Of rows with one id and text one stays, and of texts that are
equal or nearly so the one with the smallest id; a null id stays if nothing
else of its group does. Very long texts are read whole throughout. An empty
table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm import byte_bpe, decontamination, minhash, pii, quality
from netweft.plans.scratch import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by shingles of five words and a similarity of 0.8, the smallest doc_id stays."""
    return minhash.one_of_each(docs, words=5, percent=80)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars counts what is there then."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): little-endian unsigned 32-bit ids, and the digest of what they decode to."""
    return byte_bpe.decode(byte_bpe.encode(docs)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", good_documents),
    ("near_dedup", distinct_documents),
    ("decontamination", unseen_documents),
    ("pii", private_documents),
    ("byte_bpe", token_ids),
]

#: No SQL expresses the classifier, so that none expresses the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
