"""The corpus pipeline: stages over ``documents``, each stored before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageproof.llm import bpe, langid, minhash, mixing, secrets
from pageproof.llm.common import held_out, prepared, stored, table
from pageproof.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without text or letters go."""
    prepared(spark)
    return langid.accepted(docs, langid.learn(docs.where(~held_out(F.col("doc_id")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    prepared(spark)
    return minhash.one_of_each(docs, size=5, percent=80)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its reported secrets replaced by a placeholder."""
    prepared(spark)
    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates that bring token shares of domains to their
    targets: good ones stay, low and toxic ones are thinned out."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text."""
    prepared(spark)
    return bpe.encode_documents(docs, TOKENIZER, keep_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", scan_secrets),
    ("mixing sources to target weights", mix_domains),
    ("BPE encoding and decoding", encode_bpe),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
