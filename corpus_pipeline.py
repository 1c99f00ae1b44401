"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Documents that fail the quality rules go, one of each group of near copies stays, secrets are blotted out, sources are
mixed to their targets (a document that is taken several times is there several times), and what is left is segmented.
Each stage works on all that the one before it kept, with nulls, empty and long texts, ties, repeated rows, empty
tables and other columns as its operator defines them; a stage's own working columns never clash with the table's.
Each begins with executors' heaps collected, since some stages need memory in the JVM and others in Python.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtrace.llm import host_quality, jaccard, mixing, pieces, secrets
from claimtrace.llm.common import collect_executors, remove_folder, shared_folder, whole
from claimtrace.llm.queries import SEED


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: not failed by themselves, nor by their host's verdict (operator 9)."""
    collect_executors(spark)
    return host_quality.kept_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts at Jaccard 0.8 or more of five-word shingles are linked.

    Operator 5's fingerprints and search find the first candidates, MinHash bands those beyond its distance; all are
    verified on whole shingle sets, see ``jaccard`` and the README.
    """
    collect_executors(spark)
    return jaccard.representatives(docs, width=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced by a mark (operator 7); ``n_chars`` follows the text."""
    collect_executors(spark)
    found = secrets.with_spans(docs)
    text = F.when(F.size("secret_spans") > 0, secrets.redacted(whole(), F.col("secret_spans"))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times or not at all (operator 4)."""
    collect_executors(spark)
    return mixing.mixture(docs, weights=[1, 2, 3], most=3)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations (operator 1): a document that the mix takes several times gets as many distinct ones."""
    collect_executors(spark)
    copies = docs.groupBy("doc_id", "source", whole().alias("text")).agg(F.count(F.lit(1)).alias("k"))
    drawn = pieces.sampled_segmentations(copies, public_tokenizers.path("piece_bpe_32k.model"), k=F.col("k"), seed=SEED, keep=["doc_id", "source"])
    return drawn.select("doc_id", "source", "n_pieces", "log_prob", "log_inclusion", "exact", "pieces")


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", redact), ("mix", mix), ("segment", segment)]

#: Fingerprints and sampled segmentations have no SQL form; tests hold each stage to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what one writes goes to the folder of ``spark.checkpoint.dir``.

    What a stage wrote is deleted when the next one has written; the last one's input stays, since its rows are computed
    when they are asked for.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove_folder(spark, last)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
