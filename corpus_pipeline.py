"""The corpus pipeline: documents in, token ids of clean and distinct documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet into the shared folder and rereads as the next stage's docs. All stages but the
last return the columns of documents, n_chars following the text. Null texts are
never toxic, have no lines, shingles or words, and so pass to the end, where they encode to no ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import bpe, decontam, jaccard, line_dedup, toxicity
from codequarry.llm.common import forget, table, unused, written
from codequarry.llm.queries import remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored 0.5 or more; labels are learned from the same rows as in the query."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda key: remainder(key, 5) != 0)
    (score,) = unused(docs, 1)
    return toxicity.score(docs, model, score_col=score).where(f"{score} < 0.5").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity 0.8 or more of five-word shingles."""
    return jaccard.representatives(docs, percent=80, n=5).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark passages make up a twentieth or more."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and hashes of them and of the bytes that they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs.select("doc_id", "text"), ranks, pattern)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the merges; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(last)
    return docs
