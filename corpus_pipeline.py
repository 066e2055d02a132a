"""The corpus pipeline: stages applied to documents one after another, each written and read again.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents. Documents without a
finding of a stage pass it unchanged. Null texts pass as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.bpe import encode_documents
from sessionlens.llm.common import stored
from sessionlens.llm.decontaminate import find_occurrences, remove_spans
from sessionlens.llm.near_duplicates import keep_one_of_each
from sessionlens.llm.toxicity import score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labelled documents of this stage."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, back = train(docs, labels), {c: f"__{c}" for c in docs.columns if c != "text"}  # no name meets those of the scores
    scored = score_documents(docs.withColumnsRenamed(back), model)
    return scored.where("predicted = 0").select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies (shingles of five words, Jaccard 0.8) the smallest doc_id stays."""
    return keep_one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts; n_chars follows."""
    found = find_occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.size("spans") > 0
    text = F.when(hit, remove_spans(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    cut = found.withColumn("text", text)
    n_chars = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of the byte-level BPE."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", cut_benchmark), ("byte_bpe", encode)]

#: A trained model, MinHash classes and BPE aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last one's rows come back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
