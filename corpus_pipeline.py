"""Corpus preparation from documents to piece ids, in five stages; each works on all that its predecessor kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the
shared folder and reads it back as the next one's docs. All stages but the last return the columns of documents.
Null ids and texts never crash a stage: the classifier rejects rows without a word; the later ones keep what they
can't judge. Repeated rows stay or go together, very long texts count whole, of copies the least id stays, columns beside
those of documents pass through whatever they are called. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontam, quality, secrets, simhash, spm_fst
from rankloom.llm.common import cut, written
from rankloom.llm.registry import GRADE, TOKENIZERS, TOP, table


#: Ids up to which a list of them is sent to every executor; a longer one is joined by shuffle.
SENT_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the ids; rows whose own id is null stay."""
    gone = cut(ids.select(F.col("doc_id").alias("_gone")).distinct())
    few = gone.count() <= SENT_IDS
    gone = F.broadcast(gone) if few else gone.hint("merge")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted to the ratings in labels, keeps."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), GRADE, TOP)
    return quality.kept_rows(docs, model, TOP)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: the one of the least id."""
    return _without(docs, simhash.near_duplicates(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars counts the text as it is then."""
    clean = secrets.redacted(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document."""
    return spm_fst.encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: The classifier, SimHash and the tokenizers can't be written in SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
