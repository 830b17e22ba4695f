"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, langid, quality, secrets, sharding, simhash, spm_fst, substring, url_filter

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Block and allow rules: domains, or addresses with what lies below them.
BLOCK = ("casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "ads-track.example.com", "adult-x.example.net", "spam-farm.example.com", "spam-farm.example.org")
ALLOW = ("casino-win.example.com/de", "www.cheap-pills.example.com/en/1")


def rules(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "rule string")


def op1_projection_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decided(table(spark, sf_dir, "pages"), rules(spark, BLOCK), rules(spark, ALLOW))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: A document's rating: a point for quality, one for not being toxic; both make it worth keeping.
GRADE, TOP = "coalesce(quality, 0) + 1 - coalesce(toxic, 0)", 2


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model | None:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), GRADE, TOP)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.selected(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), TOP)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_fst.encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op6_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards; exact copies of a text are one group."""
    return sharding.sharded(table(spark, sf_dir, "documents"), ["text"], 16)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.train(docs))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


QUERIES = {f.__name__: f for f in (op1_projection_knn, op2_url_filter, op3_simhash_near_dedup, op4_quality_classifier, op5_sentencepiece, op6_karmarkar_karp_shards, op7_substring_dedup, op8_benchmark_decontamination, op9_language_id, op10_secret_scan)}
SQL: dict[str, str] = {"op2_url_filter": url_filter.sql(BLOCK, tuple(r.removeprefix("www.") for r in ALLOW)), "op7_substring_dedup": substring.SQL, "op8_benchmark_decontamination": decontam.SQL}
