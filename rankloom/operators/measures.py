"""Sizes, overlaps and synthetic corpora used to evaluate and bill queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1


def json_bytes(column: Column, dtype: T.DataType) -> Column:
    """Length of a value's JSON text in UTF-8; missing values have none."""
    quoted = F.to_json(F.struct(column.alias("v")))
    return F.coalesce(F.when(column.isNull(), 0).otherwise(F.octet_length(quoted) - len('{"v":}')), F.lit(0)).cast("long")


def document_bytes(docs: DataFrame, id_col: str = "id") -> Column:
    own = F.octet_length(F.col(id_col).cast("string")).cast("long")
    for f in docs.schema.fields:
        if f.name != id_col:
            own = own + json_bytes(F.col(f"`{f.name}`"), f.dataType)
    return own


def billed(docs: DataFrame, candidates: int, id_col: str = "id") -> DataFrame:
    """(docs, avg_doc_bytes, queried_bytes): candidates times the mean bytes of a document, 1 at least."""
    row = docs.select(document_bytes(docs, id_col).alias("b")).agg(F.count("*").alias("docs"), F.greatest(F.lit(1), F.floor(F.sum("b") / F.count("*"))).cast("long").alias("avg_doc_bytes"))
    return row.withColumn("queried_bytes", (F.col("avg_doc_bytes") * candidates).cast("long"))


def returned_bytes(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(returned_bytes) of result rows: ids, attribute names and values."""
    own = F.octet_length(F.col(id_col).cast("string")).cast("long")
    for f in rows.schema.fields:
        if f.name not in (id_col, "dist"):
            own = own + F.when(F.col(f"`{f.name}`").isNull(), 0).otherwise(len(f.name.encode()) + json_bytes(F.col(f"`{f.name}`"), f.dataType))
    return rows.agg(F.coalesce(F.sum(own), F.lit(0)).cast("long").alias("returned_bytes"))


def overlap(a: DataFrame, b: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """(common, overlap): shared ids of two results and their part of k."""
    both = a.select(id_col).distinct().join(b.select(id_col).distinct(), id_col, "left_semi")
    return both.agg(F.count("*").alias("common")).withColumn("overlap", F.col("common") / F.lit(float(k)))


def synthetic(spark: SparkSession, n: int, dims: int = 128) -> DataFrame:
    """The wave corpus: entry d of vector i is sin((i * dims + d) / 1000)."""
    i = F.col("i")
    wave = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.sin((i * dims + d) * 0.001))
    label = i.cast("string")
    return spark.range(n).withColumnRenamed("id", "i").select(F.concat(F.lit("doc-"), label).alias("id"), F.concat(F.lit("cat-"), (i % 8).cast("string")).alias("category"), F.concat(F.lit("synthetic title "), label).alias("title"), (i % 100).cast("int").alias("priority"), F.concat(F.lit("stressterm document number "), label).alias("text"), wave.alias("embedding"))


def scrambled(spark: SparkSession, n: int, dims: int = 128, seed: int = 42) -> DataFrame:
    """Vectors in [-1, 1) from a xorshift generator seeded by row."""

    @F.pandas_udf("array<double>")
    def vector(i: pd.Series) -> pd.Series:
        x = (np.uint64(seed) ^ (i.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
        out = np.empty((len(i), dims))
        for d in range(dims):
            x ^= x << np.uint64(13)
            x ^= x >> np.uint64(7)
            x ^= x << np.uint64(17)
            out[:, d] = x / 2.0**63 - 1
        return pd.Series(list(out))

    return spark.range(n).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("id"), vector("id").alias("embedding"))
