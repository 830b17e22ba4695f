"""BM25 as column expressions over one pass, and the posting tables behind it."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms, term_count, tokens, total
from ..sources.shared import shared_dir, spread

K1, B = 1.2, 0.75


def idf(n: float, df: float) -> float:
    return log((n - df + 0.5) / (df + 0.5) + 1)


def _weight(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(avgdl))))


def statistics(docs: DataFrame, terms: Column, known: list[str] = ()) -> tuple[int, float, dict[str, int]]:
    """Documents with a term, their mean length (1 at least) and how many hold each of the known terms; one pass."""
    rows = docs.select(terms.alias("_terms")).select(F.size("_terms").alias("_dl"), hits(F.col("_terms"), list(known)).alias("_hits"))
    return counted(rows, F.col("_hits"), F.col("_dl"), known)


def counted(docs: DataFrame, found: Column, dl: Column, known: list[str] = ()) -> tuple[int, float, dict[str, int]]:
    """The same of documents whose hits of these terms and lengths are known."""
    aggs = [F.sum(F.array_contains(found, t).cast("long")).alias(f"_{i}") for i, t in enumerate(known)]
    row = docs.agg(F.count(F.when(dl > 0, 1)).alias("n"), F.sum(F.when(dl > 0, dl)).alias("total"), *aggs).first()
    n = row["n"] or 0
    return n, max(1.0, (row["total"] or 0) / n) if n else 1.0, {t: row[f"_{i}"] or 0 for i, t in enumerate(known)}


def hits(terms: Column, query: list[str]) -> Column:
    """The terms of a document that a query asks for, repeats included."""
    return F.filter(terms, lambda t: t.isin(*dict.fromkeys(query))) if query else F.array().cast("array<string>")


def score(found: Column, dl: Column, query: list[str], n: int, avgdl: float, df: dict[str, int] | None = None) -> Column:
    """Sum over the query's terms, repeats included, from a document's hits and length. Without df each term counts as
    held by one document."""
    parts = []
    for t in dict.fromkeys(query):
        tf = term_count(found, t).cast("double")
        parts.append(F.lit(query.count(t) * idf(max(1, n), 1 if df is None else df[t])) * _weight(tf, dl.cast("double"), max(1.0, avgdl)))
    return total(parts) if parts else F.lit(0.0)


def holds_any(terms: Column, query: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(terms, F.array(*[F.lit(t) for t in dict.fromkeys(query)])), F.lit(False)) if query else F.lit(False)


def postings(docs: DataFrame, id_col: str, text: Column, **how) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, dl); documents without a term are in neither."""
    base = spread(docs).select(F.col(id_col).alias("id"), tokens(text, **how).alias("terms"))
    tf = base.select("id", F.explode("terms").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return tf, base.select("id", F.size("terms").cast("long").alias("dl")).where("dl > 0")


def asked_postings(docs: DataFrame, id_col: str, text: Column, query: str, **how) -> tuple[DataFrame, DataFrame]:
    """The same tables with the query's terms alone, and the lengths of all documents. Texts are cut into terms once; what
    is kept of a document are its length and hits."""
    shared_dir(docs.sparkSession)
    base = spread(docs).select(F.col(id_col).alias("id"), tokens(text, **how).alias("terms"))
    rows = base.select("id", F.size("terms").cast("long").alias("dl"), hits(F.col("terms"), query_terms(query, **how)).alias("hits")).where("dl > 0").checkpoint()
    tf = rows.select("id", F.explode("hits").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return tf, rows.select("id", "dl")


def updated(old: tuple[DataFrame, DataFrame], touched: DataFrame, new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Posting tables after the touched ids' rows are taken out and the new ones put in."""
    out = [o.join(touched.select("id").distinct(), "id", "left_anti").select(*o.columns).unionByName(n) for o, n in zip(old, new)]
    return out[0], out[1]


def ranked_postings(tf: DataFrame, dl: DataFrame, query: str, **how) -> DataFrame:
    """(id, score) with corpus document frequencies, straight from the posting tables."""
    terms = query_terms(query, **how)
    stats = dl.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("dl")).alias("avgdl"))
    weights = tf.sparkSession.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)] or [], "term string, times int")
    hit = tf.join(F.broadcast(weights), "term")
    held = hit.groupBy("term").agg(F.count("*").alias("df"))
    scored = hit.join(F.broadcast(held), "term").join(dl, "id").crossJoin(F.broadcast(stats))
    part = F.col("times") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))
