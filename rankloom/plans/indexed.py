"""Queries through a namespace's index: postings of the query's terms and members of the nearest cells, then the tail.

Ranked rows stay narrow (id and scores) until the best are known; documents are joined for filters and tie-breaks, and
at the end for the attributes of the best. Documents written after the index was made are scored by a scan of these alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import query_terms, tokens
from ..operators import bm25
from ..operators.fusion import candidate, fused
from ..sources.index import SearchIndex
from ..sources.shared import shared_dir
from .predicates import Scope, condition
from .query import Settings, attached, check_dimensions, final_order, projected, public
from .spec import Fusion, Query, Text, leaves


def served(index: SearchIndex, query: Query, settings: Settings) -> bool:
    """Whether the index has all that a query ranks by, cut into terms as the query wants them."""
    if settings.scan or settings.candidates != "all" or (settings.stop, settings.stem, settings.normalise) != (True, False, True):
        return False
    texts, held = set(index.manifest["text"]), set(index.manifest["vectors"])
    return bool(index.manifest["segments"]) and all(x.field in (texts if isinstance(x, Text) else held) for x in leaves(query.rank))


def text_scores(index: SearchIndex, leaf: Text, tail: DataFrame | None, fresh: DataFrame | None, settings: Settings) -> DataFrame:
    """(id, s) of the documents that hold a term of the query."""
    asked = query_terms(leaf.query)
    known = list(dict.fromkeys(asked))
    cut = None
    if fresh is not None and leaf.field in fresh.columns:
        cut = fresh.select("id", tokens(F.col(f"`{leaf.field}`").cast("string")).alias("terms")).where("terms is not null")
    n, total = index.statistics(leaf.field, tail, cut)
    avgdl = max(1.0, total / n) if n else 1.0
    parts = [x for x in [index.postings(leaf.field, known, tail)] if x is not None]
    if cut is not None:
        words = cut.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).where(F.col("term").isin(known))
        parts.append(words.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl"))
    hits = reduce(lambda a, b: a.unionByName(b), parts)
    df = {r[0]: r[1] for r in hits.groupBy("term").count().collect()} if settings.df == "corpus" else {}
    weights = {t: asked.count(t) * bm25.idf(max(1, n), df.get(t, 0) if settings.df == "corpus" else 1) for t in known}
    weighed = hits.withColumn("w", F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term")) if weights else F.lit(0.0))
    part = F.col("w") * F.col("tf") * (bm25.K1 + 1) / (F.col("tf") + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.lit(float(avgdl))))
    return weighed.groupBy("id").agg(F.sum(part).alias("s"))


def probed_cells(index: SearchIndex, leaf, settings: Settings) -> list[int]:
    centres = index.centres(leaf.field)
    cells = settings.cells if settings.cells is not None else index.measured(leaf.field)
    every = len(centres.fine)
    return list(range(every)) if not cells or cells >= every else sorted(centres.ranked(leaf.query)[:cells].tolist())


def vector_scores(index: SearchIndex, leaf, cells: list[int], tail: DataFrame | None, fresh: DataFrame | None, settings: Settings) -> DataFrame:
    """(id, s) of the members of the nearest cells and of the documents since."""
    parts = []
    held = index.members(leaf.field, cells, tail)
    if held is not None:
        parts.append(held.select("id", "v"))
    if fresh is not None and leaf.field in fresh.columns:
        parts.append(fresh.select("id", F.col(f"`{leaf.field}`").cast("array<double>").alias("v")).where(F.size("v") == len(leaf.query)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("id", vectors.similarity(F.col("v"), leaf.query, settings.metric).alias("s"))


def compiled(index: SearchIndex, query: Query, settings: Settings) -> DataFrame:
    """The same rows as a scan gives, as far as vector rankers read all cells; else the nearest cells' share of them."""
    eventual = query.consistency == "eventual"
    tail = index.tail()
    raw = None if eventual or tail is None else index.fresh()
    types = index.types(raw)
    view = index.view(types, tail, raw).drop("_last_seq")
    check_dimensions(view, query, {f: index.width(f) for f in index.manifest["vectors"]})
    fresh = None
    if raw is not None:
        from ..sources import schema as schemas

        fresh = schemas.typed(raw, types).drop("_last_seq")
    order = leaves(query.rank)
    partial = [False] * len(order)
    scores = []
    for i, leaf in enumerate(order):
        if isinstance(leaf, Text):
            scores.append(text_scores(index, leaf, tail, fresh, settings))
        else:
            cells = probed_cells(index, leaf, settings)
            partial[i] = len(cells) < len(index.centres(leaf.field).fine)
            scores.append(vector_scores(index, leaf, cells, tail, fresh, settings))
    names = [f"_raw_{i}" for i in range(len(order))]
    tie = query.order.field if query.order and query.order.field in view.columns and query.order.field != "id" else None
    if isinstance(query.rank, Fusion):
        marked = [s.select("id", F.lit(i).alias("i"), F.col("s").alias("s")) for i, s in enumerate(scores)]
        rows = reduce(lambda a, b: a.unionByName(b), marked).groupBy("id").agg(*[F.max(F.when(F.col("i") == i, F.col("s"))).alias(n) for i, n in enumerate(names)])
        rows = rows.where(candidate(query.rank, [F.col(n).isNotNull() for n in names]))
    else:
        rows = scores[0].select("id", F.col("s").alias(names[0]))
    # of the documents only what filters, ties and candidates from outside the probed cells ask for
    late = [i for i, leaf in enumerate(order) if partial[i] and isinstance(query.rank, Fusion)]
    if query.filters is not None or tie or late:
        docs = view if query.filters is None else view.where(condition(Scope(view.schema, "id"), query.filters))
        extra = [F.col(f"`{tie}`").alias("_tie")] if tie else []
        more = [vectors.similarity(F.col(f"`{order[i].field}`"), order[i].query, settings.metric).alias(f"_late_{i}") for i in late]
        fits = [(F.size(F.col(f"`{order[i].field}`")) == len(order[i].query)).alias(f"_fits_{i}") for i in late]
        rows = rows.join(docs.select(F.col("id"), *extra, *more, *fits), "id")
        for i in late:
            rows = rows.withColumn(names[i], F.coalesce(F.col(names[i]), F.when(F.col(f"_fits_{i}"), F.col(f"_late_{i}"))))
    for n, leaf in zip(names, order):
        rows = rows.withColumn(n, F.coalesce(F.col(n), F.lit(0.0 if isinstance(leaf, Text) else float("-inf"))))
    rows = rows.select("id", *(["_tie"] if tie else []), *names)
    if isinstance(query.rank, Fusion):
        shared_dir(index.spark)
        rows = rows.checkpoint()
    called = public(view.columns, "id").get(tie) if tie else None
    rows = fused(rows, query.rank, names).select("id", *([F.col("_tie").alias(called)] if tie else []), "dist")
    best = rows.orderBy(*final_order(view, query, "id")).limit(query.top_k)
    return projected(view, query, attached(view, query, best, "id"), "id")
