"""Compile a query over a view into one DataFrame plan that ends in a top-k."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.text import all_text, query_terms, tokens
from ..operators import bm25
from ..operators.fusion import candidate, fused
from ..sources.shared import shared_dir, spread
from .predicates import Scope, condition, kind_of, truth
from .spec import Fusion, Query, Text, Vector, leaves


@dataclass(frozen=True)
class Settings:
    """How a view ranks: metric, document frequencies of BM25 ("one" or "corpus"), the tokenizer, vector candidates.

    candidates="all" takes every vector of the query's length; "pool" the max(8 k, 64) best before the filter.
    Of a namespace with an index: scan=True leaves it unused; cells is how many of the nearest cells a vector query
    reads, by default as many as kept the measured recall, 0 for all.
    """

    id_col: str = "id"
    metric: str = "cosine_distance"
    df: str = "one"
    stop: bool = True
    stem: bool = False
    normalise: bool = True
    candidates: str = "all"
    scan: bool = False
    cells: int | None = None


def is_vector(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType))


def indexed_text(view: DataFrame, field: str, id_col: str = "id") -> Column:
    """The text of a field: strings as they are, other values as JSON; an empty name means all strings."""
    if field == "":
        return all_text([F.col(f"`{f.name}`") for f in view.schema.fields if kind_of(f.dataType) == "string" and f.name != id_col])
    if field not in view.columns:
        return F.lit(None).cast("string")
    dtype = view.schema[field].dataType
    column = F.col(f"`{field}`")
    if kind_of(dtype) == "string":
        return column
    return column.cast("string") if kind_of(dtype) else F.to_json(column)


def kind_rank(view: DataFrame, field: str, name: str | None = None) -> tuple[Column, bool]:
    """The sort value of a tie-break field and whether it is there; booleans sort as 0 and 1, other kinds as missing."""
    if field not in view.columns or kind_of(view.schema[field].dataType) is None:
        return F.lit(None).cast("double"), False
    column = F.col(f"`{name or field}`")
    return (column if kind_of(view.schema[field].dataType) == "string" else column.cast("double")), True


def public(names: list[str], id_col: str = "id") -> dict[str, str]:
    """What the attributes are called in a result: by their names, but for one that is called as the score is."""
    out: dict[str, str] = {n: n for n in names if n not in ("dist", id_col)}
    if "dist" in names:
        own = "attr_dist"
        while own in names:
            own = f"attr_{own}"
        out["dist"] = own
    return out


def final_order(view: DataFrame, query: Query, id_col: str) -> list[Column]:
    """Score descending, then the tie-break with missing values lowest, then id; over a result's names."""
    out = [F.desc("dist")]
    if query.order:
        value, _ = kind_rank(view, query.order.field, public(view.columns, id_col).get(query.order.field))
        out.append(value.desc_nulls_last() if query.order.descending else value.asc_nulls_first())
    return [*out, F.asc(f"`{id_col}`")]


def check_dimensions(view: DataFrame, query: Query, widths: dict[str, int] | None = None) -> None:
    """The query's vector fields must be vectors of the view, and as long as these where that is known."""
    for leaf in leaves(query.rank):
        if isinstance(leaf, Vector):
            if leaf.field not in view.columns or not is_vector(view.schema[leaf.field].dataType):
                raise ValueError(f"no vector field {leaf.field!r}")
            if not leaf.query:
                raise ValueError("a query vector must not be empty")
            known = (widths or {}).get(leaf.field)
            if known and len(leaf.query) != known:
                raise ValueError(f"the query vector has {len(leaf.query)} entries; field {leaf.field!r} has {known} dimensions")


def scored(view: DataFrame, query: Query, settings: Settings = Settings(), stats_view: DataFrame | None = None) -> DataFrame:
    """The filtered candidates with their final score `dist`, before order and limit: all columns for one vector ranker,
    else id and tie-break only.

    stats_view: the documents whose number and mean length BM25 uses; the view's own by default. Texts are cut into terms
    once, by a job that leaves narrow rows: statistics, scores and normalisation read these. While scores are made, the
    view's columns have a prefix that no generated name has.
    """
    check_dimensions(view, query)
    ident = settings.id_col
    where = None if query.filters is None else condition(Scope(view.schema, ident), query.filters)
    how = {"stop": settings.stop, "stem": settings.stem, "normalise": settings.normalise}
    order = leaves(query.rank)
    names = [f"_raw_{i}" for i in range(len(order))]
    own = {n: f"a:{n}" for n in view.columns}
    key = F.col(f"`{own[ident]}`")
    texts = [i for i, leaf in enumerate(order) if isinstance(leaf, Text)]
    inputs, pools, flags = {}, [], []
    for i, leaf in enumerate(order):
        if isinstance(leaf, Text):
            inputs[f"_in_{i}"] = indexed_text(view, leaf.field, ident)
            flags.append(F.col(f"_hit_{i}"))
            continue
        column = F.col(f"`{leaf.field}`")
        inputs[f"_in_{i}"] = column
        if settings.candidates == "pool":
            best = view.where(F.size(column) == len(leaf.query)).select(F.col(f"`{ident}`").alias(f"_pool_id_{i}"), vectors.similarity(column, leaf.query, settings.metric).alias("_s"))
            pools.append((i, best.orderBy(F.desc("_s"), f"_pool_id_{i}").limit(max(8 * query.top_k, 64)).select(f"_pool_id_{i}", F.lit(True).alias(f"_pool_{i}"))))
            flags.append(F.coalesce(F.col(f"_pool_{i}"), F.lit(False)))
        else:
            flags.append(F.col(f"_fits_{i}"))
    # without a text only what passes the filter counts; with one its documents count for the statistics
    base = view if where is None or texts else view.where(where)
    extra = {"_ok": truth(Scope(view.schema, ident), query.filters)} if where is not None and texts else {}
    kept = list(own)
    if texts or isinstance(query.rank, Fusion):
        kept = [ident] + [query.order.field for _ in [0] if query.order and query.order.field in view.columns and query.order.field != ident]
    base = spread(base) if texts else base
    base = base.select(*[F.col(f"`{n}`").alias(own[n]) for n in kept], *[c.alias(n) for n, c in (inputs | extra).items()])
    for i, best in pools:
        base = base.join(F.broadcast(best), key == F.col(f"_pool_id_{i}"), "left")
    known = {i: list(dict.fromkeys(query_terms(order[i].query, settings.stop, settings.stem))) for i in texts}
    made = {}
    for i, leaf in enumerate(order):
        if i in known:
            made[f"_in_{i}"] = tokens(F.col(f"_in_{i}"), **how)
        else:
            fits = F.coalesce(F.size(f"_in_{i}") == len(leaf.query), F.lit(False))
            made |= {f"_fits_{i}": fits, names[i]: F.when(fits, vectors.similarity(F.col(f"_in_{i}"), leaf.query, settings.metric)).otherwise(float("-inf"))}
    base = base.withColumns(made)
    if texts:
        # hits are the few terms asked for; the pin has them cut once a row
        base = base.withColumns({"_pin": F.spark_partition_id(), **{f"_hits_{i}": bm25.hits(F.col(f"_in_{i}"), known[i]) for i in texts}, **{f"_dl_{i}": F.coalesce(F.size(f"_in_{i}"), F.lit(0)) for i in texts}})
        narrow = [*[f"`{own[n]}`" for n in kept], *extra, *[x for i in texts for x in (f"_hits_{i}", f"_dl_{i}")]]
        narrow += [x for i in range(len(order)) if i not in known for x in (f"_fits_{i}", names[i])] + [f"_pool_{i}" for i, _ in pools]
        shared_dir(view.sparkSession)
        base = base.where("_pin >= 0").select(*narrow).checkpoint()
        scores = {}
        for i in texts:
            terms = known[i] if settings.df == "corpus" else []
            if stats_view is None:
                n, avgdl, df = bm25.counted(base, F.col(f"_hits_{i}"), F.col(f"_dl_{i}"), terms)
            else:
                n, avgdl, df = bm25.statistics(stats_view, tokens(indexed_text(stats_view, order[i].field, ident), **how), terms)
            wanted = query_terms(order[i].query, settings.stop, settings.stem)
            scores |= {names[i]: F.coalesce(bm25.score(F.col(f"_hits_{i}"), F.col(f"_dl_{i}"), wanted, n, avgdl, df if settings.df == "corpus" else None), F.lit(0.0)), f"_hit_{i}": F.coalesce(F.size(f"_hits_{i}") > 0, F.lit(False))}
        base = (base.where("_ok") if extra else base).withColumns(scores)
    chosen = base.where(candidate(query.rank, list(flags))).select(*[F.col(f"`{own[n]}`") for n in kept], *names)
    if isinstance(query.rank, Fusion) and not texts:
        shared_dir(view.sparkSession)
        chosen = chosen.checkpoint()
    called = public(view.columns, ident) | {ident: ident}
    return fused(chosen, query.rank, names).select(*[F.col(f"`{own[n]}`").alias(called[n]) for n in kept], "dist")


def projected(view: DataFrame, query: Query, rows: DataFrame, id_col: str) -> DataFrame:
    """id, dist and the attributes asked for; vectors only where asked for by name or by include_vectors."""
    fields = {f.name: f.dataType for f in view.schema.fields if f.name != id_col}
    vector_fields = [n for n, t in fields.items() if is_vector(t)]
    named = () if isinstance(query.attributes, bool) else query.attributes
    keep = list(fields) if query.attributes is True else [n for n in fields if n in named]
    if query.vectors is False:
        keep = [n for n in keep if n not in vector_fields]
    elif query.vectors is True:
        keep += [n for n in vector_fields if n not in keep]
    elif query.vectors is None:
        keep = [n for n in keep if n not in vector_fields or n in named]
    else:
        keep = [n for n in keep if n not in vector_fields or n in query.vectors] + [n for n in query.vectors if n in vector_fields and n not in keep]
    called = public(view.columns, id_col)
    columns = [vectors.encoded(F.col(f"`{called[n]}`")).alias(called[n]) if query.vector_encoding == "base64" and n in vector_fields else F.col(f"`{called[n]}`") for n in keep]
    return rows.select(F.col(f"`{id_col}`"), "dist", *columns)


def attached(view: DataFrame, query: Query, best: DataFrame, id_col: str) -> DataFrame:
    """The attributes of the few best rows (id, dist), in the query's order; top_k bounds what is sent to the view's scan."""
    best = best.select(F.col(f"`{id_col}`").alias("_best"), "dist")
    called = public(view.columns, id_col)
    own = view.select(F.col(f"`{id_col}`"), *[F.col(f"`{n}`").alias(x) for n, x in called.items()])
    joined = own.join(F.broadcast(best), F.col(f"`{id_col}`") == F.col("_best")).drop("_best")
    return joined.orderBy(*final_order(view, query, id_col)).limit(query.top_k)


def compiled(view: DataFrame, query: Query, settings: Settings = Settings(), stats_view: DataFrame | None = None) -> DataFrame:
    """The whole query: candidates, scores, order, top-k, projection. An attribute called dist comes as attr_dist."""
    rows = scored(view, query, settings, stats_view)
    top = rows.orderBy(*final_order(view, query, settings.id_col)).limit(query.top_k)
    if not isinstance(query.rank, Vector):
        top = attached(view, query, top, settings.id_col)
    return projected(view, query, top, settings.id_col)
