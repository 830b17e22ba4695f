"""Conditional and filter-driven writes as joins of incoming rows with the view that they are judged by."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predicates import Scope, condition, truth
from ..plans.spec import parse_filter

FILTER_ROWS = 5_000


def applied(kind: str, current: DataFrame, incoming: DataFrame, when: Any, id_col: str = "id") -> DataFrame:
    """The incoming rows that a condition lets through, judged by the current row of the same id.

    kind "upsert": a row whose id isn't there is inserted. "patch" and "delete": it is skipped; the incoming side of a
    delete has no attributes, so that $ref_new is null.
    """
    if kind not in ("upsert", "patch", "delete"):
        raise ValueError(f"unknown write: {kind}")
    tree = parse_filter(when)
    if kind == "delete":
        incoming = incoming.select(id_col, *[F.lit(None).cast(f.dataType).alias(f.name) for f in current.schema.fields if f.name != id_col])
    cur, new = current.alias("cur"), incoming.alias("new")
    scope = Scope(current.schema, id_col, incoming=incoming.schema, prefix="cur.")
    if kind == "upsert":
        joined = new.join(cur, F.col(f"new.`{id_col}`") == F.col(f"cur.`{id_col}`"), "left")
        kept = joined.where(F.col(f"cur.`{id_col}`").isNull() | truth(scope, tree))
    else:
        kept = new.join(cur, F.col(f"new.`{id_col}`") == F.col(f"cur.`{id_col}`")).where(condition(scope, tree))
    return kept.select("new.*") if kind != "delete" else kept.select(F.col(f"new.`{id_col}`"))


def resolved(view: DataFrame, filters: Any, cap: int = FILTER_ROWS, partial: bool = False, id_col: str = "id") -> tuple[DataFrame, int]:
    """Ids that a filter-driven write touches, the least ones, and how many more match; more than cap is an error unless partial."""
    hit = view.where(condition(Scope(view.schema, id_col), parse_filter(filters))).select(id_col)
    n = hit.count()
    if n > cap and not partial:
        raise ValueError(f"the filter matches {n} rows; {cap} at most")
    return (hit, 0) if n <= cap else (hit.orderBy(id_col).limit(cap), n - cap)
