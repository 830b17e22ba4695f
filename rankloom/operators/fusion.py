"""Fusion of several signals: candidates, min-max normalisation over the filtered candidates, sums and products."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Fusion

FINITE = "isnotnull({0}) and not isnan({0}) and abs({0}) < double('Infinity')"


def candidate(rank: Any, flags: list[Column]) -> Column:
    """Whether a row is a candidate: any part's for a sum, every part's for a product. flags: one for each leaf, in order."""
    if not isinstance(rank, Fusion):
        return flags.pop(0)
    parts = [candidate(p, flags) for p in rank.parts]
    return reduce((lambda a, b: a | b) if rank.kind == "sum" else (lambda a, b: a & b), parts)


def normalised(df: DataFrame, names: list[str]) -> DataFrame:
    """df with each score column replaced by its min-max form; one aggregate gives one row, which is sent to all."""
    aggs = []
    for n in names:
        finite = F.when(F.expr(FINITE.format(f"`{n}`")), F.col(n))
        aggs += [F.min(finite).alias(f"_lo_{n}"), F.max(finite).alias(f"_hi_{n}")]
    both = df.crossJoin(F.broadcast(df.agg(*aggs)))
    for n in names:
        s, lo, hi = F.col(n), F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        spread = F.when(hi - lo < 1e-12, F.when(s > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - lo) / (hi - lo))))
        both = both.withColumn(f"_n_{n}", F.when(F.expr(FINITE.format(f"`{n}`")), spread).otherwise(0.0))
    return both.drop(*[f"_{x}_{n}" for n in names for x in ("lo", "hi")])


def fused(df: DataFrame, rank: Any, leaf_names: list[str], out: str = "dist") -> DataFrame:
    """df, the filtered candidates with a raw score for each leaf, with the fused score; rows that fusion drops are gone.

    A nested fusion scores all candidates of the whole; where it drops one, it gives it 0 at the level above.
    """
    if not isinstance(rank, Fusion):
        return df.withColumnRenamed(leaf_names[0], out)
    names, todo = [], list(leaf_names)
    for i, part in enumerate(rank.parts):
        if isinstance(part, Fusion):
            own = [todo.pop(0) for _ in range(_width(part))]
            df = _level(df, part, own, f"{out}_{i}")
            names.append(f"{out}_{i}")
        else:
            names.append(todo.pop(0))
    df = _combined(df, rank, names, out)
    return df.where(F.col(out).isNotNull())


def _width(rank: Any) -> int:
    return sum(map(_width, rank.parts)) if isinstance(rank, Fusion) else 1


def _level(df: DataFrame, rank: Fusion, leaf_names: list[str], out: str) -> DataFrame:
    names, todo = [], list(leaf_names)
    for i, part in enumerate(rank.parts):
        if isinstance(part, Fusion):
            own = [todo.pop(0) for _ in range(_width(part))]
            df = _level(df, part, own, f"{out}_{i}")
            names.append(f"{out}_{i}")
        else:
            names.append(todo.pop(0))
    return _combined(df, rank, names, out)


def _combined(df: DataFrame, rank: Fusion, names: list[str], out: str) -> DataFrame:
    """df with the sum or product of the parts' normalised scores; null where the rule drops the row."""
    df = normalised(df, names)
    parts = [F.col(f"_n_{n}") for n in names]
    if rank.kind == "sum":
        value = reduce(lambda a, b: a + b, parts)
        positive = reduce(lambda a, b: a | b, [F.coalesce(F.expr(FINITE.format(f"`{n}`")) & (F.col(n) > 0), F.lit(False)) for n in names])
        keep = (value > 0) | positive
    else:
        value = reduce(lambda a, b: a * b, parts)
        keep = value > 0
    return df.withColumn(out, F.when(keep, value)).drop(*[f"_n_{n}" for n in names])
