"""Requests as trees: rank_by, filters, order_by, projection. Malformed requests raise ValueError before any job runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DEFAULT_K, MOST_K = 10, 1200
OPS = ("Eq", "Ne", "Gt", "Gte", "Lt", "Lte")


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Within:
    field: str
    values: tuple


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class Incoming:
    """Stands for the attribute of the same write's incoming row."""

    field: str


@dataclass(frozen=True)
class Vector:
    field: str
    query: tuple[float, ...]


@dataclass(frozen=True)
class Text:
    field: str
    query: str


@dataclass(frozen=True)
class Fusion:
    kind: str
    parts: tuple


@dataclass(frozen=True)
class OrderBy:
    field: str
    descending: bool


@dataclass(frozen=True)
class Query:
    rank: Any
    filters: Any = None
    order: OrderBy | None = None
    top_k: int = DEFAULT_K
    attributes: bool | tuple[str, ...] = True
    vectors: bool | tuple[str, ...] | None = None
    vector_encoding: str = "float"
    consistency: str = "strong"
    extra: dict = field(default_factory=dict)


def _literal(value: Any) -> Any:
    if isinstance(value, dict):
        if set(value) == {"$ref_new"} and isinstance(value["$ref_new"], str):
            return Incoming(value["$ref_new"])
        raise ValueError("a filter value must be null, a string, a number, a boolean or {$ref_new: field}")
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise ValueError("a filter value must be null, a string, a number or a boolean")
    return value


def parse_filter(raw: Any) -> Any:
    """["field", op, value] | ["field", "In", [..]] | ["And" | "Or", [filters]]"""
    if not isinstance(raw, (list, tuple)) or not raw:
        raise ValueError("a filter must be an array that is not empty")
    head = raw[0]
    if not isinstance(head, str):
        raise ValueError("a filter starts with a field or with And or Or")
    if head in ("And", "and", "Or", "or"):
        if len(raw) < 2 or not isinstance(raw[1], (list, tuple)):
            raise ValueError(f"{head} needs an array of filters")
        parts = tuple(parse_filter(x) for x in raw[1])
        return Every(parts) if head in ("And", "and") else Any_(parts)
    if len(raw) < 3 or not isinstance(raw[1], str):
        raise ValueError("a comparison needs a field, an operator and a value")
    if raw[1] == "In":
        if not isinstance(raw[2], (list, tuple)) or not raw[2]:
            raise ValueError("In needs an array of values that is not empty")
        return Within(head, tuple(_literal(v) for v in raw[2]))
    if raw[1] not in OPS:
        raise ValueError(f"unsupported filter operator: {raw[1]} (supported: {', '.join(OPS)}, In)")
    return Compare(head, raw[1], _literal(raw[2]))


def parse_rank(raw: Any) -> Any:
    """["vector", "ANN", field, query] | ["BM25", field, text] | ["Sum" | "Product", rankers...]"""
    if not isinstance(raw, (list, tuple)) or not raw:
        raise ValueError("rank_by must be an array that is not empty")
    head, rest = raw[0], raw[1:]
    if head in ("vector", "Vector"):
        if len(rest) < 3 or not isinstance(rest[1], str) or not isinstance(rest[2], (list, tuple)):
            raise ValueError("a vector ranker needs [vector, ANN, field, query]")
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in rest[2]):
            raise ValueError("a query vector holds numbers")
        return Vector(rest[1], tuple(float(x) for x in rest[2]))
    if head in ("BM25", "bm25"):
        if len(rest) < 2 or not isinstance(rest[0], str) or not isinstance(rest[1], str):
            raise ValueError("a text ranker needs [BM25, field, query]")
        return Text(rest[0], rest[1])
    if head in ("Sum", "sum", "Product", "product"):
        if not rest:
            raise ValueError(f"{head} needs rankers")
        return Fusion(head.lower(), tuple(parse_rank(x) for x in rest))
    raise ValueError(f"unknown rank_by operator: {head}")


def parse_order(raw: Any) -> OrderBy | None:
    if raw is None:
        return None
    if not isinstance(raw, (list, tuple)) or len(raw) < 2 or not all(isinstance(x, str) for x in raw[:2]):
        raise ValueError("order_by needs [field, asc|desc]")
    way = raw[1].lower()
    if way not in ("asc", "ascending", "desc", "descending"):
        raise ValueError(f"unknown order_by direction: {raw[1]}")
    return OrderBy(raw[0], way.startswith("desc"))


def parse_top_k(raw: Any) -> int:
    k = DEFAULT_K if raw is None else raw
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_K:
        raise ValueError(f"top_k must be between 1 and {MOST_K}")
    return k


def _choice(raw: Any, name: str, default: Any, empty_ok: bool) -> Any:
    if raw is None:
        return default
    if isinstance(raw, bool):
        return raw
    if isinstance(raw, (list, tuple)) and all(isinstance(x, str) for x in raw) and (raw or empty_ok):
        return tuple(raw)
    raise ValueError(f"{name} must be true, false or a list of names")


def parse_query(request: dict) -> Query:
    encoding = request.get("vector_encoding") or "float"
    if encoding not in ("float", "base64"):
        raise ValueError(f"unknown vector_encoding: {encoding}")
    consistency = request.get("consistency") or "strong"
    if isinstance(consistency, dict):
        consistency = consistency.get("level", "strong")
    if consistency not in ("strong", "eventual"):
        raise ValueError(f"unknown consistency: {consistency}")
    if "rank_by" not in request:
        raise ValueError("rank_by is missing")
    return Query(
        rank=parse_rank(request["rank_by"]),
        filters=None if request.get("filters") is None else parse_filter(request["filters"]),
        order=parse_order(request.get("order_by")),
        top_k=parse_top_k(request.get("top_k")),
        attributes=_choice(request.get("include_attributes"), "include_attributes", True, True),
        vectors=_choice(request.get("include_vectors"), "include_vectors", None, False),
        vector_encoding=encoding,
        consistency=consistency,
    )


def leaves(rank: Any) -> list:
    return [x for part in rank.parts for x in leaves(part)] if isinstance(rank, Fusion) else [rank]
