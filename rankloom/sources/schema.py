"""Declared attribute types: what each means for text search, filters and vectors, and typed views of JSON attributes."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_datetime
from ..functions.vectors import decode

MOST_VECTORS = 2


def type_of(spec: Any) -> str:
    return str(spec.get("type", "") if isinstance(spec, dict) else spec).lower()


def is_vector(spec: Any) -> bool:
    t = type_of(spec)
    return any(x in t for x in ("f32", "f16", "vector", "[]f"))


def vector_bits(spec: Any) -> int:
    return 16 if "f16" in type_of(spec) else 32


def declared_width(spec: Any) -> int | None:
    found = re.match(r"\[(\d+)\]", type_of(spec)) if spec is not None and is_vector(spec) else None
    return int(found[1]) if found else None


def is_text(spec: Any) -> bool:
    if isinstance(spec, dict) and spec.get("full_text_search") is True:
        return True
    return any(x in type_of(spec) for x in ("string", "text", "full_text"))


def is_scalar(spec: Any) -> bool:
    t = type_of(spec)
    return t in ("uuid", "datetime") or any(x in t for x in ("string", "text", "bool", "int", "float", "number")) and not t.startswith("[]")


def is_filterable(spec: Any) -> bool:
    if isinstance(spec, dict) and isinstance(spec.get("filterable"), bool):
        return spec["filterable"]
    return not is_vector(spec) and (is_text(spec) if isinstance(spec, dict) and is_text(spec) else is_scalar(spec))


def text_fields(schema: dict) -> list[str]:
    """Explicitly marked fields if there are any, else all of string type."""
    marked = [k for k, v in schema.items() if isinstance(v, dict) and v.get("full_text_search") is True]
    return marked or [k for k, v in schema.items() if is_text(v)]


def merged(schema: dict, patch: dict) -> dict:
    out = {**schema, **patch}
    if sum(is_vector(v) for v in out.values()) > MOST_VECTORS:
        raise ValueError(f"a namespace has {MOST_VECTORS} vector fields at most")
    return out


def canonical_uuid(raw: str) -> str:
    bare = re.sub(r"^urn:uuid:|^\{|\}$", "", raw.strip().lower()).replace("-", "")
    if not re.fullmatch("[0-9a-f]{32}", bare):
        raise ValueError(f"invalid uuid '{raw}'")
    return "-".join((bare[:8], bare[8:12], bare[12:16], bare[16:20], bare[20:]))


def canonical(name: str, value: Any, spec: Any) -> Any:
    """A value as it is stored, by its declared type; errors name the attribute."""
    if value is None or spec is None:
        return value
    t = type_of(spec)
    if t == "datetime":
        if not isinstance(value, str):
            raise ValueError(f"attribute '{name}' is a datetime; its value must be a string")
        return canonical_datetime(value)
    if t == "uuid":
        if not isinstance(value, str):
            raise ValueError(f"attribute '{name}' is a uuid; its value must be a string")
        return canonical_uuid(value)
    if t == "[]uuid":
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ValueError(f"attribute '{name}' is an array of uuids")
        return [canonical_uuid(x) for x in value]
    if is_vector(spec):
        if isinstance(value, str):
            value = decode(value, vector_bits(spec))
        if not isinstance(value, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in value):
            raise ValueError(f"attribute '{name}' is a vector of numbers")
        width = re.match(r"\[(\d+)\]", t)
        if width and len(value) != int(width[1]):
            raise ValueError(f"attribute '{name}' has {len(value)} entries, not {width[1]}")
        return [float(x) for x in value]
    return value


def to_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def column(spec: Any, raw: Column) -> Column:
    """The typed column of an attribute's JSON text; another kind of value counts as missing."""
    t = type_of(spec)
    text = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    if is_vector(spec):
        return F.from_json(raw, "array<float>")
    if t == "[]uuid":
        return F.from_json(raw, "array<string>")
    if t.startswith("bool"):
        return F.when(raw.isin("true", "false"), raw == "true")
    if ("int" in t) or any(x in t for x in ("float", "number")):
        return F.when(raw.rlike(r"^-?\d"), raw.try_cast("bigint" if "int" in t else "double"))
    if t == "json":
        return raw
    return F.when(raw.startswith('"'), text)


def inferred(docs: DataFrame, schema: dict) -> dict:
    """Types of the attributes that nobody declared, from all documents: one kind gives its type, several give JSON text."""
    unknown = F.map_filter("attrs", lambda name, _: ~name.isin(*schema)) if schema else F.col("attrs")
    pairs = docs.select(F.explode(unknown).alias("name", "raw")).where("raw <> 'null'")
    kind = F.when(F.col("raw").startswith('"'), "string").when(F.col("raw").isin("true", "false"), "bool").when(F.col("raw").rlike(r"^-?\d"), "number").when(F.col("raw").rlike(r"^\[\s*-?\d"), "[]f32").otherwise("json")
    found = pairs.groupBy("name").agg(F.collect_set(kind).alias("kinds")).collect()
    return schema | {r["name"]: r["kinds"][0] if len(r["kinds"]) == 1 else "json" for r in sorted(found, key=lambda r: r["name"])}


def joined(a: dict, b: dict) -> dict:
    """Types of both; an attribute that they call by different ones is JSON text."""
    return a | {n: t if type_of(a.get(n, t)) == type_of(t) else "json" for n, t in b.items()}


def typed(docs: DataFrame, schema: dict) -> DataFrame:
    """id, one column for each attribute, and _last_seq."""
    rest = ["_last_seq"] if "_last_seq" in docs.columns else []
    return docs.select("id", *[column(spec, F.element_at("attrs", F.lit(name))).alias(name) for name, spec in schema.items()], *rest)
