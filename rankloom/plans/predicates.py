"""Filter trees as columns with two-valued logic: a missing value fails each comparison but Ne and Eq null."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import Any_, Compare, Every, Incoming, Within


def kind_of(dtype: T.DataType) -> str | None:
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "number"
    return None


def literal_kind(value: Any) -> str | None:
    return None if value is None else "bool" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"


class Scope:
    """The columns that a filter can name: kinds by field, how to get each, and the incoming row's, if any."""

    def __init__(self, schema: T.StructType, id_col: str = "id", incoming: T.StructType | None = None, prefix: str = "", incoming_prefix: str = "new."):
        self.kinds = {f.name: kind_of(f.dataType) for f in schema.fields}
        self.id_col, self.prefix = id_col, prefix
        self.incoming = None if incoming is None else {f.name: kind_of(f.dataType) for f in incoming.fields}
        self.incoming_prefix = incoming_prefix

    def of(self, field: str) -> tuple[Column | None, str | None]:
        name = self.id_col if field == "id" else field
        kind = self.kinds.get(name)
        return (F.col(f"{self.prefix}`{name}`"), kind) if kind else (None, None)

    def new(self, field: str) -> tuple[Column | None, str | None]:
        if self.incoming is None:
            raise ValueError("$ref_new is for conditional writes only")
        kind = self.incoming.get(field)
        return (F.col(f"{self.incoming_prefix}`{field}`"), kind) if kind else (None, None)


def _compared(op: str, a: Column, b: Column) -> Column:
    return {"Eq": a == b, "Gt": a > b, "Gte": a >= b, "Lt": a < b, "Lte": a <= b}[op]


def _raw(scope: Scope, node: Compare) -> tuple[Column, bool]:
    """The comparison and whether it may be null; numbers as doubles only where the kinds are mixed."""
    column, kind = scope.of(node.field)
    if isinstance(node.value, Incoming):
        other, other_kind = scope.new(node.value.field)
        if column is None or other is None:
            absent_both = column is None and other is None
            if node.op != "Ne":
                return F.lit(False), False
            return (F.lit(True), False) if absent_both else ((other if column is None else column).isNull(), False)
    else:
        if node.value is None:
            if node.op not in ("Eq", "Ne"):
                return F.lit(False), False
            if column is None:
                return F.lit(node.op == "Eq"), False
            return (column.isNull() if node.op == "Eq" else column.isNotNull()), False
        other, other_kind = F.lit(node.value), literal_kind(node.value)
        if column is None:
            return F.lit(node.op == "Ne"), False
    if isinstance(node.value, Incoming) and node.op == "Ne" and kind == other_kind:
        return ~column.eqNullSafe(other), False
    if kind != other_kind:
        if node.op in ("Eq", "Ne"):
            return (F.lit(False), False) if node.op == "Eq" else (F.lit(True), False)
        if {kind, other_kind} != {"bool", "number"}:
            return F.lit(False), False
        column, other = column.cast("double"), other.cast("double")
    elif kind == "bool" and node.op not in ("Eq", "Ne"):
        column, other = column.cast("int"), other.cast("int")
    if node.op == "Ne":
        return ~column.eqNullSafe(other), False
    return _compared(node.op, column, other), True


def condition(scope: Scope, node: Any, conjunct: bool = True) -> Column:
    """A column for WHERE. In conjunctive places comparisons stay bare, so that scans can use them; a null there drops
    the row just as false does. Elsewhere nulls become false."""
    if isinstance(node, Every):
        return reduce(lambda a, b: a & b, [condition(scope, p, conjunct) for p in node.parts], F.lit(True))
    if isinstance(node, Any_):
        return reduce(lambda a, b: a | b, [condition(scope, p, conjunct) for p in node.parts], F.lit(False))
    if isinstance(node, Within):
        column, kind = scope.of(node.field)
        same = [v for v in node.values if v is not None and not isinstance(v, Incoming) and literal_kind(v) == kind]
        out = column.isin(*same) if column is not None and same else F.lit(False)
        if not conjunct:
            out = F.coalesce(out, F.lit(False))
        for v in node.values:
            if v is None or isinstance(v, Incoming):
                out = out | condition(scope, Compare(node.field, "Eq", v), conjunct)
        return out
    column, nullable = _raw(scope, node)
    return column if conjunct or not nullable else F.coalesce(column, F.lit(False))


def truth(scope: Scope, node: Any) -> Column:
    """The same as a boolean value that is never null."""
    return condition(scope, node, conjunct=False)
