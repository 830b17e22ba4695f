"""Canonical forms of uuid and datetime values, with errors for what is none, and limits on names."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:([Zz])|([+-])(\d\d):(\d\d))")


def canonical_datetime(raw: str) -> str:
    """RFC 3339 in UTC with nine digits of a second, so that the order of the strings is that of time."""
    m = STAMP.fullmatch(raw.strip())
    if not m:
        raise ValueError(f"invalid datetime '{raw}'")
    y, mo, d, h, mi, s, frac, _, sign, oh, om = m.groups()
    try:
        t = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s))
    except ValueError as e:
        raise ValueError(f"invalid datetime '{raw}': {e}") from e
    if sign:
        shift = timedelta(hours=int(oh), minutes=int(om))
        t = t - shift if sign == "+" else t + shift
    return f"{t:%Y-%m-%dT%H:%M:%S}.{(frac or '')[:9]:0<9}Z".rjust(30, "0")


@F.pandas_udf(T.StringType())
def _datetimes(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else canonical_datetime(x))


def datetimes(column: Column) -> Column:
    return _datetimes(column)


def uuids(column: Column) -> Column:
    """Lower-case hyphenated form; anything else than 32 hex digits, hyphens or braces or urn aside, is an error."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(column), r"^(?i:urn:uuid:)|^\{|\}$", ""), "-", ""))
    ok = bare.rlike("^[0-9a-f]{32}$")
    canonical = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(column.isNull(), None).when(ok, canonical).otherwise(F.raise_error(F.concat(F.lit("invalid uuid "), column)))


def uuid_arrays(column: Column) -> Column:
    return F.transform(column, uuids)


def valid_namespace(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9\-_.]{1,128}", name):
        raise ValueError(f"invalid namespace name: {name!r}")
    return name


def valid_id(value: object) -> str:
    if not isinstance(value, str) or not value or len(value.encode()) > 255 or re.search(r"[/\\\x00]", value):
        raise ValueError(f"invalid document id: {value!r}")
    return value
