"""Tokens of text as columns: Unicode words, lower-cased, English function words dropped, optionally stemmed."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem as porter2

#: English function words, by length.
STOPWORDS = tuple(
    """
    a
    be he we if of an in on do no so to or as is at it by
    had did and she the are him can who too her for nor our has was his its not but you may why
    were have such with will them whom from than been then when into your does this that what must they
    would while there where these those being which shall their might
    should
    """.split()
)
WORD = r"([\p{IsAlphabetic}\p{N}]+)"
#: Texts of such characters alone stay as they are under NFKC and never leave the JVM; one anchored possessive run.
STABLE = r"\A[\u0000-\u009F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E]*+\z"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@lru_cache(1 << 16)
def _stem(word: str) -> str:
    return porter2(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(lists: pa.Array) -> pa.Array:
    """Stems of lists of words, which stay in Arrow's form; only the distinct words of a piece become Python objects."""
    pieces = []
    for at in range(0, len(lists), 512):
        some = lists.slice(at, 512)
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(some), 0))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        found = some.flatten().dictionary_encode()
        known = pa.array([None if w is None else _stem(w) for w in found.dictionary.to_pylist()], pa.string())
        pieces.append(pa.ListArray.from_arrays(offsets, known.take(found.indices), mask=some.is_null()))
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(pa.string()))


def nfkc(text: Column) -> Column:
    """NFKC form; texts that can't change pass by."""
    return F.coalesce(_nfkc(F.when(suspect(text), text)), text)


def suspect(text: Column) -> Column:
    """Whether NFKC might change a text; ASCII is told by its length in bytes."""
    return (F.octet_length(text) != F.length(text)) & ~text.rlike(STABLE)


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased after they are cut."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), lambda t: F.lower(t))


def tokens(text: Column, stop: bool = True, stem: bool = False, normalise: bool = True) -> Column:
    """The terms of a text; null gives null. normalise=False is for text that is already NFKC."""
    out = words(nfkc(text) if normalise else text)
    if stop:
        out = F.filter(out, lambda t: ~t.isin(*STOPWORDS))
    return _stems(out) if stem else out


def query_terms(query: str, stop: bool = True, stem: bool = False) -> list[str]:
    """The same on the driver, for query strings."""
    found, run = [], ""
    for c in unicodedata.normalize("NFKC", query) + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "N":
            run += c
        elif run:
            found.append(run.lower())
            run = ""
    found = [t for t in found if not stop or t not in STOPWORDS]
    return [porter2(t) for t in found] if stem else found


def all_text(strings: list[Column]) -> Column:
    """All string attributes of a document as one text."""
    return F.concat_ws(" ", *strings)


def term_count(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == F.lit(term)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))
