"""Shared pieces: whole-text tokens, stable hashes, lineage cuts.

Tokens are maximal runs of word characters of the lower-cased text. Hashes do not depend on the process, so every
executor, and every rerun of a lost task, agrees on them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, spread

WORDS = re.compile(r"\w+")
#: Entries after which a word cache is emptied; it bounds memory and never changes a result.
CACHE_WORDS = 150_000


class WordHash(dict):
    """word -> 64-bit hash as a Python int; a missing word is hashed once and remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        words = WORDS.findall(text.lower())
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache a process, whatever operators run in it.
word_hash = WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that each output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class RollingHash:
    """Rabin-Karp hashes modulo 2**64 of all windows of `width` tokens, by differences of prefix sums."""

    def __init__(self, width: int, base: int = 0xD6E8FEB86659FD93):
        self.width = width
        self._base, self._inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self._up = np.cumprod(np.r_[np.uint64(1), np.full(n + self.width, self._base, np.uint64)], dtype=np.uint64)
            self._down = np.cumprod(np.r_[np.uint64(1), np.full(n + self.width, self._inverse, np.uint64)], dtype=np.uint64)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if n < self.width:
            return np.empty(0, np.uint64)
        if n + self.width > len(self._up):
            self._grow(2 * n)
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum(tokens * self._down[:n], dtype=np.uint64)]
            return mixed((total[self.width :] - total[: n - self.width + 1]) * self._up[self.width - 1 : n])


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordered: bool = False) -> DataFrame:
    """Only the two columns that an operator needs, under fixed names; whatever else the table has can't clash. An id that
    is no integer counts as null. ordered: the rows' order matters, so they aren't spread over idle cores."""
    rows = docs.select(docs[id_col].try_cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows if ordered else spread(rows)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what is made of a part stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable_fraction(df: DataFrame, id_col: str, fraction: float) -> DataFrame:
    """Rows whose hashed id falls below the fraction: the same rows on every run and machine."""
    if fraction >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(fraction * (1 << 30)))
