"""Language identification, words first: log frequencies of known words, then of ever shorter character n-grams.

A word that training has seen scores its log frequency in each language. An unseen one falls back to its n-grams,
ends marked: the longest order of which one is known, averaged. A text gets the language of the greatest mean over its
words. Training counts all words of about `max_train` rows of each language at most, chosen by hashed id; of a rarer
language all rows count. Words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread
from .common import WORDS, cut, id_text, map_arrow, slices

ORDERS = (5, 4, 3, 2, 1)
#: Labelled rows of a language that training looks at, about; it bounds the model as well.
MAX_TRAIN = 20_000
#: Languages up to which their sizes are sent to every executor.
SENT_LANGS = 10_000
#: Words whose rows a scorer remembers before it starts afresh; never changes a result.
CACHE = 200_000


def hashes(keys: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64)


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[j : j + n] for j in range(len(marked) - n + 1)]


class Table:
    """Log frequencies by language of hashed keys, which ascend."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.logs = (np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * max(1, len(keys)))).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def __contains__(self, key: str) -> bool:
        return bool(self.find(hashes([key]))[0] >= 0)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    words: Table
    grams: tuple[Table, ...]

    def rows(self, words: list[str]) -> np.ndarray:
        """The scores of each word by language."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = self.words.find(hashes(words))
        out[at >= 0] = self.words.logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n, known in zip(ORDERS, self.grams):
            if not len(left):
                break
            own = [grams(words[i], n) for i in left.tolist()]
            at = known.find(hashes(g for x in own for g in x))
            word = np.repeat(np.arange(len(left)), [len(x) for x in own])[at >= 0]
            many = np.bincount(word, minlength=len(left))
            hit = many > 0
            for c in range(len(self.langs)):
                out[left[hit], c] = np.bincount(word, known.logs[at[at >= 0], c], len(left))[hit] / many[hit]
            left = left[~hit]
        return out


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """Model of the labelled rows; those with a null language, id or text are left out. Without any it knows no language."""
    rows = spread(docs.select(docs[id_col].try_cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("id is not null and lang is not null"))
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    some = rows.join(F.broadcast(sizes) if sizes.count() <= SENT_LANGS else sizes, "lang").where((F.col("rows") <= max_train) | (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.floor(F.lit(max_train) / F.col("rows") * (1 << 30))))
    some = some.where("text is not null").select("id", "text", "lang")

    def count(batches):
        found: dict[str, Counter] = {}
        for b in slices(batches):
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    counted = cut(map_arrow(some, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = tuple(sorted(r[0] for r in counted.select("lang").distinct().collect()))
    place = {lang: i for i, lang in enumerate(langs)}

    def keyed(batches):
        """Order 0 is the word itself."""
        for b in slices(batches, 20_000):
            langs = np.array([place[x] for x in b.column(0).to_pylist()], np.int32)
            words, many = b.column(1).to_pylist(), b.column(2).to_numpy()
            for n in (0, *ORDERS):
                own = [[w] for w in words] if n == 0 else [grams(w, n) for w in words]
                at = np.repeat(np.arange(len(words)), [len(x) for x in own])
                h = hashes(g for x in own for g in x)
                # sums within the batch first
                by = np.lexsort((langs[at], h))
                h, lang, times = h[by], langs[at][by], many[at][by]
                if len(h):
                    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n, np.int32)), pa.array(h[first].view(np.int64)), pa.array(lang[first]), pa.array(np.add.reduceat(times, first))], ["o", "h", "lang", "n"])

    found = map_arrow(counted, keyed, "o int, h long, lang int, n long").groupBy("o", "h", "lang").agg(F.sum("n").alias("n")).toArrow()
    order, h, lang, n = (found[c].to_numpy() for c in ("o", "h", "lang", "n"))

    def table(o: int) -> Table:
        own = order == o
        keys, at = np.unique(h[own].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        counts[at, lang[own]] = n[own]
        return Table(keys, counts)

    return Model(langs, table(0), tuple(table(o) for o in ORDERS))


class Scorer:
    """Scores texts; rows of words are kept in one matrix so that a text is one sum."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.matrix = np.empty((0, len(self.model.langs)), np.float32)

    def means(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if not self.model.langs:
            return [None] * len(texts)
        if len(self.at) > CACHE:
            self.reset()
        cut = [WORDS.findall(t.lower()) if t else [] for t in texts]
        new = list({w: None for words in cut for w in words if w not in self.at})
        if new:
            self.at |= {w: i for i, w in enumerate(new, len(self.at))}
            if len(self.matrix) < len(self.at):  # room to grow
                self.matrix = np.concatenate([self.matrix, np.zeros((len(self.at), len(self.model.langs)), np.float32)])
            self.matrix[len(self.at) - len(new) : len(self.at)] = self.model.rows(new)
        look = self.at.__getitem__
        return [self.matrix[np.fromiter(map(look, w), np.int64, len(w))].sum(axis=0, dtype=np.float64) / len(w) if w else None for w in cut]


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pred_lang, margin) row by row: the language of the greatest mean, the least name on ties, and its lead.

    Null, empty or wordless texts, and all texts under a model without languages, get nulls; null ids and repeated
    rows pass through, very long texts count whole, and an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(known.value)
        langs = known.value.langs
        for b in slices(batches, 500):
            pred, lead = [], []
            for m in scorer.means(b.column(1).to_pylist()):
                if m is None:
                    pred.append(None)
                    lead.append(None)
                    continue
                best = int(np.argmax(m))
                pred.append(langs[best])
                lead.append(float(m[best] - np.partition(m, -2)[-2]) if len(m) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(lead, pa.float64())], ["doc_id", "pred_lang", "margin"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, pred_lang string, margin double")
