"""Benchmark passages in documents: prefix-filtered set join of word shingles with containment checked per window.

The shingles of an item are ordered by rarity, their number of documents over the whole corpus. A window that holds
`threshold` of an item's k shingles must hold one of its first k - ceil(threshold * k) + 1, so only these are looked
up. Length bound: the document has that many shingles at least. Positional bound: a hit on the j-th rarest without an
earlier one leaves k - j + 1 at most. What remains is verified in every window of the item's length.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, cut, id_text, map_arrow, slices, word_hash

SHINGLE = 4
THRESHOLD = 0.5
#: Bytes of benchmark text that one pass holds on every executor; a larger benchmark takes several passes.
PASS_BYTES = 32_000_000


def _items(rows: list[tuple[int, str]], n: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(item id, shingle size, places of shingles, distinct shingles); items of fewer than n words use all their words."""
    out = []
    for item, text in rows:
        tokens = word_hash.of(text)
        if len(tokens):
            size = min(n, len(tokens))
            shingles = RollingHash(size, 2 * size + 0xD6E8FEB86659FD01).of(tokens)
            out.append((item, size, len(shingles), np.unique(shingles)))
    return out


def best_window(places: np.ndarray, kinds: np.ndarray, width: int) -> tuple[int, int]:
    """Most distinct kinds at places p with s <= p < s + width over the starts s among the places, and the least such s."""
    best, start, count, b = 0, -1, {}, 0
    ps, ks = places.tolist(), kinds.tolist()
    for a, p in enumerate(ps):
        while b < len(ps) and ps[b] < p + width:
            count[ks[b]] = count.get(ks[b], 0) + 1
            b += 1
        if len(count) > best:
            best, start = len(count), p
        count[ks[a]] -= 1
        if not count[ks[a]]:
            del count[ks[a]]
    return best, start


class Probe:
    """Looks the items' shingles up in documents; df: documents per shingle, None while these are being counted."""

    def __init__(self, items: list[tuple[int, int, int, np.ndarray]], threshold: float, df: dict[int, int] | None = None):
        self.items, self.sizes = items, sorted({i[1] for i in items})
        self.keys = {s: np.unique(np.concatenate([i[3] for i in items if i[1] == s])) for s in self.sizes}
        self.sieve = {}
        for s, k in self.keys.items():
            self.sieve[s] = np.zeros(1 << 16, bool)
            self.sieve[s][(k >> np.uint64(48)).astype(np.int64)] = True
        self.need = [ceil(threshold * len(i[3]) - 1e-9) for i in items]
        self.holders: dict[int, list[tuple[int, int]]] = {}
        if df is not None:
            for x, (_, size, _, kinds) in enumerate(items):
                ordered = sorted(kinds.tolist(), key=lambda h: (df.get(h, 0), h))
                for j, h in enumerate(ordered[: len(kinds) - self.need[x] + 1]):
                    self.holders.setdefault(h, []).append((x, j))
        self.rolling = {s: RollingHash(s, 2 * s + 0xD6E8FEB86659FD01) for s in self.sizes}

    def hits(self, tokens: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        """For each shingle size: shingles of the document, places of known ones, these."""
        out = {}
        for s in self.sizes:
            h = self.rolling[s].of(tokens)
            at = np.flatnonzero(self.sieve[s][(h >> np.uint64(48)).astype(np.int64)])
            if len(at):
                k = self.keys[s]
                at = at[k[np.minimum(np.searchsorted(k, h[at]), len(k) - 1)] == h[at]]
            if len(at):
                out[s] = len(h), at, h[at]
        return out

    def matches(self, s: int, n: int, words: int, at: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, start token, end token, containment) of the best window of each item that reaches the threshold.

        For shingle size s: the document's n shingles and its words, the places of known ones and these.
        """
        out = []
        earliest: dict[int, int] = {}
        present = np.unique(found)
        for h in present.tolist():
            for x, j in self.holders.get(h, ()):
                if self.items[x][1] == s and n >= self.need[x]:
                    earliest[x] = min(j, earliest.get(x, j))
        for x, j in earliest.items():
            item, _, width, kinds = self.items[x]
            if len(kinds) - j < self.need[x] or np.isin(kinds, present, assume_unique=True).sum() < self.need[x]:
                continue
            own = np.isin(found, kinds)
            best, start = best_window(at[own], found[own], width)
            if best >= self.need[x]:
                out.append((item, start, min(start + width + s - 1, words), best / len(kinds)))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, start_token, end_token, containment): for each document and item, the first of the best windows.

    A window has as many shingle places as the item and starts at one that it shares; containment is the share of the
    item's distinct shingles in it. Items of fewer words than a shingle are one shingle. Null or wordless texts and
    items, null ids and empty tables give no rows; a repeated item_id is an item for each of its texts, a doc_id on
    several rows gives the rows of each, and equal rows come once. Very long texts are searched whole; of windows that tie
    the first counts.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col).where("id is not null and text is not null")
    marks = id_text(benchmark, item_col, item_text_col).where("id is not null and text is not null").distinct()
    total = marks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    results = []
    for k in range(passes):
        part = marks if passes == 1 else marks.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k)
        items = _items([(r[0], r[1]) for r in part.orderBy("id", "text").collect()], shingle)
        if not items:
            continue
        held = spark.sparkContext.broadcast(items)

        def look(batches, held=held, threshold=threshold):
            probe = Probe(held.value, threshold)
            for b in slices(batches):
                out = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    tokens = word_hash.of(text)
                    out += [(i, s, n, len(tokens), at.tobytes(), h.tobytes()) for s, (n, at, h) in probe.hits(tokens).items()]
                cols = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "size", "n", "words", "at", "found"])

        # what the corpus shares with the items, found in one pass, serves both the counts and the search
        hits = cut(map_arrow(texts, look, "id long, size int, n long, words long, at binary, found binary"))

        def count(batches):
            df: dict[int, int] = {}
            for b in batches:
                for raw in b.column(0).to_pylist():
                    for h in np.unique(np.frombuffer(raw, np.uint64)).tolist():
                        df[h] = df.get(h, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(df), np.uint64).view(np.int64)), pa.array(list(df.values()), pa.int64())], ["h", "n"])

        rows = map_arrow(hits.select("found"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
        known = spark.sparkContext.broadcast((items, {int(np.int64(r[0]).view(np.uint64)): r[1] for r in rows}))

        def search(batches, known=known, threshold=threshold):
            probe = Probe(known.value[0], threshold, known.value[1])
            for b in batches:
                out = [(i, *m) for i, s, n, words, at, h in zip(*(c.to_pylist() for c in b.columns)) for m in probe.matches(s, n, words, np.frombuffer(at, np.int64), np.frombuffer(h, np.uint64))]
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64())], ["doc_id", "item_id", "start_token", "end_token", "containment"])

        results.append(map_arrow(hits, search, "doc_id long, item_id long, start_token long, end_token long, containment double"))
    if not results:
        return spark.createDataFrame([], "doc_id long, item_id long, start_token long, end_token long, containment double")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.distinct()


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
bs AS (SELECT item_id, array_to_string(w[p + 1:p + 4], ' ') AS k, len(w) - 3 AS width FROM (SELECT item_id, w, unnest(range(0, len(w) - 3)) AS p FROM b)),
bk AS (SELECT DISTINCT item_id, k, width FROM bs),
n AS (SELECT item_id, count(*) AS kinds FROM bk GROUP BY item_id),
ds AS (SELECT doc_id, p, len(w) AS words, array_to_string(w[p + 1:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS p FROM d)),
m AS (SELECT doc_id, item_id, p, words, ds.k, width FROM ds JOIN bk USING (k)),
s AS (SELECT x.doc_id, x.item_id, x.p, any_value(x.words) AS words, any_value(x.width) AS width, count(DISTINCT y.k) AS c
      FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND y.p >= x.p AND y.p < x.p + x.width GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c DESC, p) AS o FROM s JOIN n USING (item_id) WHERE c >= ceil(0.5 * kinds - 1e-9))
SELECT doc_id, item_id, p AS start_token, least(p + width + 3, words) AS end_token, c / kinds AS containment FROM r WHERE o = 1
"""
