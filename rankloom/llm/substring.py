"""Exact repeated passages: Rabin-Karp hashes of every window of `width` tokens, counted in Spark, merged into intervals.

Executors hash batches of whole documents and send each hash, with the window's place in its batch, to the partition
that owns the hash's range: sorted, as differences in byte planes, about nine bytes a window on the wire. A window that
a batch holds several times is repeated whatever the others hold: its hash goes out once and without places, so that a
hot passage costs an owner one hash a batch. The owner counts and answers every batch with the places of its repeated
windows, which then merge to intervals per document. A batch is named after its documents, so a task that is run again
names it alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, RollingHash, id_text, map_arrow, slices, word_hash

WIDTH = 50
#: Windows that are hashed before they are sent on; a longer document makes a longer batch.
BATCH = 1 << 20
#: Windows that one counting group holds, about.
PER_GROUP = 500_000
#: Characters a token takes at least on average, to size the groups; too few or too many only shifts the work.
CHARS = 5


def planes(x: np.ndarray) -> bytes:
    """Ascending values as byte planes of their differences; planes that are all zero compress to nothing."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def values(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel(), dtype=dtype)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def unpacked(raw: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _rows(ids: list[int], hashes: list[np.ndarray], groups: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes)
    head = np.concatenate([np.array(ids, np.int64), sizes]).tobytes()
    name = xxhash.xxh64_intdigest(head + flat[:: max(1, len(flat) // 1000)].tobytes()) >> 1
    order = np.argsort(flat, kind="stable")
    flat, order = flat[order], order.astype(np.uint32 if len(order) < 1 << 32 else np.uint64)
    same = flat[1:] == flat[:-1]
    twice = np.r_[False, same] | np.r_[same, False]
    sure = np.sort(order[twice]).astype(np.uint64)
    single, places = flat[~twice], order[~twice]
    known = flat[twice & ~np.r_[False, same]]
    g, h, at, more = [int(name % groups)], [None], [head], [planes(sure)]
    owners = [((x >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32) for x in (single, known)]
    for owner in np.union1d(*owners).tolist():
        (a, b), (c, d) = (np.searchsorted(x, np.array([owner, owner + 1], np.uint64)) for x in owners)
        g.append(owner)
        h.append(planes(single[a:b]))
        at.append(packed(places[a:b]))
        more.append(planes(known[c:d]))
    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array([name] * len(g), pa.int64()), *(pa.array(x, pa.binary()) for x in (h, at, more))], ["g", "batch", "hashes", "places", "more"])


def _dtype(raw: bytes, n: int) -> type:
    return np.uint32 if len(raw) == 4 * n else np.uint64


def _hashed(groups: int, width: int):
    def run(batches):
        rolling = RollingHash(width)
        ids: list[int] = []
        hashes: list[np.ndarray] = []
        n = 0
        for b in slices(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = rolling.of(word_hash.of(text))
                if len(h):
                    ids.append(i)
                    hashes.append(h)
                    n += len(h)
                if n >= BATCH:
                    yield from _rows(ids, hashes, groups)
                    ids, hashes, n = [], [], 0
        if ids:
            yield from _rows(ids, hashes, groups)

    return run


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    heads = pdf[pdf["hashes"].isna()]
    rows = pdf[pdf["hashes"].notna()]
    out = [pd.DataFrame({"batch": heads["batch"], "head": heads["places"], "places": heads["more"]})]
    if len(rows):
        hs = [values(x, np.uint64) for x in rows["hashes"]]
        sizes = np.array([len(h) for h in hs])
        n = int(sizes.sum())
        every = np.concatenate([*hs, *(values(x, np.uint64) for x in rows["more"])])
        order = np.argsort(every, kind="stable")
        same = every[order]
        same = same[1:] == same[:-1]
        again = np.zeros(len(every), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again = again[:n]
        ends = np.cumsum(sizes)
        names, found = [], []
        for name, raw, a, b in zip(rows["batch"], rows["places"], ends - sizes, ends):
            if again[a:b].any():
                names.append(name)
                found.append(np.sort(unpacked(raw, _dtype(raw, b - a))[again[a:b]].astype(np.uint64)).tobytes())
        out.append(pd.DataFrame({"batch": names, "head": None, "places": [planes(np.frombuffer(x, np.uint64)) for x in found]}))
    return pd.concat(out, ignore_index=True).astype({"batch": "int64"})


def _merged(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf["head"].dropna()
        some = pdf["places"].dropna()
        if not some.map(len).any():
            return pd.DataFrame({"doc_id": [], "start_token": [], "end_token": []}, dtype="int64")
        if not len(heads):
            raise RuntimeError("a batch was not hashed alike twice: write the input to a table first")
        head = np.frombuffer(heads.iloc[0], np.int64).reshape(2, -1)
        ends = np.cumsum(head[1])
        at = np.unique(np.concatenate([values(x, np.uint64) for x in some])).astype(np.int64)
        doc = np.searchsorted(ends, at, side="right")
        pos = at - (ends - head[1])[doc]
        first = np.r_[True, (np.diff(doc) != 0) | (np.diff(pos) > width)]
        last = np.r_[first[1:], True]
        return pd.DataFrame({"doc_id": head[0][doc[first]], "start_token": pos[first], "end_token": pos[last] + width})

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, start_token, end_token): maximal intervals of tokens, end exclusive, covered by repeated windows.

    A window is repeated if the same `width` tokens occur at two places or more, in one document or several; each
    occurrence counts, so all copies are listed and the caller decides which stays. Windows that overlap or touch
    merge. Null or shorter texts and null ids have no windows; a doc_id on several rows gives the intervals of each,
    equal ones once; very long texts are hashed whole. An empty table gives no rows. Input that isn't read in the same order twice is to be written first.
    """
    base = id_text(docs, id_col, text_col, ordered=True).where("id is not null and text is not null")
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-chars // (CHARS * PER_GROUP)))
    sent = map_arrow(base, _hashed(groups, width), "g int, batch long, hashes binary, places binary, more binary")
    answers = sent.groupBy("g").applyInPandas(_counted, "batch long, head binary, places binary")
    return answers.groupBy("batch").applyInPandas(_merged(width), "doc_id long, start_token long, end_token long").distinct()


def token_spans(text: str) -> list[tuple[int, int]]:
    """Where the tokens of the lower-cased text stand in the text itself, whose characters may be fewer."""
    low = text.lower()
    spans = [m.span() for m in WORDS.finditer(low)]
    if len(low) == len(text):
        return spans
    ends = np.cumsum([len(c.lower()) for c in text])
    return [(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b)) + 1) for a, b in spans]


def without_passages(docs: DataFrame, intervals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the tokens of the given intervals cut from the text; what stands between two cuts stays as it is.

    All columns stay, whatever their names; null ids and texts have nothing cut.
    """
    cuts = intervals.groupBy(F.col("doc_id").alias("i")).agg(F.sort_array(F.collect_list(F.struct("start_token", "end_token"))).alias("s"))

    @F.pandas_udf("string")
    def cut_text(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            if text is not None and own is not None and len(own):
                words = token_spans(text)
                parts, at = [], 0
                for s in own:
                    a, b = int(s["start_token"]), min(int(s["end_token"]), len(words))
                    if a < b:
                        parts.append(text[at : words[a][0]])
                        at = words[b - 1][1]
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), docs[id_col].try_cast("long").alias("k"))
    joined = rows.join(cuts, F.col("k") == F.col("i"), "left")
    text = F.when(F.col("s").isNull(), F.col(f"r.`{text_col}`")).otherwise(cut_text(F.col(f"r.`{text_col}`"), F.col("s")))
    return joined.select(*[(text if c == text_col else F.col(f"r.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS p, w FROM t WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS k FROM win),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g)
SELECT doc_id, min(p) AS start_token, max(p) + 50 AS end_token FROM i GROUP BY doc_id, n
"""
