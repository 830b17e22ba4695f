"""Near-duplicate groups: 64-bit SimHash searched by the general pigeonhole principle with allotted thresholds.

Fingerprints: the sign of the bit sums over a document's distinct words, and a second one over its distinct word pairs.
Two documents match if the first differ in at most `tau` bits and both together, which verifies, in at most `tau_both`.

Search: bits are reordered so that correlated ones share a partition. Thresholds e_i >= -1 with sum tau - m + 1 leave
out no pair within tau; dynamic programming picks those of the least estimated probes and candidates, and the number
of partitions m as well. The estimates come from a bounded sample; they decide the cost, never the result. A
fingerprint goes to the reducers (i, prefix) whose key prefix lies within e_i of its own; there keys within the
remaining radius are probed and candidates verified on all bits. Reducers pass on spanning stars, not all pairs. Where many
rows share a key, some of them are compared with all rows first: what they match is known to be one group, and no pair
inside it is looked at again, so that a hot group costs its size rather than its square.
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, cut, id_text, map_arrow, mixed, slices, word_hash
from .components import components

BITS = 64
#: Fingerprints that the cost estimates look at.
SAMPLE = 2000
#: Fingerprints of one partition that one reducer indexes, about.
PER_REDUCER = 32_768
#: Bits by which the reducers of a partition are told apart at most; each costs copies of the probes.
MOST_PREFIX = 14
#: Rows of one key from which on a reducer groups by pivots first, these a round, and the rounds; they decide the cost,
#: never the result.
HOT, PIVOTS, ROUNDS = 64, 16, 2


def _signs(hashes: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each array of hashes; none may be empty."""
    sizes = np.array([len(h) for h in hashes])
    out, at = [], 0
    while at < len(hashes):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 250_000)))
        flat = np.concatenate(hashes[at:to])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.r_[0, np.cumsum(sizes[at:to])[:-1]]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * sums > sizes[at:to, None], axis=1).view(np.uint64).ravel())
        at = to
    return np.concatenate(out)


def fingerprint(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the texts that have a word, and their two fingerprints."""
    pairs_of = RollingHash(2)
    at, one, two = [], [], []
    for i, text in enumerate(texts):
        tokens = word_hash.of(text or "")
        if len(tokens):
            at.append(i)
            one.append(mixed(np.unique(tokens)))
            two.append(np.unique(pairs_of.of(tokens)) if len(tokens) > 1 else one[-1])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.array(at), _signs(one), _signs(two)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, fp2); rows without an id, or whose text is null or has no word, have none."""

    def run(batches):
        for b in slices(batches):
            at, one, two = fingerprint(b.column(1).to_pylist())
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "fp", "fp2"])

    return map_arrow(id_text(docs, id_col, text_col).where("id is not null"), run, "id long, fp long, fp2 long")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the bit positions, correlated bits together: each grows from the strongest pair left."""
    c = np.zeros((BITS, BITS))
    if len(bits) > 2:
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.abs(np.nan_to_num(np.corrcoef(bits.astype(float).T), nan=0.0))
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        ids = sorted(left)
        if m - k == 1:
            parts.append(ids)
            break
        sub = c[np.ix_(ids, ids)] - 2 * np.eye(len(ids))
        own = [ids[x] for x in np.unravel_index(np.argmax(sub), sub.shape)][:size]
        while len(own) < size:
            rest = [x for x in ids if x not in own]
            own.append(rest[int(np.argmax(c[np.ix_(rest, own)].sum(axis=1)))])
        parts.append(sorted(own))
        left -= set(own)
    return parts


def _near(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """Estimated share of pairs within e differences on the partition, for each e."""
    p = bits[:, part].mean(axis=0) if len(bits) else np.full(len(part), 0.5)
    model = np.array([1.0])
    for q in 2 * p * (1 - p):
        model = np.convolve(model, [1 - q, q])
    if len(bits) > 1:
        x = bits[:, part].astype(np.float32)
        d = np.rint(x @ (1 - x).T + (1 - x) @ x.T).astype(int)[np.triu_indices(len(x), 1)]
        seen = np.bincount(d, minlength=len(part) + 1) / len(d)
        model = np.maximum(model, seen)
    return np.minimum(np.cumsum(model), 1)


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least sum of costs[i][e_i + 1] with e_i >= -1 and sum of e_i = total, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, es) in best.items():
            for e, x in enumerate(row, -1):
                if s + e not in nxt or c + x < nxt[s + e][0]:
                    nxt[s + e] = (c + x, [*es, e])
        best = nxt
    return best[total]


def plan(sample: np.ndarray, n: int, tau: int) -> tuple[list[list[int]], list[int], float]:
    """Partitions, thresholds and the estimated cost a fingerprint, for n fingerprints of which sample are some."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) if len(sample) else np.zeros((0, BITS), np.uint8)
    found = []
    for m in range(3, min(8, tau + 1) + 1):
        parts = group_bits(bits, m)
        costs = []
        for part in parts:
            near = _near(bits, part)
            probes = np.cumsum([comb(len(part), e) for e in range(len(part) + 1)])
            costs.append([0.0, *(probes[e] + n * near[e] for e in range(min(tau, len(part) - 1) + 1))])
        try:
            cost, es = allot(costs, tau - m + 1)
        except KeyError:
            continue
        found.append((cost, parts, es))
    cost, parts, es = min(found, key=lambda x: x[0])
    return parts, es, cost


def _masks(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for e in range(min(width, most) + 1) for c in combinations(range(width), e)], np.uint64)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least, member) that join the same nodes as the pairs do."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (old == label).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def rotated(rows: np.ndarray, end: int) -> np.ndarray:
    """The rows with the fingerprint's bits below `end` at the top."""
    turn = np.uint64((BITS - end) % BITS)
    x = rows[:, 0]
    return np.concatenate([((x << turn) | (x >> (np.uint64(BITS - 1) - turn) >> np.uint64(1)))[:, None], rows[:, 1:]], axis=1)


def hot_groups(index: np.ndarray, probe: np.ndarray, key: np.ndarray, tau: int, tau_both: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For index and probe rows a group or -1, and verified pairs of ids that join all rows of one group.

    key: those of the index rows, ascending. Pivots are taken in even steps from the rows of keys that HOT rows share.
    """
    rows = np.concatenate([index, probe])
    n, hits, pivots = len(index), np.zeros((len(rows), 0), bool), np.empty(0, np.int64)
    for _ in range(ROUNDS):
        left = np.flatnonzero(~hits[:n].any(axis=1))
        _, at, count = np.unique(key[left], return_inverse=True, return_counts=True)
        hot = left[count[at] >= HOT]
        if not len(hot):
            break
        more = np.unique(hot[np.linspace(0, len(hot) - 1, PIVOTS).astype(np.int64)])
        found = np.zeros((len(rows), len(more)), bool)
        for j, p in enumerate(more.tolist()):
            bits = np.bitwise_count(rows[:, 0] ^ rows[p, 0])
            near = np.flatnonzero(bits <= tau)
            found[near, j] = bits[near] + np.bitwise_count(rows[near, 1] ^ rows[p, 1]) <= tau_both
        hits, pivots = np.concatenate([hits, found], axis=1), np.r_[pivots, more]
    group = np.full(len(rows), -1)
    if not len(pivots):
        return group[:n], group[n:], []
    # pivots that one row matches are of one group
    shared = hits.astype(np.float32)
    label, joined = np.arange(len(pivots)), shared.T @ shared > 0
    while True:
        low = np.where(joined, label[None], len(pivots)).min(axis=1)
        if (low == label).all():
            break
        label = low
    own = hits.any(axis=1)
    group[own] = label[hits[own].argmax(axis=1)]
    ids = rows[:, 2].view(np.int64)
    some, j = np.nonzero(hits)
    stars = _stars(ids[pivots[j]], ids[some])
    small = np.bincount(group[:n][group[:n] >= 0], minlength=len(pivots)) < HOT
    group[own] = np.where(small[group[own]], -1, group[own])
    return group[:n], group[n:], [stars]


def match_block(index: np.ndarray, probe: np.ndarray, width: int, low: int, prefix: int, e: int, tau: int, tau_both: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the verified pairs of ids between index and probe rows (fp, fp2, id), keys within e of one another, and
    over those that pivots match.

    A key is the top `width` bits: a prefix, which all index rows share, and `low` bits below it.
    """
    mask = np.uint64((1 << low) - 1)
    key = (index[:, 0] >> np.uint64(BITS - width)) & mask
    order = np.argsort(key, kind="stable")
    index, key = index[order], key[order].astype(np.int64)
    if len(key) < HOT or np.bincount(key).max() < HOT:
        out = _pairs(index, key, probe, width, low, prefix, e, tau, tau_both)
    else:
        mine, theirs, out = hot_groups(index, probe, key, tau, tau_both)
        for g in np.unique(theirs).tolist():
            other = mine != g if g >= 0 else np.ones(len(mine), bool)
            out += _pairs(index[other], key[other], probe[theirs == g], width, low, prefix, e, tau, tau_both)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _stars(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))


def _pairs(index: np.ndarray, key: np.ndarray, probe: np.ndarray, width: int, low: int, prefix: int, e: int, tau: int, tau_both: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars over all verified pairs; index rows ascend by their keys."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(index):
        return out
    shift, mask = BITS - width, np.uint64((1 << low) - 1)
    table = np.r_[0, np.cumsum(np.bincount(key, minlength=1 << low))]
    own = probe[:, 0] >> np.uint64(shift)
    far = np.bitwise_count((own >> np.uint64(low)) ^ np.uint64(prefix)).astype(int)
    for d in range(e + 1):
        some = probe[far == d]
        if not len(some):
            continue
        target = (some[:, 0] >> np.uint64(shift)) & mask
        for x in _masks(low, e - d):
            t = (target ^ x).astype(np.int64)
            start, count = table[t], table[t + 1] - table[t]
            hit = np.flatnonzero(count)
            at = 0
            while at < len(hit):
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(count[hit[at:]]), 2_000_000)))
                q = hit[at:to]
                n = count[q]
                rows = np.repeat(start[q] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                a, b = some[np.repeat(q, n)], index[rows]
                bits = np.bitwise_count(a[:, 0] ^ b[:, 0])
                ok = (bits <= tau) & (a[:, 2] != b[:, 2])
                a, b, bits = a[ok], b[ok], bits[ok]
                ok = bits + np.bitwise_count(a[:, 1] ^ b[:, 1]) <= tau_both
                if ok.any():
                    out.append(_stars(a[ok, 2].view(np.int64), b[ok, 2].view(np.int64)))
                at = to
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 11, tau_both: int = 28) -> DataFrame:
    """(doc_id, kept_doc_id): each document that is a copy, and the least id of its group, which stays.

    Groups are the connected components of the matches. Null or wordless texts and null ids are in no group; an id on
    several rows is one document, in the groups of all its rows, and never its own copy. Very long texts are read whole;
    equal fingerprints tie at distance 0 and are one class, searched once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    marks = cut(fingerprints(docs, id_col, text_col))
    reps = cut(marks.groupBy("fp", "fp2").agg(F.min("id").alias("rep")))
    n = reps.count()
    sample = np.array([r[0] for r in reps.select("fp").orderBy(F.xxhash64("fp", "fp2"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts, es, _ = plan(sample, n, tau)
    order = np.array([b for part in parts for b in part])
    p = max(0, min(MOST_PREFIX, int(np.ceil(np.log2(max(1, n / PER_REDUCER))))))
    spans, at = [], BITS
    for part, e in zip(parts, es):
        at -= len(part)
        if e >= 0:
            spans.append((at, len(part), e))

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(raw.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, order]
            fp = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").ravel().astype(np.uint64)
            rest = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (1, 2)]
            rows = np.stack([fp, *rest], axis=1)
            got: list[tuple[int, bool, bytes]] = []
            for i, (shift, width, e) in enumerate(spans):
                prefix = (fp >> np.uint64(shift + width - p)) & np.uint64((1 << p) - 1)
                for indexed, reach in ((True, np.zeros(1, np.uint64)), (False, _masks(p, e))):
                    target = (prefix[:, None] ^ reach[None]).ravel()
                    by = np.argsort(target, kind="stable")
                    ends = np.r_[np.flatnonzero(np.diff(target[by])) + 1, len(by)]
                    for x, y in zip(np.r_[0, ends[:-1]], ends):
                        got.append((i << 32 | int(target[by[x]]), indexed, rows[by[x:y] // len(reach)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got], pa.binary())], ["g", "indexed", "rows"])

    def search(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        i, v = int(key[0]) >> 32, int(key[0]) & 0xFFFFFFFF
        shift, width, e = spans[i]
        take = lambda flag: np.frombuffer(b"".join(pdf["rows"][pdf["indexed"] == flag]), np.uint64).reshape(-1, 3)
        index = take(True)
        if not len(index):
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        probe = take(False)
        a, b = match_block(rotated(index, shift + width), rotated(probe, shift + width), width, width - p, v, e, tau, tau_both)
        return pd.DataFrame({"src": a, "dst": b})

    blobs = map_arrow(reps, route, "g long, indexed boolean, rows binary")
    # an explicit number of partitions: sizes in bytes would bring reducers of much work together
    reducers = min(4000, 2 * max(1, len(spans)) << p)
    edges = blobs.repartition(reducers, "g").groupBy("g").applyInPandas(search, "src long, dst long")
    # the same id under several fingerprints joins their groups
    twice = marks.join(reps, ["fp", "fp2"]).select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    roots = components(edges.union(twice))
    return roots.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))
