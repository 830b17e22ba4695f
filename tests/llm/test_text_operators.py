"""Near-dedup, substring dedup, decontamination: brute force, planted cases and edge rows."""

from __future__ import annotations

import random
from collections import Counter
from math import ceil

import numpy as np
import pytest

from rankloom.llm import decontam, simhash, substring
from rankloom.llm.common import WORDS, RollingHash, WordHash


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edited(text: str, seed: int, share: float = 0.04) -> str:
    rng = random.Random(seed)
    return " ".join(f"new{rng.randint(0, 999)}" if rng.random() < share else w for w in text.split())


# ---- hashes ----


def test_rolling_hash_depends_on_the_window_only():
    h = RollingHash(4)
    a = np.arange(1, 9000, dtype=np.uint64)
    b = np.r_[np.uint64(77), a]
    assert (h.of(a) == h.of(b)[1:]).all() and len(h.of(a[:3])) == 0 and len(h.of(a[:4])) == 1
    assert len(np.unique(h.of(a))) == len(a) - 3
    assert WordHash().of("A b a")[0] == WordHash().of("a")[0]


# ---- SimHash ----


def brute_groups(texts: dict[int, str], tau: int = 11, tau_both: int = 28) -> set[tuple[int, int]]:
    ids = [i for i in sorted(texts) if WORDS.findall((texts[i] or "").lower())]
    at, one, two = simhash.fingerprint([texts[i] for i in ids])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            bits = int(one[x] ^ one[y]).bit_count()
            if bits <= tau and bits + int(two[x] ^ two[y]).bit_count() <= tau_both:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {(i, find(i)) for i in ids if find(i) != i}


def test_near_duplicates_match_brute_force(make, prose):
    texts = {i: prose(i, 150 + i) for i in range(40)}
    texts |= {100 + i: edited(texts[i % 5], i) for i in range(40)}
    texts |= {200 + i: texts[7] for i in range(30)}
    texts |= {300: "one", 301: "one", 302: "", 303: None, 304: "... !!!", 305: "word " * 30_000}
    got = set(rows(simhash.near_duplicates(make(list(texts.items())))))
    assert got == brute_groups(texts)
    assert {(i, 7) for i in range(200, 230)} <= got and (301, 300) in got
    assert sum(100 <= a < 140 and b < 5 for a, b in got) >= 39
    assert not {a for a, _ in got} & set(range(40))


def test_near_duplicates_ids_and_empty_tables(make, prose):
    a = prose(1, 90)
    got = rows(simhash.near_duplicates(make([(4, a), (2, a), (2, a), (None, a), (2, prose(2, 90)), (9, prose(2, 90))])))
    assert got == [(4, 2), (9, 2)]
    assert rows(simhash.near_duplicates(make([]))) == [] == rows(simhash.near_duplicates(make([(1, None)])))


@pytest.mark.parametrize("tau", [3, 6, 10])
def test_general_pigeonhole_misses_nothing(tau):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, tau + 4), replace=False)) for _ in range(300)], np.uint64)
    fp = np.r_[base, base ^ flips]
    parts, es, _ = simhash.plan(fp[:200], len(fp), tau)
    assert sorted(b for p in parts for b in p) == list(range(64)) and sum(es) == tau - len(parts) + 1 and min(es) >= -1
    order = np.array([b for p in parts for b in p])
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, order]
    moved = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").ravel().astype(np.uint64)
    table = np.stack([moved, np.zeros_like(moved), np.arange(len(fp), dtype=np.uint64)], axis=1)
    found, at = set(), 64
    for part, e in zip(parts, es):
        at -= len(part)
        if e < 0:
            continue
        end = at + len(part)
        for prefix in range(4):
            turned = simhash.rotated(table, end)
            index = turned[(turned[:, 0] >> np.uint64(62)) == prefix]
            a, b = simhash.match_block(index, turned, len(part), len(part) - 2, prefix, e, tau, 128)
            found |= set(zip(a.tolist(), b.tolist()))
    root = {i: i for i in range(len(fp))}
    for _ in range(8):
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= tau
    assert all(root[a] == root[b] for a, b in zip(*np.nonzero(near)))
    assert all(root[i] == root[i + 300] for i in range(300) if int(flips[i]).bit_count() <= tau)


@pytest.mark.parametrize("seed", range(6))
def test_hot_keys_lose_no_link_and_skip_known_groups(seed, monkeypatch):
    """Groups of near copies under one key, a chain of drifting ones, and strangers: the same groups as by all pairs."""
    rng = np.random.default_rng(seed)
    key, low, tau, tau_both = np.uint64(5), 12, 7, 16

    def flipped(x, most, places=48):
        return x ^ np.uint64(sum(1 << int(b) for b in rng.choice(places, rng.integers(0, most + 1), replace=False)))

    one, two = [], []
    for size, spread in ((700, 3), (500, 6), (150, 9)):
        a, b = (np.uint64(x) for x in rng.integers(0, 1 << 48, 2))
        one += [flipped(a, spread) for _ in range(size)]
        two += [flipped(b, spread) for _ in range(size)]
    a, b = (np.uint64(x) for x in rng.integers(0, 1 << 48, 2))
    for _ in range(200):
        a, b = flipped(a, 8), flipped(b, 10)
        one.append(a)
        two.append(b)
    one += rng.integers(0, 1 << 48, 300).astype(np.uint64).tolist()
    two += rng.integers(0, 1 << 48, 300).astype(np.uint64).tolist()
    fp = np.array(one, np.uint64) | (key << np.uint64(48))
    fp[::7] ^= np.uint64(1) << np.uint64(49)  # another key, one bit off
    table = np.stack([fp, np.array(two, np.uint64), rng.permutation(len(fp)).astype(np.uint64)], axis=1)
    done = []
    pairs = simhash._pairs
    monkeypatch.setattr(simhash, "_pairs", lambda index, key, probe, *rest: done.append(len(index) * len(probe)) or pairs(index, key, probe, *rest))

    def groups(edges):
        node, root = np.arange(len(fp)), np.concatenate(simhash._stars(*edges)).reshape(2, -1)
        node[root[1]] = root[0]
        return node.tolist()

    got = groups(simhash.match_block(table, table, 16, low, 0, 1, tau, tau_both))
    work, done[:] = sum(done), []
    monkeypatch.setattr(simhash, "HOT", 1 << 40)
    assert got == groups(simhash.match_block(table, table, 16, low, 0, 1, tau, tau_both))
    both = np.bitwise_count(fp[:, None] ^ fp[None]).astype(int)
    near = (both <= tau) & (both + np.bitwise_count(table[:, 1][:, None] ^ table[:, 1][None]) <= tau_both)
    label = np.array(got)[table[:, 2].astype(np.int64)]
    assert (label[:, None] == label[None])[near].all()
    assert work < sum(done)


def test_a_tight_hot_group_costs_its_size(monkeypatch):
    rng = np.random.default_rng(9)
    flips = np.array([sum(1 << int(b) for b in rng.choice(40, 2, replace=False)) for _ in range(3000)], np.uint64)
    table = np.stack([np.uint64(0xABC << 40) ^ flips, flips, np.arange(3000, dtype=np.uint64)], axis=1)
    done = []
    monkeypatch.setattr(simhash, "_pairs", lambda index, key, probe, *rest: done.append(len(index) * len(probe)) or [])
    a, b = simhash.match_block(table, table, 16, 16, 0, 0, 11, 28)
    assert sum(done) == 0 and set(a.tolist()) == {0} and len(set(b.tolist())) == 2999


def test_thresholds_are_allotted_by_cost():
    cost, es = simhash.allot([[0, 5, 50], [0, 1, 2], [0, 100, 1000]], 0)
    assert es == [0, 1, -1] and cost == 7


# ---- substrings ----


def brute_passages(texts: list[tuple[int, str]], width: int) -> list[tuple[int, int, int]]:
    tokens = [(i, WORDS.findall(t.lower())) for i, t in texts if t and i is not None]
    count = Counter(tuple(w[p : p + width]) for _, w in tokens for p in range(len(w) - width + 1))
    out = set()
    for i, w in tokens:
        at = [p for p in range(len(w) - width + 1) if count[tuple(w[p : p + width])] > 1]
        runs: list[list[int]] = []
        for p in at:
            if runs and p <= runs[-1][1]:
                runs[-1][1] = p + width
            else:
                runs.append([p, p + width])
        out |= {(i, a, b) for a, b in runs}
    return sorted(out)


def test_passages_match_brute_force(make, prose):
    shared = prose(99, 70)
    texts = [(i, prose(i, 120)) for i in range(12)]
    texts += [(20, f"{prose(30, 40)} {shared} {prose(31, 10)}"), (21, f"{shared.upper()}! {prose(32, 60)}"), (22, f"{prose(33, 5)} {shared}")]
    texts += [(40, prose(3, 120)), (41, "same " * 80), (42, "short"), (43, ""), (44, None), (None, shared), (45, prose(50, 49)), (46, prose(51, 50)), (46, prose(51, 50))]
    got = rows(substring.repeated_passages(make(texts)))
    assert got == brute_passages(texts, 50)
    assert (20, 40, 110) in got and (21, 0, 70) in got and (22, 5, 75) in got and (41, 0, 80) in got and (46, 0, 50) in got
    cut = dict(substring.without_passages(make(texts[12:15]), substring.repeated_passages(make(texts[12:15]))).select("doc_id", "text").collect())
    assert cut[20].split() == [*prose(30, 40).split(), *prose(31, 10).split()]


def test_passages_over_batches_and_long_texts(make, prose, monkeypatch):
    monkeypatch.setattr(substring, "BATCH", 200)
    long = prose(7, 30_000)
    texts = [(1, long), (2, f"x {long[: len(long) // 2]}"), *[(10 + i, prose(100 + i, 60)) for i in range(20)]]
    assert rows(substring.repeated_passages(make(texts), width=20)) == brute_passages(texts, 20)
    assert rows(substring.repeated_passages(make([]))) == [] == rows(substring.repeated_passages(make([(1, None)])))


def test_hot_passages_go_out_once_a_batch(make, prose):
    hot = prose(5, 60)
    texts = [(i, f"{hot} {prose(100 + i, 30)} {hot}") for i in range(50)] + [(90, hot)]
    assert rows(substring.repeated_passages(make(texts))) == brute_passages(texts, 50)
    sent = list(substring._rows([1, 2], [np.array([5, 7, 5, 9], np.uint64), np.array([5, 9, 11], np.uint64)], 1))[0].to_pydict()
    assert substring.values(sent["hashes"][1], np.uint64).tolist() == [7, 11] and substring.values(sent["more"][1], np.uint64).tolist() == [5, 9]
    assert substring.values(sent["more"][0], np.uint64).tolist() == [0, 2, 3, 4, 5]


def test_cuts_in_texts_that_lower_case_lengthens(spark, make, prose):
    text = f"İİ İz a {prose(1, 60)} İ end"
    low = WORDS.findall(text.lower())
    at = [text[a:b].lower().replace("\u0307", "") for a, b in substring.token_spans(text)]
    assert at == low and len(low) == 67
    docs = make([(1, text), (None, "x y"), (2, None)]).withColumnsRenamed({"g": "_cut_id", "fp": "_cuts"})
    spans = spark.createDataFrame([(1, low.index("a"), low.index("end"))], "doc_id long, start_token long, end_token long")
    out = substring.without_passages(docs, spans)
    assert out.columns == docs.columns and out.count() == 3
    assert out.where("doc_id = 1").first()["text"].endswith(" end") and "a" not in out.where("doc_id = 1").first()["text"].split()


def test_byte_planes():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (substring.values(substring.planes(x), np.uint64) == x).all()
    assert (substring.unpacked(substring.packed(x[::-1].copy()), np.uint64) == x[::-1]).all()


# ---- decontamination ----


def brute_leaks(texts, items, n=4, threshold=0.5):
    out = set()
    for item, text in items:
        w = WORDS.findall((text or "").lower())
        if not w or item is None:
            continue
        size = min(n, len(w))
        need = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)}
        width = len(w) - size + 1
        for i, t in texts:
            d = WORDS.findall((t or "").lower())
            if i is None:
                continue
            sh = [tuple(d[p : p + size]) for p in range(len(d) - size + 1)]
            best, at = 0, -1
            for s, x in enumerate(sh):
                if x in need:
                    c = len(set(sh[s : s + width]) & need)
                    if c > best:
                        best, at = c, s
            if best >= ceil(threshold * len(need) - 1e-9) and best:
                out.add((i, item, at, min(at + width + size - 1, len(d)), best / len(need)))
    return sorted(out)


def test_leaks_match_brute_force(spark, make, prose):
    items = [(i, prose(500 + i, 15 + 3 * i)) for i in range(12)] + [(50, "tiny words"), (51, ""), (52, None), (None, prose(9, 20)), (53, prose(500, 15)), (54, "alone")]
    texts = [(i, prose(i, 150)) for i in range(15)]
    texts += [(30 + i, f"{prose(60 + i, 40)} {edited(items[i][1], i, 0.03)} {prose(80 + i, 30)}") for i in range(12)]
    texts += [(50, items[4][1].upper()), (51, "has tiny words inside"), (52, ""), (53, None), (None, items[3][1]), (54, " ".join(items[5][1].split()[:6])), (55, "a alone b " * 4000), (50, items[4][1].upper())]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = rows(decontam.contaminated(make(texts), bench))
    want = brute_leaks(texts, items)
    assert [g[:4] for g in got] == [w[:4] for w in want] and all(abs(g[4] - w[4]) < 1e-12 for g, w in zip(got, want))
    assert {30 + i for i in range(12)} <= {g[0] for g in got}
    several = rows(decontam.contaminated(make(texts), bench, pass_bytes=200))
    assert [g[:4] for g in several] == [g[:4] for g in got]
    assert rows(decontam.contaminated(make([]), bench)) == [] == rows(decontam.contaminated(make(texts), bench.where("item_id > 99")))
