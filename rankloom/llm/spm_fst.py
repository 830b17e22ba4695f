"""SentencePiece encoding as a weighted finite-state transducer, and decoding.

The model file is compiled to arc tables of three machines: the normaliser (states for the start, the text and its inner
white space; arcs by class of sign with their output), the pieces (a trie whose final states output a piece at the
weight of minus its score) and byte fallback (an arc for any sign without a piece, at more than the worst weight, which
outputs its bytes). A text is composed with them, and the least path in the tropical semiring gives its pieces.

Additive weights alone don't give a BPE model's merge order, so there the state of the composition holds the last piece
as well, and an arc after another exists only if the two stand side by side when merged by rank alone. A sequence is the
BPE result exactly if all its neighbours are such pairs, so at most one state of each place is reached.

Where no piece reaches over a place, such as the start of a run of white space marks, the composition splits; what is
between two such places is composed once, and remembered. New stretches of a batch of texts are composed together, place
by place, in arrays; the few long ones are searched depth first, longest arc first.
"""

from __future__ import annotations

import re
import struct
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Stretches, neighbours and arcs that are remembered, each, the longest stretch that is, and how many are composed at once.
CACHE, CACHE_CHARS, TOGETHER = 200_000, 48, 16_000
#: Characters that decide the arcs at a place, unless a longer piece may start there.
AHEAD = 7


class Bounded(dict):
    """A cache that is emptied when it is full."""

    def keep(self, key, value):
        if len(self) >= CACHE:
            self.clear()
        self[key] = value
        return value


def _fields(raw: bytes):
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


def _mixed_bits(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def _seen(keys: np.ndarray) -> np.ndarray:
    """A sieve of the keys: most that aren't among them fail it."""
    out = np.zeros(1 << 22, bool)
    out[_mixed_bits(keys)] = True
    return out


def _find(asked: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked keys are among the ascending keys, and where there."""
    some = np.flatnonzero(seen[_mixed_bits(asked)])
    at = np.minimum(np.searchsorted(keys, asked[some]), len(keys) - 1)
    hit = keys[at] == asked[some]
    return some[hit], at[hit]


class Transducer:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.fallback, self.dummy, self.squeeze, self.escape = UNIGRAM, False, True, True, True
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("unigram and BPE models only")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.weight = {p: -self.pieces[i][1] for p, i in self.ids.items()}
        order = {w: i for i, w in enumerate(sorted(set(self.weight.values())))}
        self.rank = {p: order[w] for p, w in self.weight.items()}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.trie = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.split = self._boundaries()
        self.byte_of = {i: b for b, i in self.bytes.items()}
        surface = [bytes([self.byte_of[i]]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else (p.replace(MARK, " ") if self.escape else p).encode() for i, (p, _, t) in enumerate(self.pieces)]
        surface.append(b"\xff")  # for ids outside the model
        self._bytes = np.frombuffer(b"".join(surface), np.uint8)
        self._sizes = np.array([len(x) for x in surface])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._worst = max(self.weight.values(), default=0.0) + 10
        self.normaliser = self._normaliser()
        self._compile()
        self._beside, self._known, self._near = Bounded(), Bounded(), Bounded()
        self._same = {p: p for p in self.ids}

    def _normaliser(self) -> dict[tuple[int, bool], tuple[int, str, bool]]:
        """(state, white space?) -> (state, output before the sign, whether the sign follows). 0: start, 1: text, 2: after
        white space in a text, where that is squeezed."""
        space, dummy = (MARK if self.escape else " "), (MARK if self.escape else " ") * self.dummy
        if self.squeeze:
            return {(0, True): (0, "", False), (0, False): (1, dummy, True), (1, True): (2, "", False), (1, False): (1, "", True), (2, True): (2, "", False), (2, False): (1, space, True)}
        return {(0, True): (1, dummy + space, False), (0, False): (1, dummy, True), (1, True): (1, space, False), (1, False): (1, "", True)}

    def _compile(self) -> None:
        """Arrays of the pieces machine: trie arcs by (state << 21 | sign), pieces of final states, weights; for BPE also
        each piece's halves and rank and what any two pieces merge to. The last id stands for signs without a piece."""
        names = list(self.ids)
        at = {p: i for i, p in enumerate(names)}
        self._other, self._piece_ids = len(names), np.array([self.ids[p] for p in names], np.int64)
        self._cost = np.array([*(self.weight[p] for p in names), self._worst])
        node, arcs, final = {"": 0}, {}, {}
        for p in names:
            for n in range(1, len(p) + 1):
                if p[:n] not in node:
                    node[p[:n]] = len(node)
                    arcs[node[p[: n - 1]] << 21 | ord(p[n - 1])] = node[p[:n]]
            final[node[p]] = at[p]
        self._arc_keys = np.array(sorted(arcs), np.int64)
        self._arc_seen = _seen(self._arc_keys)
        self._arc_to = np.array([arcs[k] for k in self._arc_keys.tolist()], np.int64)
        self._first = np.full(0x110000, -1, np.int32)
        self._first[[k for k in arcs if k < 1 << 21]] = [x for k, x in arcs.items() if k < 1 << 21]
        self._final = np.full(len(node), -1)
        self._final[list(final)] = list(final.values())
        self._longest = max(map(len, names), default=1)
        self._split: dict[str, tuple[str, ...]] = {}
        if self.kind != BPE:
            return
        self._left, self._right, self._rank, self._bad = (np.full(len(names) + 1, x) for x in (-1, -1, -1, False))
        merges = {}
        for i, p in enumerate(names):
            halves = self._halves(p)
            if not halves:
                self._bad[i] = True
            elif len(p) > 1:
                self._left[i], self._right[i], self._rank[i] = at.get(halves[0], self._other), at.get(halves[1], self._other), self.rank[p]
            for n in range(1, len(p)):
                if p[:n] in at and p[n:] in at:
                    merges[at[p[:n]] << 32 | at[p[n:]]] = self.rank[p]
        self._merge_keys = np.array(sorted(merges), np.int64)
        self._merge_seen = _seen(self._merge_keys)
        self._merge_rank = np.array([merges[k] for k in self._merge_keys.tolist()], np.int64)

    def _neighbours(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """_allowed for arrays of pieces; last is -1 at the start."""
        ok = ~self._bad[piece]
        live = np.flatnonzero(ok & (last >= 0))
        a, b = last[live], piece[live]
        limit = np.full(len(live), len(self.rank) + 1)
        while len(live):
            some, at = _find(a << 32 | b, self._merge_keys, self._merge_seen)
            some = some[self._merge_rank[at] < limit[some]]
            merge = np.zeros(len(live), bool)
            merge[some] = True
            ok[live[some]] = False
            ra, rb = self._rank[a], self._rank[b]
            on = ~merge & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self._right[a], a), np.where(first, b, self._left[b])
        return ok

    def shortest(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """Of each normalised, non-empty text the least cost in the composition with pieces and fallback, and the ends and
        numbers of the arcs on that path; a number beyond the pieces is the fallback's."""
        sizes = np.array([len(t) for t in texts])
        signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        offset = np.arange(len(signs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        room = np.repeat(sizes, sizes) - offset
        place = np.arange(len(signs)) + np.repeat(np.arange(len(texts)), sizes)  # a text has a place more than signs
        # compose: walk the trie from all places at once
        begin, end, what = [place], [place + 1], []
        live, state = np.arange(len(signs)), np.zeros(len(signs), np.int64)
        for n in range(1, self._longest + 1):
            if n == 1:
                to = self._first[signs]
                hit = to >= 0
                single = np.where(hit, self._final[to], -1)
                what.append(np.where(single < 0, self._other, single))
                live, state = live[hit], to[hit].astype(np.int64)
            else:
                hit, at = _find(state << 21 | signs[live + n - 1], self._arc_keys, self._arc_seen)
                live, state = live[hit], self._arc_to[at]
                done = self._final[state] >= 0
                begin.append(place[live[done]])
                end.append(place[live[done]] + n)
                what.append(self._final[state[done]])
            more = room[live] > n
            live, state = live[more], state[more]
            if not len(live):
                break
        begin, end, what = map(np.concatenate, (begin, end, what))
        # relax: places in order, all texts side by side; arcs from one place end at different ones
        where = np.zeros(len(signs) + len(texts), np.int64)
        where[place] = offset
        order = np.argsort(where[begin], kind="stable")
        begin, end, what = begin[order], end[order], what[order]
        cuts = np.searchsorted(where[begin], np.arange(sizes.max() + 1))
        cost, last, back = np.full(len(where), np.inf), np.full(len(where), -1), np.full(len(where), -1)
        starts = np.cumsum(sizes + 1) - sizes - 1
        cost[starts] = 0
        for x, y in zip(cuts[:-1], cuts[1:]):
            i, j, p = begin[x:y], end[x:y], what[x:y]
            c = cost[i] + self._cost[p]
            go = np.flatnonzero(c < cost[j])
            if self.kind == BPE and len(go):
                go = go[self._neighbours(last[i[go]], p[go])]
            cost[j[go]], last[j[go]], back[j[go]] = c[go], p[go], i[go]
        now = starts + sizes
        total, who, steps, ids, ends = cost[now], np.arange(len(texts)), [], [], []
        while len(who):
            steps.append(who)
            ids.append(last[now])
            ends.append(now - starts[who])
            now = back[now]
            on = now > starts[who]
            now, who = now[on], who[on]
        who, ids, ends = (np.concatenate(x[::-1]) for x in (steps, ids, ends))
        by = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[by], np.arange(len(texts) + 1)).tolist()
        ends, ids = ends[by].tolist(), ids[by].tolist()
        return total, [ends[a:b] for a, b in zip(cuts, cuts[1:])], [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _composed(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Piece ids of each stretch."""
        piece, other = self._piece_ids.tolist(), self._other
        out = []
        for text, ends, ids in zip(texts, *self.shortest(texts)[1:]):
            if other not in ids:
                out.append(tuple([piece[x] for x in ids]))
                continue
            own: list[int] = []
            for e, x in zip(ends, ids):
                more = [piece[x]] if x != other else self._symbols(text[e - 1 : e])
                if more[0] == self.unknown and own and own[-1] == self.unknown and not self.fallback:
                    continue
                own += more
            out.append(tuple(own))
        return out

    def _boundaries(self) -> re.Pattern:
        """Stretches between which no piece reaches: from a run of marks to the next; where no piece joins a Latin
        letter to a closing sign, words end there as well; control characters that are in no longer piece stand alone."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return re.compile("(?s).+")
        latin = "A-Za-z\u00c0-\u024f"
        longer = [p for p in self.ids if len(p) > 1]
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in longer))
        ends = "".join(re.escape(c) for c in ".,!?;:)\"%" if not any(re.search(f"[{latin}]{re.escape(c)}", p) for p in longer))
        if not alone or not ends:
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        return re.compile(f"{MARK}*[{latin}]+(?=[{MARK}{alone}{ends}]|\\Z)|[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the neighbours of the best score, leftmost first."""
        none, look = float("inf"), self.weight.get
        parts = list(text)
        costs = [look(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = look(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = look(parts[i - 1] + parts[i], none)
        return parts

    def _halves(self, piece: str) -> tuple[str, ...]:
        """The two parts whose merge makes the piece, just itself for a single character, nothing if merging can't make it."""
        found = self._split.get(piece)
        if found is None:
            parts = [piece]
            if len(piece) > 1:
                weight = self.weight.pop(piece, None)  # stop short of the last merge
                parts = self.merged(piece)
                if weight is not None:
                    self.weight[piece] = weight
            found = self._split[piece] = tuple(parts) if len(parts) < 3 else ()
        return found

    def _allowed(self, last: str, piece: str) -> bool:
        """Whether the pieces machine of a BPE model has an arc for the piece after the last one ('' at the start).

        Follows the parts that touch the border back in time: the two stay apart unless the parts on both sides, while
        they are there, merge before either side merges on.
        """
        halves, rank = self._halves, self.rank
        if not halves(last or piece) or not halves(piece):
            return False
        a, b, limit, forever = last, piece, len(rank) + 1, -1
        at_a, at_b = (rank[a] if len(a) > 1 else forever), (rank[b] if len(b) > 1 else forever)
        while last:
            r = rank.get(a + b)
            if r is not None and r < limit:
                break
            if at_a == at_b == forever:
                return self._beside.keep((self._same.get(last, last), self._same.get(piece, piece)), True)
            if at_a > at_b:
                limit = at_a
                a = halves(a)[1]
                at_a = rank[a] if len(a) > 1 else forever
            else:
                limit = at_b + 1
                b = halves(b)[0]
                at_b = rank[b] if len(b) > 1 else forever
        return self._beside.keep((self._same.get(last, last), self._same.get(piece, piece)), not last)

    def _arcs(self, text: str, i: int) -> list[int]:
        """Ends of the pieces that start at i, ascending; a character outside the pieces is an arc for byte fallback."""
        trie, weight, n = self.trie, self.weight, len(text)
        ends = [i + 1]
        if text[i] not in trie:
            return ends
        j = i + 2
        while j <= n:
            piece = text[i:j]
            if piece not in trie:
                break
            if piece in weight:
                ends.append(j)
            j += 1
        return ends

    def _lengths(self, text: str, i: int) -> tuple[int, ...]:
        """Lengths of the arcs at i, longest first; remembered by the characters ahead, which mostly decide them."""
        ahead = text[i : i + AHEAD]
        found = self._near.get(ahead)
        if found is None:
            own = () if len(ahead) == AHEAD and ahead in self.trie else tuple(j for j in reversed(self._arcs(ahead, 0)))
            found = self._near.keep(ahead, own)
        return found or tuple(j - i for j in reversed(self._arcs(text, i)))

    def path(self, text: str) -> list[str]:
        """Pieces on the shortest path of the composition with one normalised text, found alone."""
        return self._only_path(text) if self.kind == BPE else self._least_path(text)

    def _only_path(self, text: str) -> list[str]:
        """Depth first, longest arcs first: each position has one way to it, so a position left in vain stays dead."""
        n, beside, lengths = len(text), self._beside.get, self._lengths
        out: list[str] = []
        stack: list[tuple[int, str, tuple[int, ...], int]] = []
        dead: set[int] = set()
        i, last, arcs, k = 0, "", lengths(text, 0), 0
        while True:
            while k < len(arcs):
                j = i + arcs[k]
                k += 1
                if dead and j in dead:
                    continue
                piece = text[i:j]
                ok = beside((last, piece))
                if ok if ok is not None else self._allowed(last, piece):
                    out.append(piece)
                    if j == n:
                        return out
                    stack.append((i, last, arcs, k))
                    i, last, arcs, k = j, piece, lengths(text, j), 0
                    break
            else:
                dead.add(i)
                i, last, arcs, k = stack.pop()
                out.pop()

    def _least_path(self, text: str) -> list[str]:
        n, weight = len(text), self.weight
        cost: list[float] = [0.0] + [float("inf")] * n
        start = [0] * (n + 1)
        for i in range(n):
            for j in self._arcs(text, i):
                c = cost[i] + weight.get(text[i:j], self._worst)
                if c < cost[j]:
                    cost[j], start[j] = c, i
        out = []
        while n:
            out.append(text[start[n] : n])
            n = start[n]
        return out[::-1]

    def _symbols(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        if self.fallback:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def _stretch(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.path(text):
            ids = self._symbols(piece)
            if ids[0] == self.unknown and out and out[-1] == self.unknown and not self.fallback:
                continue
            out += ids
        return tuple(out)

    def normalised(self, text: str) -> str:
        """What the normaliser outputs for a text. Runs of one class go at once: their first sign takes an arc, and the
        arcs of the state after it loop."""
        arcs, state, out, at = self.normaliser, 0, [], 0
        if text and not self.squeeze:
            # after the first sign the machine stays in one state: one replacement
            state, before, _ = arcs[0, text[0] == " "]
            return before + (text[1:] if text[0] == " " else text).replace(" ", arcs[1, True][1])
        for m in re.finditer(" +|[^ ]+", text):
            run, blank = m.group(), text[m.start()] == " "
            state, before, same = arcs[state, blank]
            out.append(before + (run if same else ""))
        return "".join(out)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        known = self._known
        cut = [self.split.findall(self.normalised(t)) for t in texts]
        new = set().union(*cut).difference(known)
        short = sorted((p for p in new if len(p) <= CACHE_CHARS), key=len)
        for i in range(0, len(short), TOGETHER):
            known.update(zip(short[i : i + TOGETHER], self._composed(short[i : i + TOGETHER])))
        long = [p for p in new if len(p) > CACHE_CHARS]
        for p in long:
            known[p] = self._stretch(p)
        out = [np.fromiter(chain.from_iterable(map(known.__getitem__, parts)), np.int32) for parts in cut]
        for p in long:
            del known[p]
        if len(known) > CACHE:
            known.clear()
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces; bytes that aren't valid UTF-8 and ids outside the model become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.pieces)), ids, len(self.pieces))
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        text = self._bytes[np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(total)].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_machines: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _machines:
        with open(path, "rb") as f:
            _machines[path] = Transducer(f.read())
    return _machines[path]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, ids, decoded): the piece ids of each row's whole text and the text that these decode to.

    Row by row: repeated rows and null ids pass through. A null text gives nulls, an empty one no ids and "". A mark
    U+2581 in a text reads back as a space, as in any SentencePiece model; all else reads back as it was when the
    model keeps white space. Very long texts are encoded whole; an empty table gives no rows.
    """

    def flush(ids, arrays, texts):
        offsets, n = [], 0
        for a in arrays:
            offsets.append(None if a is None else n)
            n += 0 if a is None else len(a)
        values = pa.array(np.concatenate([a for a in arrays if a is not None] or [np.empty(0, np.int32)]), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    def run(batches):
        machine = transducer(model)
        for b in slices(batches):
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            at = 0
            while at < len(rows):
                to, size = at, 0
                while to < len(rows) and (to == at or size + len(rows[to][1] or "") <= batch_chars):
                    size += len(rows[to][1] or "")
                    to += 1
                part = rows[at:to]
                coded = iter(machine.encode_all([t for _, t in part if t is not None]))
                arrays = [None if t is None else next(coded) for _, t in part]
                yield flush([i for i, _ in part], arrays, [None if a is None else machine.decode(a) for a in arrays])
                at = to

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids; a null list gives null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        machine = transducer(model)
        return pd.Series([None if x is None else machine.decode(x) for x in ids], dtype=object)

    return rows.withColumn(out, text(F.col(ids_col)))
