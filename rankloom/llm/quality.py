"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade <= j) = sigmoid(theta_j - w.x) with one weight vector for all grades and ordered thresholds. x marks the
hashed features of the whole text: its distinct words, their beginnings and the steps its style rates fall on.
Features are picked by an L1 penalty. Expected grade and the tail P(grade >= least) follow; selection takes rows
whose tail reaches `cutoff`. Fitting looks at about `max_train` labelled rows, chosen by hashed id; scoring at all.
Very long texts count whole; equal texts score equally, and a tail that just reaches the cutoff is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, id_text, map_arrow, slices, stable_fraction

BUCKETS = 1 << 20
#: Lengths of the beginnings of words that are features.
PREFIXES = (3, 4, 5, 6, 7)
#: Labelled rows that fitting looks at, about; a bound on the model's data, not on what is scored.
MAX_TRAIN = 20_000
#: Sampled rows up to which they are sent to every executor; more are joined by shuffle.
SENT_ROWS = 200_000
#: Least P(grade >= least) of what is kept. Texts with nothing against them score well above it.
CUTOFF = 0.6


class Features(dict):
    """word -> buckets of the word and of its beginnings, remembered; `only`: None, or which buckets matter."""

    def __init__(self, only: np.ndarray | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 80_000:
            self.clear()
        names = [word, *(f"{word[:n]} *" for n in PREFIXES if n < len(word))]
        own = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) % BUCKETS for x in names]
        found = self[word] = tuple(own) if self.only is None else tuple(x for x in own if self.only[x])
        return found


def style(text: str, words: list[str], distinct: int) -> list[str]:
    """Names of the steps that the text's rates fall on; no word contains a space, so these clash with none."""
    raw = text.split()
    n = max(1, len(raw))
    shouted = sum(map(str.isupper, raw)) / n
    marks = 1 - sum(map(len, words)) / max(1, sum(map(len, raw)))
    size = min(16, len(words).bit_length())
    rates = {"upper": shouted, "marks": marks, "again": 1 - distinct / max(1, len(words)), "wordless": 1 - min(1.0, len(words) / n)}
    out = [f" {k} {int(v * 10)}" for k, v in rates.items()]
    return [*out, f" size {size}", f" again {int(rates['again'] * 10)} {size}"]


def features(text: str, buckets: Features) -> list[int] | None:
    """Distinct buckets of a text; None if it has no word."""
    words = WORDS.findall(text.lower())
    if not words:
        return None
    distinct = set(words)
    names = chain(distinct, style(text, words, len(distinct)))
    return list(set(chain.from_iterable(map(buckets.__getitem__, names))))


@dataclass(frozen=True)
class Model:
    """Weights by bucket and ascending thresholds; grades 0..len(theta)."""

    weights: np.ndarray
    theta: np.ndarray

    def tails(self, score: float) -> list[float]:
        """P(grade >= j) for j = 1.."""
        return [1 / (1 + exp(min(60.0, max(-60.0, t - score)))) for t in self.theta.tolist()]


class Rows:
    """Distinct buckets of each row, laid end to end; worked through in stretches, so that no copy of all is made."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, stretch: int = 2_000_000):
        self.flat, self.sizes, self.n = flat, sizes, len(sizes)
        ends = np.r_[0, np.cumsum(sizes)]
        rows, self.parts = 0, []
        while rows < self.n:
            to = max(rows + 1, int(np.searchsorted(ends, ends[rows] + stretch, side="right")) - 1)
            self.parts.append((rows, to, int(ends[rows]), int(ends[to])))
            rows = to

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each bucket the sum of the values of the rows that hold it."""
        out = np.zeros(BUCKETS)
        for r0, r1, a, b in self.parts:
            out += np.bincount(self.flat[a:b], np.repeat(values[r0:r1], self.sizes[r0:r1]), minlength=BUCKETS)
        return out

    def holders(self, buckets: np.ndarray) -> list[np.ndarray]:
        """For each of the buckets the rows that hold it."""
        at = np.full(BUCKETS, -1, np.int32)
        at[buckets] = np.arange(len(buckets))
        rows, which = [], []
        for r0, r1, a, b in self.parts:
            own = at[self.flat[a:b]]
            hit = np.flatnonzero(own >= 0)
            which.append(own[hit])
            rows.append(np.repeat(np.arange(r0, r1, dtype=np.int32), self.sizes[r0:r1])[hit])
        which, rows = np.concatenate(which), np.concatenate(rows)
        by = np.argsort(which, kind="stable")
        return np.split(rows[by], np.searchsorted(which[by], np.arange(1, len(buckets))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def derivatives(score: np.ndarray, grades: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's negative log likelihood: the value, its slope and expected curvature in the score; and the cumulative
    probabilities' slopes by threshold."""
    n = len(grades)
    c = _sigmoid(np.r_[-np.inf, theta, np.inf][None] - score[:, None])
    c[:, 0], c[:, -1] = 0, 1
    p = np.maximum(np.diff(c, axis=1), 1e-12)
    d = c * (1 - c)
    own = p[np.arange(n), grades]
    slope = (d[np.arange(n), grades + 1] - d[np.arange(n), grades]) / own
    return -np.log(own), slope, (np.diff(d, axis=1) ** 2 / p).sum(axis=1), d / np.c_[own, own[:, None] * np.ones(d.shape[1] - 1)]


def _thresholds(score: np.ndarray, grades: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """A Newton step for the thresholds, of bounded length, halved until it helps and keeps their order."""
    k = len(theta)
    value, _, _, d = derivatives(score, grades, theta)
    slope = np.array([d[grades == j + 1, j + 1].sum() - d[grades == j, j + 1].sum() for j in range(k)])
    curve = np.array([(d[(grades == j) | (grades == j + 1), j + 1] ** 2).sum() for j in range(k)]) + 1e-9
    step, size = np.clip(slope / curve, -2, 2), 1.0
    while size > 1e-4:
        moved = np.clip(theta - size * step, -30, 30)
        if (np.diff(moved) > 0).all() and derivatives(score, grades, moved)[0].sum() < value.sum():
            return moved
        size /= 2
    return theta


def _solved(holders: list[np.ndarray], grades: np.ndarray, w: np.ndarray, theta: np.ndarray, l1: float, l2: float, rounds: int = 60, sweeps: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, thresholds and scores of the least mean loss plus penalties: quadratic models of the loss, each worked off
    feature by feature, and Newton steps for the thresholds in between."""
    n = len(grades)
    w = w.copy()
    score = np.zeros(n)
    for own, x in zip(holders, w):
        if x:
            score[own] += x
    loss = lambda score, w, theta: derivatives(score, grades, theta)[0].mean() + l1 * np.abs(w).sum() + l2 / 2 * (w @ w)
    now = loss(score, w, theta)
    for _ in range(rounds):
        before = now
        for _ in range(2):
            theta = _thresholds(score, grades, theta)
        now = loss(score, w, theta)
        _, slope, curve, _ = derivatives(score, grades, theta)
        bend = np.array([curve[own].sum() for own in holders]) / n + l2 + 1e-9
        new, moved = w.copy(), np.zeros(n)
        for sweep in range(sweeps):
            most = 0.0
            for j in range(len(w)) if not sweep else np.flatnonzero(new):
                own = holders[j]
                g = (slope[own].sum() + curve[own] @ moved[own]) / n + l2 * new[j]
                z = new[j] * bend[j] - g
                x = np.sign(z) * max(abs(z) - l1, 0.0) / bend[j]
                if x != new[j]:
                    moved[own] += x - new[j]
                    most = max(most, abs(x - new[j]))
                    new[j] = x
            if most < 1e-4:
                break
        size = 1.0
        while size > 1e-3:
            step = w + size * (new - w)
            then = loss(score + size * moved, step, theta)
            if then < now:
                w, score, now = step, score + size * moved, then
                break
            size /= 2
        if before - now < 1e-7:
            break
    return w, theta, score


def fit(rows: Rows | list[np.ndarray], grades: np.ndarray, top: int, least_gain: float = 8, l2: float = 1e-5, slack: float = 0.01) -> Model:
    """An L1 penalty of least_gain / n, under which a feature must account for about `least_gain` rows, picks features
    among all; the fit is then repeated with these and a small L2 penalty, so that rare but decisive words get their full
    weight.

    rows hold each text's distinct buckets. The penalised optimum is found with those features only that its conditions
    ask for: as long as any other's slope is above the penalty, by `slack` of it, it joins. No feature is left out for
    its rank or rarity: one of fewer than least_gain rows can't reach the penalty, as a row's slope is under 1.
    """
    if not isinstance(rows, Rows):
        rows = Rows(np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32), np.array([len(r) for r in rows]))
    k, n = max(1, top), rows.n
    l1 = least_gain / n
    share = np.array([(grades < j).mean() for j in range(1, k + 1)]).clip(0.5 / n, 1 - 0.5 / n)
    theta = np.log(share / (1 - share)) + 1e-3 * np.arange(k)
    used, w, score, holders = np.empty(0, np.int64), np.empty(0), np.zeros(n), []
    while True:
        slope = np.abs(rows.sums(derivatives(score, grades, theta)[1])) / n
        slope[used] = 0
        more = np.flatnonzero(slope > l1 * (1 + slack))
        if not len(more):
            break
        # the steepest first: what they explain spares others the way
        more = np.sort(more[np.argsort(-slope[more], kind="stable")[:200]])
        used, w = np.r_[used, more], np.r_[w, np.zeros(len(more))]
        holders += rows.holders(more)
        w, theta, score = _solved(holders, grades, w, theta, l1, 0.0, 12)
        keep = np.flatnonzero(w)
        used, w, holders = used[keep], w[keep], [holders[j] for j in keep]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used], theta, _ = _solved(holders, grades, w, theta, 0.0, l2)
    return Model(weights, theta)


def train(docs: DataFrame, labels: DataFrame, grade: str, top: int, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", max_train: int = MAX_TRAIN) -> Model | None:
    """Fit to labels' `grade`, an SQL expression that gives 0..top; of several for an id the least counts, nulls don't.

    None if no labelled row has a word.
    """
    given = labels.select(labels[label_id].cast("long").alias("id"), F.expr(grade).cast("int").alias("grade")).where(f"id is not null and grade between 0 and {int(top)}")
    given = given.groupBy("id").agg(F.min("grade").alias("grade"))
    n = given.count()
    some = stable_fraction(given, "id", max_train / n if n > max_train else 1)

    def run(batches):
        buckets = Features()
        for b in slices(batches):
            out = [features(t, buckets) or [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.int32()))], ["id", "grade", "x"])

    some = F.broadcast(some) if min(n, max_train) <= SENT_ROWS else some
    rows = id_text(docs, id_col, text_col).where("text is not null").join(some, "id")
    got = map_arrow(rows, run, "id long, grade int, x array<int>").toArrow()
    sizes = got["x"].combine_chunks().value_lengths().to_numpy()
    if not sizes.any():
        return None
    got = got.filter(pa.array(sizes > 0))
    sizes, flat = sizes[sizes > 0], got["x"].combine_chunks().flatten().to_numpy()
    return fit(Rows(flat, sizes), got["grade"].to_numpy().astype(np.int64), top)


def scored(docs: DataFrame, model: Model | None, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail) row by row; a text that is null or has no word has nulls, and so has all without a model."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = known.value
        buckets, w = (Features(m.weights != 0), m.weights) if m else (None, None)
        for b in slices(batches):
            grades, tails = [], []
            for text in b.column(1).to_pylist():
                own = features(text, buckets) if m and text else None
                if own is None:
                    grades.append(None)
                    tails.append(None)
                    continue
                each = m.tails(float(w[own].sum()))
                grades.append(sum(each))
                tails.append(each[least - 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grades, pa.float64()), pa.array(tails, pa.float64())], ["id", "expected_grade", "tail"])

    return map_arrow(id_text(docs, id_col, text_col), run, "id long, expected_grade double, tail double")


def selected(docs: DataFrame, model: Model | None, least: int, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail) of the rows that are kept: tail >= cutoff, or any row when there is no model.

    Rows without a word are rejected; equal rows and null ids are each judged by their text.
    """
    rows = scored(docs, model, least, id_col, text_col)
    kept = rows if model is None else rows.where(F.col("tail") >= cutoff)
    return kept.withColumnRenamed("id", "doc_id")


def kept_rows(docs: DataFrame, model: Model | None, least: int, cutoff: float = CUTOFF, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that are rejected; decided row by row, so ids may be null or repeated."""
    if model is None:
        return docs
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        m = known.value
        buckets, w = Features(m.weights != 0), m.weights
        out = []
        for text in texts:
            own = features(text, buckets) if text else None
            out.append(own is not None and m.tails(float(w[own].sum()))[least - 1] >= cutoff)
        return pd.Series(out)

    return docs.where(good(F.col(text_col)))
