"""Severity grades from a cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - x.w): one weight vector is shared by all ordered thresholds. Features are
words and character n-grams of words that are associated with the label; x is log(1 + number of tokens with
the feature). The labels are binary: the severity of a labelled toxic row is the third of the toxic rows in which its
odds fall by a model that was fitted, features included, without the row's fold. Fitting uses a bounded sample of labelled rows (max_rows, ordered by a hash of the id); scoring
reads every whole text of every row.

Defined results: a null or empty text, and any text without a selected feature, gets the severity of x = 0.
Repeated rows get equal scores. Extra columns pass through, but for those named like a result. Without labelled rows, or with one grade only,
there are no features and every severity is that of the empty text (0 if no row is toxic). Null labels are
skipped; of several labels for one id the largest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import fitted

LETTERS = re.compile(r"[^\W\d_]+")
GRAMS = (4, 5, 6)
MAX_ROWS = 6000
MAX_FEATURES = 4096
CACHE = 400_000


def grams(word: str) -> Iterator[str]:
    """The word itself and its n-grams with a mark at its start, repeated ones again."""
    yield word
    marked = "^" + word
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


def word_features(word: str) -> set[str]:
    """The word itself and its n-grams with a mark at its start."""
    return set(grams(word))


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def cutoff(self, margin: float = 0.1) -> float:
        """Expected severity from which a text is rejected: margin above that of a text without any feature."""
        p = self.probabilities(np.zeros(1))
        return float((p @ np.arange(p.shape[1]))[0]) + margin

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        """One row of grade probabilities for each eta."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - eta[:, None], -40, 40)))
        return np.diff(np.hstack([np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))]), axis=1)


class Scorer:
    """Finds a text's selected features; keeps which words have any, in a cache of bounded size."""

    def __init__(self, features: dict[str, int]):
        self.features, self.hot, self.seen = features, {}, set()
        #: Every selected n-gram holds one of these, so most words are dismissed by a few lookups.
        self.kernels = {("^" + f if len(f) < GRAMS[0] else f)[: GRAMS[0]] for f in features}

    def dismissed(self, word: str) -> bool:
        if word in self.features:
            return False
        marked, kernels = "^" + word, self.kernels
        return not any([marked[i : i + 4] in kernels for i in range(len(marked) - 3)])

    def counts(self, text: str | None) -> dict[int, int]:
        if not text or not self.features:
            return {}
        words = LETTERS.findall(text.lower())
        fresh = set(words) - self.seen
        if fresh:
            if len(self.seen) > CACHE:
                self.seen, self.hot, fresh = set(), {}, set(words)
            for w in fresh:
                if self.dismissed(w):
                    continue
                if ids := {self.features[g] for g in grams(w) if g in self.features}:
                    self.hot[w] = ids
            self.seen |= fresh
        found: Counter = Counter()
        hot = self.hot
        for w in filter(hot.__contains__, words):
            found.update(hot[w])
        return found


def select_features(texts: list[str], toxic: np.ndarray) -> dict[str, int]:
    """Features over-represented in toxic texts, by a Chernoff bound on the binomial tail, corrected for their number."""
    n_pos = int(toxic.sum())
    if not n_pos or n_pos == len(toxic):
        return {}

    def distinct(text: str | None) -> set[str]:
        return set(LETTERS.findall((text or "").lower()))

    # Toxic texts, the fewer ones, name the features; the others are only counted against those.
    pos: Counter = Counter()
    for text, bad in zip(texts, toxic, strict=True):
        if bad:
            pos.update(set().union(*map(word_features, distinct(text))))
    tried = len(pos)
    pos = Counter({f: c for f, c in pos.items() if c >= 4})
    neg: Counter = Counter()
    cache: dict[str, tuple[str, ...]] = {}
    for text, bad in zip(texts, toxic, strict=True):
        if bad:
            continue
        met: set[str] = set()
        for w in distinct(text):
            if (g := cache.get(w)) is None:
                g = tuple({f for f in grams(w) if f in pos})
                if len(cache) < CACHE // 8:
                    cache[w] = g
            met.update(g)
        neg.update(met)
    rate = n_pos / len(toxic)
    names = list(pos)
    if not names:
        return {}
    a = np.array([pos[f] for f in names], float)
    n = a + np.array([neg[f] for f in names], float)
    share = np.clip(a / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    bound = -n * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    kept = (share > 0.5) & (bound < np.log(0.5 / (2 * tried)))
    order = np.lexsort((np.array(names, dtype=object), bound))
    return {names[i]: k for k, i in enumerate([i for i in order if kept[i]][:MAX_FEATURES])}


def fit_ordinal(x: tuple[np.ndarray, np.ndarray, np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, l1: float = 5e-5, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated proximal gradient; x is (row, feature, value) of the sparse matrix."""
    rows, cols, values = x
    n = len(grades)
    freq = np.bincount(grades, minlength=n_grades).astype(float) + 0.5
    cum = np.cumsum(freq / freq.sum())[:-1]
    theta = np.log(cum / (1 - cum))
    w = np.zeros(n_features)
    pw, pt = w.copy(), theta.copy()
    step = 1.0
    square = np.bincount(rows, weights=values**2, minlength=n).max(initial=1.0)
    step = 4.0 / max(1.0, square) * 4
    for t in range(1, rounds + 1):
        m = (t - 1) / (t + 2)
        yw, yt = w + m * (w - pw), np.sort(theta + m * (theta - pt))
        eta = np.bincount(rows, weights=values * yw[cols], minlength=n)
        edges = np.concatenate([[-np.inf], yt, [np.inf]])
        hi, lo = edges[grades + 1] - eta, edges[grades] - eta
        sh, sl = 1 / (1 + np.exp(-np.clip(hi, -40, 40))), 1 / (1 + np.exp(-np.clip(lo, -40, 40)))
        p = np.maximum(sh - sl, 1e-12)
        dh, dl = sh * (1 - sh) * np.isfinite(hi), sl * (1 - sl) * np.isfinite(lo)
        g_eta = (dh - dl) / p / n
        g_w = np.bincount(cols, weights=values * g_eta[rows], minlength=n_features)
        g_t = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            g_t[k] = -(dh[grades == k] / p[grades == k]).sum() / n + (dl[grades == k + 1] / p[grades == k + 1]).sum() / n
        pw, pt = w, theta
        w = yw - step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = np.sort(yt - step * g_t)
    return w, theta


def matrix_of(texts: list[str | None], features: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the sparse matrix of texts."""
    scorer, r, c, v = Scorer(features), [], [], []
    for i, t in enumerate(texts):
        for f, k in scorer.counts(t).items():
            r.append(i)
            c.append(f)
            v.append(np.log1p(k))
    return np.array(r, int), np.array(c, int), np.array(v, float)


def held_out_odds(texts: list[str | None], toxic: np.ndarray, folds: int = 2) -> np.ndarray:
    """Each row's log odds of the label by a binary model with features of its own, which has not seen the row's fold."""
    odds, fold = np.zeros(len(texts)), np.arange(len(texts)) % folds
    for k in range(folds):
        seen, unseen = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        known = [texts[i] for i in seen]
        if features := select_features(known, toxic[seen]):
            w, theta = fit_ordinal(matrix_of(known, features), toxic[seen], len(features), 2, rounds=300)
            r, c, v = matrix_of([texts[i] for i in unseen], features)
            odds[unseen] = np.bincount(r, weights=v * w[c], minlength=len(unseen)) - theta[0]
    return odds


def grade_of(toxic: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """0 for rows not labelled toxic; toxic rows get 1, 2 or 3 by thirds of their held-out odds (ties in the lower)."""
    if not toxic.any():
        return np.zeros(len(toxic), int)
    low, high = np.quantile(odds[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic == 0, 0, 1 + (odds > low) + (odds > high)).astype(int)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", key: str = "doc_id") -> OrdinalModel:
    """Fit on at most max_rows labelled rows, chosen by a hash of the id; everything collected is bounded by that."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")
    return fitted(sample.select("_text", "_toxic", "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(max_rows), lambda rows: fit_rows(rows["_text"].to_pylist(), rows["_toxic"].to_numpy().astype(int)))


def fit_rows(texts: list[str | None], toxic: np.ndarray) -> OrdinalModel:
    features = select_features(texts, toxic) if len(texts) else {}
    if not features:
        return OrdinalModel({}, np.zeros(0), np.array([40.0, 40.0, 40.0]) if not toxic.any() else np.array([np.log((1 - toxic.mean() + 1e-9) / (toxic.mean() + 1e-9)), 40.0, 40.0]))
    w, theta = fit_ordinal(matrix_of(texts, features), grade_of(toxic, held_out_odds(texts, toxic)), len(features), 4)
    kept = [f for f in features if w[features[f]] != 0]
    return OrdinalModel({f: i for i, f in enumerate(kept)}, np.array([w[features[f]] for f in kept]), theta)


OUT = ("severity", "grade", "severity_probs")


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", out: tuple[str, str, str] = OUT) -> DataFrame:
    """docs with severity (expected grade), grade (most probable) and severity_probs, under the names out; narrow.

    A column of the input that has one of these names gives way to the result: callers that keep it choose others.
    """
    fields = StructType([f for f in docs.schema if f.name not in out or f.name == text])
    docs = docs.select(*[f"`{n}`" for n in fields.names])
    kinds = StructType.fromDDL("severity double, grade int, severity_probs array<double>")
    schema = StructType([*fields, *(StructField(n, f.dataType) for n, f in zip(out, kinds, strict=True))])
    at = fields.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.features)
        for b in batches:
            eta = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(at).to_pylist()):
                eta[i] = sum(model.weights[f] * np.log1p(k) for f, k in scorer.counts(t).items())
            p = model.probabilities(eta)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype("int32")), pa.array(list(p))],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)
