"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - s) with one score s, a mean of hashed-text weights that all grades share, and ordered
thresholds. Features of a text are its words and its tokens' shapes (letters and digits by class, other signs as they stand,
runs shortened), hashed into BUCKETS weights, and how repetitive it is. The expected grade and the tail probability
of a chosen grade come out, so texts can be selected at any level.

Defined results: a text that is null or has no token gets expected grade 0 and tail 0; rows without a grade, id or text aren't
learned from; with fewer than two grades to learn from all texts get 0; repeated rows, empty tables and other columns
pass through untouched.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Bounds of the training sample: rows of each grade, rows of all grades, characters of a row.
TRAIN_ROWS, ALL_ROWS, TRAIN_CHARS = 1200, 12_000, 20_000
#: Tokens that a worker remembers; longer ones are hashed anew.
REMEMBERED, LONG_TOKEN = 1 << 19, 64
STEPS, RATE, RIDGE = 250, 0.15, 1e-4
#: Share of tokens that repeat an earlier one, in so many equal bins.
REPEAT_BINS = 10


def bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) & (BUCKETS - 1)


def shape(token: str) -> str:
    """Aa for a capitalised word, a.! for one with a dot and a sign, and so on."""
    out, last = [], ""
    for c in token:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if k != last:
            out.append(k)
            last = k
    return "".join(out)


class Hasher(dict):
    """token -> (bucket of the word, bucket of the shape)."""

    def __missing__(self, token: str) -> tuple[int, int]:
        pair = bucket("w", "".join(c for c in token if c.isalnum()).lower()), bucket("s", shape(token))
        if len(token) <= LONG_TOKEN:
            if len(self) > REMEMBERED:
                self.clear()
            self[token] = pair
        return pair


_hasher = Hasher()


def features(text: str) -> np.ndarray:
    """Buckets of a text's tokens, two a token, and at the end that of its repeats; none for a text without tokens."""
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int64)
    pairs = np.array([_hasher[t] for t in tokens], np.int64).ravel()
    repeats = int(REPEAT_BINS * (1 - len(set(tokens)) / len(tokens)))
    return np.append(pairs, bucket("r", str(repeats)))


class Ordinal:
    """Weights and thresholds; grades are 0 to len(thresholds)."""

    def __init__(self, grades: list):
        self.grades, self.weights = grades, np.zeros(BUCKETS)
        # thresholds are the first plus exponentials, so they stay in order
        self.free = np.concatenate(([0.0], np.zeros(max(0, len(grades) - 2))))

    def thresholds(self) -> np.ndarray:
        return self.free[0] + np.concatenate(([0.0], np.cumsum(np.exp(self.free[1:]))))

    def score(self, buckets: np.ndarray) -> float:
        """The mean weight of the tokens' features, plus the weight of the repeats."""
        w = self.weights[buckets]
        return float(w[:-1].mean() * SCALE + w[-1])

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1 and on."""
        return 1 / (1 + np.exp(np.clip(self.thresholds() - score, -40, 40)))

    def fit(self, texts: list[np.ndarray], grades: np.ndarray) -> None:
        """Maximum likelihood with a ridge, by Adam over the whole sample; grades are places in self.grades."""
        rows, columns, values = [], [], []
        for i, b in enumerate(texts):
            ids, n = np.unique(b[:-1], return_counts=True)
            rows += [np.full(len(ids) + 1, i)]
            columns += [ids, b[-1:]]
            values += [n * (SCALE / (len(b) - 1)), [1.0]]
        rows, columns, values = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
        k, n = len(self.grades), len(texts)
        balance = n / (k * np.maximum(1, np.bincount(grades, minlength=k)))[grades]
        balance /= balance.sum()
        m, v = ([np.zeros(BUCKETS), np.zeros_like(self.free)] for _ in range(2))
        for t in range(1, STEPS + 1):
            s = np.bincount(rows, values * self.weights[columns], n)
            theta = self.thresholds()
            edges = np.concatenate(([-40.0], theta, [40.0]))
            upper, lower = (1 / (1 + np.exp(-np.clip(edges[grades + d] - s, -40, 40))) for d in (1, 0))
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            ds = balance * (du - dl)  # of the loss, by the score
            dtheta = np.zeros(k + 1)
            np.add.at(dtheta, grades + 1, -balance * du)
            np.add.at(dtheta, grades, balance * dl)
            dtheta = dtheta[1:k]
            later = np.cumsum(dtheta[::-1])[::-1]
            dfree = np.concatenate((later[:1], later[1:] * np.exp(self.free[1:])))
            for j, (x, g) in enumerate(((self.weights, np.bincount(columns, ds[rows] * values, BUCKETS) + RIDGE * self.weights), (self.free, dfree))):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.01 * (g * g - v[j])
                x -= RATE * (1 - t / (STEPS + 1)) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)


#: Mean weights are small numbers; this puts them on the thresholds' scale.
SCALE = 4.0


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Ordinal | None:
    """Model from at most `rows` rated rows of each grade (fewer where there are more than ten grades), of at most `chars`
    characters, outside the held-out fold. Every grade is learned."""
    usable = ratings.where(common.learn_from(id_col) & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("s_id")).agg(F.max(F.col(grade_col).cast("int")).alias("s_grade"))
    grades = sorted(r[0] for r in usable.select("s_grade").distinct().collect())  # each gets a threshold of the model
    if len(grades) < 2:
        return None
    rows = max(1, min(rows, ALL_ROWS // len(grades)))
    chosen = reduce(DataFrame.union, [common.bounded_sample(usable.where(F.col("s_grade") == g), rows, "s_id") for g in grades])
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.length("text") > 0) & (F.length("text") <= chars)).join(F.broadcast(chosen), F.col("id") == F.col("s_id"))
    got = sample.orderBy(F.xxhash64("id"), "text").limit(rows * len(grades)).select("text", "s_grade").collect()
    pairs = [(f, r.s_grade) for r in got if len(f := features(r.text))]
    kept = sorted({g for _, g in pairs})
    if len(kept) < 2:
        return None
    model = Ordinal(kept)
    model.fit([f for f, _ in pairs], np.array([kept.index(g) for _, g in pairs]))
    return model


def grade(spark, model: Ordinal | None, text: Column, tail_grade: int) -> Column:
    """struct(expected, tail): the expected grade, and the probability of `tail_grade` or more."""
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def of(texts: pd.Series) -> pd.DataFrame:
        model, out = shared.value, np.zeros((len(texts), 2))
        if model is not None:
            levels = np.array(model.grades, float)
            at = np.searchsorted(levels, tail_grade)
            for i, t in enumerate(texts):
                f = features(t or "")
                if len(f):
                    tails = model.tails(model.score(f))
                    out[i] = levels[0] + (np.diff(levels) * tails).sum(), 1.0 if at == 0 else tails[at - 1] if at <= len(tails) else 0.0
        return pd.DataFrame(out, columns=["expected", "tail"])

    return of(text)
