"""Toxicity by class-conditional Kneser-Ney models.

Word and word-pair models of toxic and of ordinary texts, with modified Kneser-Ney discounts, back off to counts that both
classes share, so a rare expression says little until its counts differ; single words are also weighed by significance, and none is cut off. Words that neither has seen, or whose counts say
nothing, are judged by character models of the same kind. A text's evidence is its length-normalised difference of log-likelihoods, and that of its three most telling
words, so that a long text isn't acquitted for being long. A logistic function, fitted on texts whose counts
weren't used, turns both into a score.

Defined results: a text that is null or has no word has the score of no evidence at all; rows without a label, id or text
aren't learned from; if a class has no rows every score is 0; repeated rows, empty tables and other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: rows of each class, characters of a row.
TRAIN_ROWS, TRAIN_CHARS = 2500, 20_000
THRESHOLD = 0.7
ORDER, EVIDENCE, FOLDS = 5, 6, 3
#: Log ratio below which a seen word's counts say nothing, and its spelling is used.
SILENT = 0.05
#: Log-likelihood gain at which a word's evidence counts half: the 95 % point of chi-squared with one degree of freedom.
CHANCE = 3.84
#: A training text with at least this share of word pairs in one earlier text is a copy, and would count as evidence twice.
COPIED = 0.5
#: Unseen words that a worker remembers, and their length; longer ones are spelled out each time.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 64
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spelled(word: str) -> list[str]:
    """Runs of ORDER characters of a whole word, between marks."""
    marked = "^" * (ORDER - 1) + word + "$"
    return [marked[i : i + ORDER] for i in range(len(marked) - ORDER + 1)]


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)[1:5] + 1.0
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0, *(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k, 0.98 * k) for k in (1, 2, 3))])


def xlogy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(y, 1e-300)), 0.0)


def against_shared(keys: list[np.ndarray], counts: list[np.ndarray], contexts: list[np.ndarray], size: int, shared_below: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Expressions that either class has, and the log ratio of their probabilities, class 1 to class 0, given their contexts.

    Each class discounts its own counts and backs off to the shared model of the same order, which is the discounted pooled count
    backed off to shared_below(expressions). So what only one text of one class has says little.
    """
    every = np.union1d(*keys)
    context = np.zeros(len(every), np.int64)
    own = []
    for k, n, c in zip(keys, counts, contexts, strict=True):
        at = np.searchsorted(every, k)
        context[at] = c
        full = np.zeros(len(every), np.int64)
        full[at] = n
        own.append(full)
    pooled = own[0] + own[1]

    def interpolated(n: np.ndarray, below: np.ndarray) -> np.ndarray:
        cut = discounts(n[n > 0])[np.minimum(n, 3)]
        total, held = np.bincount(context, n, size)[context], np.bincount(context, cut, size)[context]
        return np.where(total > 0, (n - cut + held * below) / np.maximum(total, 1), below)

    shared = interpolated(pooled, shared_below(every))
    return every, np.log(interpolated(own[1], shared) / interpolated(own[0], shared)).astype(np.float32)


class Model:
    """Log-likelihood differences, toxic less ordinary. Class 0 is ordinary.

    A position's difference is that of its word by continuation counts (by its spelling if they say nothing) plus that
    of its word after the word before.
    """

    def __init__(self, texts: list[list[str]], labels: np.ndarray):
        self.index = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        size = self.size = len(self.index) + 1  # the last id starts a text
        pairs, tallies = [], []
        for c in (0, 1):
            own = [t for t, y in zip(texts, labels, strict=True) if y == c]
            ids = [np.array([size - 1, *map(self.index.__getitem__, t)], np.int64) for t in own]
            pairs.append(np.unique(np.concatenate([i[:-1] * size + i[1:] for i in ids] or [np.zeros(0, np.int64)]), return_counts=True))
            tallies.append(np.bincount(np.concatenate([i[1:] for i in ids] or [np.zeros(0, np.int64)]), minlength=size))
        follows = [np.bincount(k % size, minlength=size).astype(np.int64) for k, _ in pairs]
        present = [np.flatnonzero(f) for f in follows]
        words, ratio = against_shared(present, [f[p] for f, p in zip(follows, present, strict=True)], [np.zeros(len(p), np.int64) for p in present], 1, lambda e: np.full(len(e), 1 / size))
        self.word_ratio = np.zeros(size, np.float32)
        both = follows[0] + follows[1]
        # by how far the counts differ from those that chance deals out, so that a word of one text weighs less than one of many
        share = np.array([f.sum() for f in follows]) / max(1, both.sum())
        gain = 2 * sum(xlogy(f[words], f[words] / np.maximum(both[words] * p, 1e-9)) for f, p in zip(follows, share, strict=True))
        self.word_ratio[words] = ratio * gain / (gain + CHANCE)
        once = (both + 0.5) / (both.sum() + 0.5 * size)
        self.pairs, self.pair_ratio = against_shared([k for k, _ in pairs], [n for _, n in pairs], [k // size for k, _ in pairs], size, lambda e: once[e % size])
        self.spell(tallies)
        # words of which the counts say next to nothing are judged by their spelling, like unseen ones
        self.silent = np.abs(self.word_ratio) < SILENT
        for w, i in self.index.items():
            if self.silent[i]:
                self.word_ratio[i] = self.by_spelling(w)
        self.unseen: dict[str, float] = {}
        self.logit = np.zeros(EVIDENCE)
        self.range = np.full(EVIDENCE, -np.inf), np.full(EVIDENCE, np.inf)

    def spell(self, tallies: list[np.ndarray]) -> None:
        """Log ratios of runs of ORDER characters, within words, by the counts of the words."""
        names, grams = list(self.index), [Counter(), Counter()]
        for c in (0, 1):
            for i in np.flatnonzero(tallies[c]).tolist():
                n = int(tallies[c][i])
                for g in spelled(names[i]):
                    grams[c][g] += n
        index = {g: i for i, g in enumerate(dict.fromkeys([*grams[0], *grams[1]]))}
        before = {g: i for i, g in enumerate(dict.fromkeys(g[:-1] for g in index))}
        of = np.fromiter((before[g[:-1]] for g in index), np.int64, len(index))
        last = Counter(g[-1] for g in index)
        below = np.fromiter((last[g[-1]] for g in index), float, len(index)) / max(1, len(index))
        keys = [np.sort(np.fromiter((index[g] for g in t), np.int64, len(t))) for t in grams]
        names = list(index)
        counts = [np.fromiter((t[names[k]] for k in own.tolist()), np.int64, len(own)) for t, own in zip(grams, keys, strict=True)]
        every, ratio = against_shared(keys, counts, [of[k] for k in keys], max(1, len(before)), lambda e: below[e])
        self.spelling = {names[k]: float(r) for k, r in zip(every.tolist(), ratio, strict=True) if abs(r) > 0.01}

    def by_spelling(self, word: str) -> float:
        get = self.spelling.get
        return sum([get(g, 0.0) for g in spelled(word)])

    def ratios(self, text: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each position; of the words that counts tell of, without their pairs; of those judged by their spelling."""
        ids = np.array([self.index.get(w, -1) for w in text], np.int64)
        before = np.concatenate(([self.size - 1], ids[:-1]))
        known = ids >= 0
        alone = np.where(known, self.word_ratio[ids], np.float32(0))
        keys = np.where(known & (before >= 0), before * self.size + ids, -1)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        out = alone + np.where(self.pairs[at] == keys, self.pair_ratio[at], np.float32(0))
        for i in np.flatnonzero(~known).tolist():
            w = text[i]
            r = self.unseen.get(w)
            if r is None:
                if len(self.unseen) > REMEMBERED:
                    self.unseen.clear()
                r = self.by_spelling(w)
                if len(w) <= REMEMBERED_CHARS:
                    self.unseen[w] = r
            out[i] = alone[i] = r
        counted = known & ~self.silent[ids]
        return out, alone[counted], alone[~counted]

    def evidence(self, text: list[str]) -> np.ndarray:
        """1, ten times the mean difference, the three largest of single words by their counts, the largest of others by their spelling."""
        if not text:
            return np.eye(EVIDENCE)[0]
        r, seen, spelled_out = self.ratios(text)
        tops = []
        for some, ranks in ((seen, (1, 2, 3)), (spelled_out, (1,))):
            for k in ranks:
                tops.append(max(0.0, np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else 0.0)
        return np.array([1, 10 * r.mean(), *tops])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit @ np.clip(self.evidence(words(text)), *self.range), -30, 30))))


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
    return w


def without_copies(texts: list[list[str]]) -> list[int]:
    """Places of the texts that are no near copies of any one earlier text, by a hashed eighth of their word pairs."""
    holders: dict[int, array] = {}  # places in `kept` of the texts with a pair
    kept = []
    for i, text in enumerate(texts):
        some = {h for a, b in zip(text, text[1:], strict=False) if not (h := zlib.crc32(f"{a} {b}".encode("utf-8", "replace"))) & 7}
        met = [holders[h] for h in some if h in holders]
        shared = np.bincount(np.concatenate([np.frombuffer(m, np.int32) for m in met])).max() if met else 0
        if shared < COPIED * len(some) or not some:
            for h in some:
                holders.setdefault(h, array("i")).append(len(kept))
            kept.append(i)
    return kept


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """None if a class is missing. The logistic part is fitted on folds that the counts of the other folds score."""
    split = [words(t) for t in texts]
    kept = without_copies(split)
    split, y = [split[i] for i in kept], np.array([labels[i] for i in kept])
    if len(set(y.tolist())) < 2:
        return None
    fold = np.zeros(len(y), int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    evidence = np.zeros((len(y), EVIDENCE))
    for k in range(FOLDS):
        used = np.flatnonzero(fold != k)
        part = Model([split[i] for i in used], y[used])
        for i in np.flatnonzero(fold == k).tolist():
            evidence[i] = part.evidence(split[i])
    model = Model(split, y)
    model.logit = fit_logit(evidence, y.astype(float))
    model.range = evidence.min(0), evidence.max(0)  # the logistic part isn't carried on beyond what it was fitted to
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | None:
    """Model from at most `rows` labelled rows of each class, of at most `chars` characters, outside the held-out fold.

    The labels are sampled first, so only texts of that bounded set of ids (broadcast) are read out.
    """
    usable = labels.where(common.learn_from(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("s_id"), F.col(label_col).cast("int").alias("s_label"))
    usable = usable.groupBy("s_id").agg(F.max("s_label").alias("s_label"))
    chosen = common.bounded_sample(usable.where("s_label = 1"), rows, "s_id").union(common.bounded_sample(usable.where("s_label = 0"), rows, "s_id"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.length("text") > 0) & (F.length("text") <= chars)).join(F.broadcast(chosen), F.col("id") == F.col("s_id"))
    got = sample.orderBy(F.xxhash64("id"), "text").limit(2 * rows).select("text", "s_label").collect()
    return fit([r.text for r in got], [r.s_label for r in got])


def score(spark, model: Model | None, text: Column) -> Column:
    """Column of scores from 0 to 1."""
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([0.0 if model is None else model.score(t) for t in texts], dtype=float)

    return of(text)
