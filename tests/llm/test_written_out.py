"""The scores of the learned operators, written out number by number, against what the queries return."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from credsift.llm import common, language_id, quality, queries, toxicity
from credsift.llm.common import table


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


# ---- 1: one byte at a time, each unit by its gates


def states(p, d, units, data):
    """States of one direction before... after each byte, read from the left."""
    h, out = np.zeros(units), []
    for byte in data:
        x, a = p[f"x{d}"][byte].astype(float), p[f"u{d}"].astype(float) @ h
        z, r = (1 / (1 + np.exp(-(x[k * units : (k + 1) * units] + a[k * units : (k + 1) * units]))) for k in (0, 1))
        n = np.tanh(x[2 * units :] + r * a[2 * units :])
        h = z * h + (1 - z) * n
        out.append(h)
    return out


def language(network, text):
    data = (text or "").encode("utf-8", "replace")
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = np.zeros(len(network.languages))
    for a in range(0, len(data), language_id.SPAN):
        end = min(len(data), a + language_id.SPAN)
        first, last = max(0, a - language_id.CONTEXT), min(len(data), end + language_id.CONTEXT)
        part = data[first:last]
        forth, back = states(network.p, 0, network.units, part), states(network.p, 1, network.units, part[::-1])[::-1]
        for k in range(a - first, end - first):
            logit = network.p["o0"] @ forth[k] + network.p["o1"] @ back[k] + network.p["b"][:, 0]
            e = np.exp(logit - logit.max())
            total += e / e.sum()
    best = int(total.argmax())
    return network.languages[best], total[best] / len(data)


def test_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    network = language_id.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    assert set(got) == set(texts)
    some = [i for i in sorted(texts) if len(texts[i] or "") < 1500][:80]
    for i in some:
        lang, score = language(network, texts[i])
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=2e-4) and got[i].held_out == held_out(i)


# ---- 6: probabilities from counts in dictionaries


def discount(counts):
    n = [sum(c == k for c in counts) + 1.0 for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0] + [min(0.98 * k, max(0.1 * k, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]


def smoothed(counts, context, below):
    """counts: {expression: n}, modified Kneser-Ney of expressions given context(expression), backed off to below(expression)."""
    cut = discount([n for n in counts.values() if n > 0])
    total, held = Counter(), Counter()
    for e, n in counts.items():
        total[context(e)] += n
        held[context(e)] += cut[min(n, 3)]

    def p(e):
        c = context(e)
        if not total[c]:
            return below(e)
        n = counts.get(e, 0)
        return (n - cut[min(n, 3)] + held[c] * below(e)) / total[c]

    return p


def log_ratio(counts, context, below):
    """Log ratio of an expression's probabilities in class 1 and 0, both backed off to what the classes share."""
    pooled = Counter(counts[0])
    pooled.update(counts[1])
    shared = smoothed(pooled, context, below)
    one, zero = (smoothed(counts[c], context, shared) for c in (1, 0))
    return {e: math.log(one(e) / zero(e)) for e in pooled}


class Plain:
    def __init__(self, texts, labels):
        vocabulary = list(dict.fromkeys(w for t in texts for w in t))
        size, self.known = len(vocabulary) + 1, set(vocabulary)
        pairs, tallies = [Counter(), Counter()], [Counter(), Counter()]
        for t, y in zip(texts, labels, strict=True):
            pairs[y].update(zip([None, *t], t, strict=False))
            tallies[y].update(t)
        follows = [Counter(w for _, w in p) for p in pairs]
        words = log_ratio(follows, lambda e: 0, lambda e: 1 / size)
        sums = [sum(f.values()) for f in follows]
        both = Counter(follows[0])
        both.update(follows[1])
        self.words = {}
        for w, r in words.items():
            gain = 2 * sum(f[w] * math.log(f[w] / max(both[w] * s / sum(sums), 1e-9)) for f, s in zip(follows, sums, strict=True) if f[w])
            self.words[w] = r * gain / (gain + toxicity.CHANCE)
        everything = sum(both.values()) + 0.5 * size
        self.pairs = log_ratio(pairs, lambda e: e[0], lambda e: (both[e[1]] + 0.5) / everything)
        grams = [Counter(), Counter()]
        for c in (0, 1):
            for w, n in tallies[c].items():
                marked = "^" * (toxicity.ORDER - 1) + w + "$"
                for k in range(len(marked) - toxicity.ORDER + 1):
                    grams[c][marked[k : k + toxicity.ORDER]] += n
        kinds = set(grams[0]) | set(grams[1])
        last = Counter(g[-1] for g in kinds)
        self.spelling = log_ratio(grams, lambda g: g[:-1], lambda g: last[g[-1]] / len(kinds))
        self.silent = {w for w, r in self.words.items() if abs(r) < toxicity.SILENT}

    def spelled(self, word):
        marked = "^" * (toxicity.ORDER - 1) + word + "$"
        found = (self.spelling.get(marked[k : k + toxicity.ORDER], 0.0) for k in range(len(marked) - toxicity.ORDER + 1))
        return sum(r for r in found if abs(r) > 0.01)

    def evidence(self, text):
        if not text:
            return [1, 0, 0, 0, 0, 0]
        each, counted, spelled, before = [], [], [], None
        for w in text:
            by_counts = w in self.known and w not in self.silent
            alone = self.words[w] if by_counts else self.spelled(w)
            (counted if by_counts else spelled).append(alone)
            each.append(alone + (self.pairs.get((before, w), 0.0) if w in self.known else 0.0))
            before = w if w in self.known else "\0"
        counted.sort(reverse=True)
        return [1, 10 * sum(each) / len(each), *[max(0.0, counted[k]) if len(counted) > k else 0.0 for k in range(3)], max([0.0, *spelled])]


def test_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1)}
    rows = docs.select("doc_id", "text").collect()
    order = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    learned = sorted((order[r.doc_id], r.text, toxic[r.doc_id]) for r in rows if r.doc_id in toxic and not held_out(r.doc_id) and r.text and len(r.text) <= toxicity.TRAIN_CHARS)
    texts = [re.findall(r"\w+", t.lower()) for _, t, _ in learned]
    kept = toxicity.without_copies(texts)
    plain = Plain([texts[k] for k in kept], [learned[k][2] for k in kept])
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        x = np.clip(plain.evidence(re.findall(r"\w+", (r.text or "").lower())), *model.range)
        score = 1 / (1 + math.exp(-float(model.logit @ x)))
        assert got[r.doc_id].score == pytest.approx(score, abs=2e-3), r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7) and got[r.doc_id].held_out == held_out(r.doc_id)


# ---- 10: weights of hashed tokens, thresholds by sums


def test_quality(spark, sf):
    docs = table(spark, sf, "documents")
    rated = table(spark, sf, "labels").where("quality in (0, 1)").selectExpr("doc_id", "case when quality = 0 then 0 when toxic = 1 then 1 when toxic = 0 then 2 end as grade")
    model = quality.train(docs.select("doc_id", "text"), rated)
    edges = [model.free[0]]
    for step in model.free[1:]:
        edges.append(edges[-1] + math.exp(step))
    crc = lambda s: zlib.crc32(s.encode("utf-8", "replace")) % quality.BUCKETS
    got = {r.doc_id: r for r in queries.op10_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert set(got) == {r.doc_id for r in rows} and model.grades == [0, 1, 2]
    for r in rows:
        tokens = (r.text or "").split()
        if not tokens:
            assert (got[r.doc_id].expected_grade, got[r.doc_id].tail, got[r.doc_id].selected) == (0, 0, False)
            continue
        total = 0.0
        for t in tokens:
            kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in t)
            total += model.weights[crc("w:" + "".join(filter(str.isalnum, t)).lower())] + model.weights[crc("s:" + re.sub(r"(.)\1+", r"\1", kinds, flags=re.S))]
        score = quality.SCALE * total / (2 * len(tokens)) + model.weights[crc(f"r:{int(quality.REPEAT_BINS * (1 - len(set(tokens)) / len(tokens)))}")]
        at_least = [1 / (1 + math.exp(e - score)) for e in edges]
        assert got[r.doc_id].expected_grade == pytest.approx(sum(at_least), abs=1e-9) and got[r.doc_id].tail == pytest.approx(at_least[0], abs=1e-9)
        assert got[r.doc_id].selected == (got[r.doc_id].tail >= 0.5)


def test_folds(spark):
    ids = [None, 0, 1, 2, 3, -5, 10**15]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", common.held_out("doc_id").alias("h"), common.learn_from("doc_id").alias("l")).collect()
    assert [(r.h, r.l) for r in rows] == [(False, False) if i is None else (held_out(i), not held_out(i)) for i in ids]
