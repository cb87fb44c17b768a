"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Each direction is one layer of gated units that reads the bytes of a text; a linear layer over both states labels every
position, and a document's probabilities are the means of those of its positions. Texts are read whole, in spans of SPAN bytes
with CONTEXT bytes on either side to warm the states up; spans of many texts run side by side, sorted by length.

Arrays are laid out (features, lanes), so gates are contiguous rows.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the first language in alphabetical
order; rows without a language or id aren't learned from; a table with nothing to learn from makes every row `und`;
repeated rows, empty tables and other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
SPAN, CONTEXT, LANES = 448, 32, 1024
#: Bounds of the training sample: rows, passages a row, characters a passage.
TRAIN_ROWS, PASSAGES, PASSAGE_CHARS = 4000, 2, 128
UNITS, STEPS, BATCH, LENGTH = 16, 320, 192, 96


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def opened(x: np.ndarray) -> None:
    """x = 1 / (1 + exp(x)), in place; where the exponential is beyond all bounds, 0."""
    np.exp(x, out=x)
    x += 1
    np.divide(1, x, out=x)


class Network:
    """Parameters of both directions; d = 0 reads forwards, 1 backwards."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 1):
        rng, h = np.random.default_rng(seed), units
        normal = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
        self.languages, self.units = languages, units
        self.p = {"b": np.zeros((len(languages), 1), np.float32)}
        for d in (0, 1):
            self.p |= {f"x{d}": normal(0.3, 256, 3 * h), f"u{d}": normal(h**-0.5, 3 * h, h), f"o{d}": normal(h**-0.5, len(languages), h)}

    def step(self, d: int, bytes_now: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Next state of the lanes; keep gets what backpropagation needs."""
        h = self.units
        x = np.ascontiguousarray(self.p[f"x{d}"].take(bytes_now, axis=0).T)
        a = self.p[f"u{d}"] @ state
        gates = sigmoid(a[: 2 * h] + x[: 2 * h])
        z, r, inner = gates[:h], gates[h:], a[2 * h :]
        n = r * inner
        n += x[2 * h :]
        np.tanh(n, out=n)
        new = state - n
        new *= z
        new += n
        if keep is not None:
            keep.append((z, r, n, inner, state))
        return new

    def train(self, texts: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 6e-3, seed: int = 2) -> list[float]:
        """texts: (passages, length) bytes, padded; lengths: of each passage; returns the loss of each step."""
        rng, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            chosen = rng.integers(0, len(texts), batch)
            loss, grads = self.gradients(texts[chosen].T.astype(np.intp), lengths[chosen], labels[chosen])
            losses.append(loss)
            speed = rate * min(1, 2 * (1 - t / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (speed * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return losses

    def gradients(self, seq: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of (length, lanes) bytes, and its gradients through time."""
        (steps, lanes), h, p = seq.shape, self.units, self.p
        inside = np.arange(steps)[:, None] < lengths[None, :]
        # the backward direction reads each lane from its own last byte, so both are aligned left
        turned = np.where(inside, lengths[None, :] - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        order = (seq, np.take_along_axis(seq, turned, 0))
        kept, states = ([], []), (np.empty((steps, h, lanes), np.float32), np.empty((steps, h, lanes), np.float32))
        for d in (0, 1):
            state = np.zeros((h, lanes), np.float32)
            for t in range(steps):
                state = states[d][t] = self.step(d, order[d][t], state, kept[d])
        logits = np.einsum("ch,thl->tcl", p["o0"], states[0]) + np.take_along_axis(np.einsum("ch,thl->tcl", p["o1"], states[1]), turned[:, None, :], 0) + p["b"]
        probs = softmax(logits, 1)
        count = max(1, int(inside.sum()))
        loss = float(-(np.log(np.take_along_axis(probs, labels[None, None, :].repeat(steps, 0), 1)[:, 0] + 1e-12) * inside).sum() / count)
        probs[:, labels, np.arange(lanes)] -= 1
        error = probs * (inside[:, None, :] / np.float32(count)).astype(np.float32)
        grads = {"b": error.sum((0, 2))[:, None]}
        for d in (0, 1):
            own = error if d == 0 else np.take_along_axis(error, turned[:, None, :], 0)
            grads[f"o{d}"] = np.einsum("tcl,thl->ch", own, states[d])
            du, dx, carry, u = np.zeros_like(p[f"u{d}"]), np.empty((steps, 3 * h, lanes), np.float32), np.zeros((h, lanes), np.float32), p[f"u{d}"]
            for t in range(steps - 1, -1, -1):
                z, r, n, inner, before = kept[d][t]
                ds = p[f"o{d}"].T @ own[t] + carry
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (before - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                through = np.concatenate((dz, dr, dn * r))
                dx[t] = np.concatenate((dz, dr, dn))
                du += through @ before.T
                carry = ds * z + u.T @ through
            flat, by_byte = order[d].ravel(), dx.transpose(1, 0, 2).reshape(3 * h, -1)
            grads[f"u{d}"] = du
            grads[f"x{d}"] = np.stack([np.bincount(flat, row, 256) for row in by_byte], 1).astype(np.float32)
        return loss, grads

    def position_probs(self, seq: np.ndarray, lengths: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """(positions from first to last, languages, lanes) for lanes sorted by length, longest first; only lanes that go on are stepped.

        The same function as step's, in less time: either direction stops where no position that was asked for follows, lanes are rows, so
        what bytes give is looked up as rows and nothing is transposed, and gates need one exponential, with its sign and factor in the weights.
        """
        (steps, lanes), h = seq.shape, self.units
        last = steps if last is None else last
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than t
        out = np.empty((last - first, len(self.languages), lanes), np.float32)
        out[:] = self.p["b"]
        sums, inputs = np.empty((2, 3 * lanes * h), np.float32)
        factor = np.array([-1, -1, -2], np.float32)[:, None, None]  # powers of two, so nothing is rounded
        with np.errstate(over="ignore"):
            for d in (0, 1):
                x = np.ascontiguousarray(self.p[f"x{d}"].reshape(-1, 3, h).transpose(1, 0, 2) * factor)
                u = np.ascontiguousarray(self.p[f"u{d}"].reshape(3, h, h).transpose(0, 2, 1) * factor)
                o, states, k = self.p[f"o{d}"], np.zeros((lanes, h), np.float32), 0
                for t in range(last) if d == 0 else range(steps - 1, first - 1, -1):
                    if live[t] != k:  # backwards, lanes join at their own last byte, with a state of zeros
                        k = int(live[t])
                        state, a, given = states[:k], sums[: 3 * k * h].reshape(3, k, h), inputs[: 3 * k * h].reshape(3, k, h)
                        (z, r, inner), n = a, given[2]
                    if not k:
                        continue
                    np.take(x, seq[t, :k], axis=1, out=given, mode="clip")
                    np.matmul(state, u, out=a)
                    a[:2] += given[:2]
                    opened(a[:2])
                    inner *= r
                    n += inner
                    opened(n)
                    n *= 2
                    n -= 1
                    state -= n
                    state *= z
                    state += n
                    if first <= t < last:
                        out[t - first, :, :k] += o @ state.T
        return softmax(out, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each whole text."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        pooled = np.zeros((len(raw), len(self.languages)))
        spans = [(i, max(0, a - CONTEXT), a, min(len(r), a + SPAN)) for i, r in enumerate(raw) for a in range(0, len(r), SPAN)]
        spans.sort(key=lambda s: s[1] - min(len(raw[s[0]]), s[3] + CONTEXT))
        lanes = max(8, min(LANES, LANES * 32 // len(self.languages)))  # position by language by lane stays bounded
        for k in range(0, len(spans), lanes):
            some = spans[k : k + lanes]
            parts = [raw[i][first : end + CONTEXT] for i, first, _, end in some]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            seq = np.zeros((len(parts), int(lengths[0])), np.uint8)
            for j, part in enumerate(parts):
                seq[j, : len(part)] = np.frombuffer(part, np.uint8)
            lead = np.array([a - first for _, first, a, _ in some])
            size = np.array([end - a for _, _, a, end in some])
            begin, end = int(lead.min()), int((lead + size).max())
            probs = self.position_probs(np.ascontiguousarray(seq.T).astype(np.intp), lengths, begin, end)
            where = np.arange(begin, end)[:, None]
            probs *= ((where >= lead) & (where < lead + size))[:, None, :]
            np.add.at(pooled, [s[0] for s in some], probs.sum(0, dtype=np.float64).T)
        pooled /= np.maximum(1, np.fromiter(map(len, raw), np.int64, len(raw)))[:, None]
        best = pooled.argmax(1)
        known = [bool(t) and (t.isalpha() or any(map(str.isalpha, t))) for t in texts]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(pooled.max(1), 0, 1), 0.0)


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    x /= x.sum(axis, keepdims=True)
    return x


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, units: int = UNITS, steps: int = STEPS) -> Network | None:
    """Network learned from at most `rows` rows (and one of each language that these leave out) outside the held-out fold, about
    as many of each language.

    Of each row PASSAGES passages at places given by the id's hash are used; None if there is no row to learn from.
    """
    spark = docs.sparkSession
    usable = docs.where(common.learn_from(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(id_col, text_col, lang_col)
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}  # one row for each output of the network
    if not counts:
        return None
    share = F.broadcast(spark.createDataFrame([(k, float(n)) for k, n in counts.items()], "s_lang string, s_count double"))
    # rows with the smallest hash times frequency: each language gets the same share while it lasts
    priority = (F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 40)) + 1) * F.col("s_count")
    # a bound under which twice the wanted rows are expected, so partitions send on no more than that together
    low, high = 0.0, float(max(counts.values()))
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if sum(min(n, middle) for n in counts.values()) > 2 * rows + 50 else (middle, high)
    room = F.greatest(F.length(text_col) - PASSAGE_CHARS, F.lit(0)) + 1
    passages = F.array(*[F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.lit(k), id_col), room) + 1).cast("int"), F.lit(PASSAGE_CHARS)) for k in range(PASSAGES)])
    every = usable.join(share, F.col(lang_col) == F.col("s_lang")).select(F.col(lang_col).alias("lang"), passages.alias("passages"), priority.alias("priority"), F.col(id_col).alias("id"))
    sample = every.where(F.col("priority") <= high * ((1 << 40) + 1)).orderBy("priority", "id").limit(rows).collect()
    missed = set(counts) - {r.lang for r in sample}
    if missed:  # more languages than rows can show: one row of each
        rest = every.join(F.broadcast(spark.createDataFrame([(m,) for m in sorted(missed)], "lang string")), "lang")
        sample += [r.first for r in rest.groupBy("lang").agg(F.min(F.struct("priority", "id", "lang", "passages")).alias("first")).orderBy("lang").collect()]
    languages = sorted(counts)
    number = {lang: k for k, lang in enumerate(languages)}
    parts = [(p.encode("utf-8", "replace")[:LENGTH], number[r.lang]) for r in sample for p in r.passages]
    texts = np.zeros((len(parts), LENGTH), np.uint8)
    for row, (part, _) in zip(texts, parts, strict=True):
        row[: len(part)] = np.frombuffer(part, np.uint8)
    network = Network(languages, units)
    network.train(texts, np.array([len(p) for p, _ in parts]), np.array([k for _, k in parts]), steps)
    return network


def language(spark, network: Network | None, text: Column) -> Column:
    """struct(lang, score) of each whole text."""
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
        lang, score = shared.value.predict([None if t is None else t for t in texts])
        return pd.DataFrame({"lang": lang, "score": score})

    return of(text)


def identify(docs: DataFrame, network: Network | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its probability; columns of docs that have these names are replaced."""
    docs = docs.drop(lang_out, score_out)
    both = common.free_name(docs, "language")
    return docs.withColumn(both, language(docs.sparkSession, network, F.col(text_col))).select("*", F.col(f"{both}.lang").alias(lang_out), F.col(f"{both}.score").alias(score_out)).drop(both)
