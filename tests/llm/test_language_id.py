import time
import warnings

import numpy as np

from credsift.llm import language_id as lid
from credsift.llm.common import learn_from


def small(seed=0):
    return lid.Network(["aa", "bb", "cc"], units=4, seed=seed)


def test_gradients_match_finite_differences():
    net = small()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    lengths = np.array([7, 5, 1, 6])
    seq = rng.integers(97, 101, (7, 4))
    labels = np.array([0, 1, 2, 1])
    _, grads = net.gradients(seq, lengths, labels)
    for key, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(6)] + [tuple(np.unravel_index(np.abs(g).argmax(), g.shape))]:
            kept = net.p[key][at]
            losses = []
            for d in (1e-3, -1e-3):
                net.p[key][at] = kept + d
                losses.append(net.gradients(seq, lengths, labels)[0])
            net.p[key][at] = kept
            assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 2e-4


def test_predictions_do_not_depend_on_the_batch():
    net = small(3)
    texts = ["", None, "x", "hello wörld " * 200, "123 !?", "ßß", "a" * 449, "b c " * 37]
    together = net.predict(texts)
    for k, t in enumerate(texts):
        lang, score = net.predict([t])
        assert lang[0] == together[0][k]
        assert abs(score[0] - together[1][k]) < 1e-5


def test_spans_equal_one_long_run():
    net = small(5)
    text = "the quick brown fox. " * 60
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.intp)[:, None]
    whole = net.position_probs(raw, np.array([len(raw)])).mean((0, 2))
    lang, score = net.predict([text])
    assert net.languages[whole.argmax()] == lang[0]
    assert abs(whole.max() - score[0]) < 0.02


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = lid.train(docs, rows=600, steps=150)
    from credsift.llm.common import held_out

    rows = lid.identify(docs, net).where(held_out("doc_id")).collect()
    letters = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    assert np.mean([r.lang_pred == r.lang for r in letters]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "12 .. 34", None, "c"), (None, "plain words", "en", "d"), (5, "le monde " * 9000, "fr", "e"), (5, "le monde " * 9000, "fr", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = lid.train(df, rows=10, steps=3)
    out = lid.identify(df, net, score_out="p")
    assert out.columns == [*df.columns, "lang_pred", "p"]
    got = out.collect()
    assert len(got) == 6
    assert all(r.lang_pred == "und" and r.p == 0 for r in got if r.doc_id in (1, 2, 3))
    assert len({(r.lang_pred, r.p) for r in got if r.doc_id == 5}) == 1
    nothing = lid.train(df.where("false"))
    assert nothing is None
    assert {r.lang_pred for r in lid.identify(df, None, score_out="p").collect()} == {"und"}
    assert lid.identify(df.limit(0), net, score_out="p").count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"words of language{i % 1500}", f"l{i % 1500:04d}") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in df.where(learn_from("doc_id")).select("lang").distinct().collect()}
    network = lid.train(df, rows=1000, units=4, steps=1)
    assert set(network.languages) == learned and len(learned) > 1400
    lang, score = network.predict(["some words", None, "x" * 3000])
    assert lang[1] == lid.UNKNOWN and all(0 <= s <= 1 for s in score)


def stepped(net, seq, lengths):
    """Probabilities of all positions of each lane, by step alone, one lane at a time."""
    out = np.zeros((len(seq), len(net.languages), seq.shape[1]))
    for j, n in enumerate(lengths):
        lane = seq[:n, j : j + 1]
        for d, places in ((0, range(n)), (1, range(n - 1, -1, -1))):
            state = np.zeros((net.units, 1), np.float32)
            for t in places:
                state = net.step(d, lane[t], state)
                out[t, :, j] += (net.p[f"o{d}"] @ state)[:, 0]
    return lid.softmax(out + net.p["b"], 1)


def test_positions_asked_for_equal_single_steps():
    rng = np.random.default_rng(4)
    lengths = np.array([60, 60, 41, 40, 7, 1])
    seq = rng.integers(0, 256, (60, 6))
    for scale in (1, 3, 400):  # the last one saturates all gates
        net = lid.Network(["aa", "bb", "cc"], units=5, seed=6)
        net.p = {k: v * np.float32(scale) if k[0] in "xu" else v for k, v in net.p.items()}
        want = stepped(net, seq, lengths)
        for first, last in ((0, 60), (0, None), (8, 60), (0, 33), (32, 48), (59, 60)):
            with warnings.catch_warnings():
                warnings.simplefilter("error")
                got = net.position_probs(seq, lengths, first, last)
            inside = np.arange(first, last or 60)[:, None] < lengths
            assert np.abs((got - want[first:last]) * inside[:, None, :]).max() < 2e-5, (scale, first, last)


def test_prediction_takes_less_time_than_steps():
    net = lid.Network(["aa", "bb", "cc", "dd"])
    seq = np.random.default_rng(8).integers(97, 123, (128, 1024))

    def steps():
        for d in (0, 1):
            state = np.zeros((net.units, 1024), np.float32)
            for t in range(128):
                state = net.step(d, seq[t], state)

    def took(f):
        times = []
        for _ in range(5):
            start = time.perf_counter()
            f()
            times.append(time.perf_counter() - start)
        return min(times)

    assert took(lambda: net.position_probs(seq, np.full(1024, 128))) < 0.85 * took(steps)
