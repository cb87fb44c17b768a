import random

import numpy as np

from credsift.llm import queries, toxicity


def made(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = ["".join(r.choice("abdegklmnorst") for _ in range(r.randint(2, 6))) for _ in range(r.randint(20, 90))]
        if i % 3 == 0:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(("grumpus", "vilefish", "nastard")))
        out.append((" ".join(text), int(i % 3 == 0)))
    return out


def test_discounts_and_ratios():
    d = toxicity.discounts(np.array([1] * 50 + [2] * 20 + [3] * 9 + [4] * 5 + [9]))
    assert d[0] == 0 and 0 < d[1] < 1 and d[1] <= d[2] <= d[3] < 3
    every, ratio = toxicity.against_shared([np.array([1, 2, 5]), np.array([1, 2, 9])], [np.array([30, 4, 1]), np.array([28, 5, 40])], [np.zeros(3, int)] * 2, 1, lambda e: np.full(len(e), 0.1))
    of = dict(zip(every.tolist(), ratio.tolist(), strict=True))
    assert of[9] > 1 > abs(of[1]) and of[5] < of[2]


def test_made_texts():
    data = made(1200)
    model = toxicity.fit([t for t, _ in data[:1000]], [y for _, y in data[:1000]])
    scores = np.array([model.score(t) for t, _ in data[1000:]])
    y = np.array([y for _, y in data[1000:]])
    assert scores[y == 1].min() > toxicity.THRESHOLD > scores[y == 0].max()
    long = " ".join(t for t, y in data if y == 0)[:60_000]
    assert model.score(long) < toxicity.THRESHOLD
    assert model.score(long + " grumpus vilefish nastard grumpus " + long) > toxicity.THRESHOLD


def test_copies_are_left_out():
    text = [f"w{i}" for i in range(80)]
    assert toxicity.without_copies([text, text, [*text[:70], "other"], [f"v{i}" for i in range(80)], []]) == [0, 3, 4]


def test_pairs_of_many_texts_make_no_copy():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [[r.choice(words) for _ in range(200)] for _ in range(200)]
    assert len(toxicity.without_copies(texts)) >= 190
    thirds = [[f"{c}{i}" for i in range(300)] for c in "abc"]
    mixed = [w for t in thirds for w in t[:100]]
    assert toxicity.without_copies([*thirds, mixed, mixed]) == [0, 1, 2, 3]


def test_rare_words_count():
    data = made(600)
    toxic = [i for i, (_, y) in enumerate(data) if y == 1][:3]
    texts = [(f"{t} rarefoul" if i in toxic else t).split() for i, (t, _) in enumerate(data)]
    model = toxicity.Model(texts, np.array([y for _, y in data]))
    assert model.word_ratio[model.index["rarefoul"]] > 0.5
    quiet = [w for w, i in model.index.items() if model.silent[i]]
    assert all(np.isclose(model.word_ratio[model.index[w]], model.by_spelling(w), atol=1e-5) for w in quiet)


def test_long_words_are_spelled_whole():
    data = made(600)
    model = toxicity.fit([t for t, _ in data], [y for _, y in data])
    r = random.Random(2)
    long = "".join(r.choice("abdegklmnorst") for _ in range(400))
    marked = f"^^^^{long}$"
    assert np.isclose(model.by_spelling(long), sum(model.spelling.get(marked[i : i + 5], 0.0) for i in range(401)))
    assert model.by_spelling(long[:64] + "grumpus") != model.by_spelling(long[:64])
    model.ratios([long, "unheardof"])
    assert long not in model.unseen and "unheardof" in model.unseen


def test_held_out_rows_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = [r.predicted for r in rows if labels[r.doc_id] == 1]
    wrong = [r.predicted for r in rows if labels[r.doc_id] == 0]
    assert np.mean(hit) > 0.75
    assert np.mean(wrong) < 0.01


def test_odd_rows(spark):
    data = [(i, t) for i, (t, _) in enumerate(made(120))]
    df = spark.createDataFrame([*data, (900, None), (901, ""), (None, "grumpus grumpus vilefish nastard"), (3, data[3][1]), (902, "word " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (5, None), (900, 1), (901, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = df.select("*", toxicity.score(spark, model, df["text"]).alias("score"))
    got = out.collect()
    assert len(got) == df.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (900, 901)} == {model.score("")}
    assert toxicity.train(df, labels.where("toxic = 0")) is None
    assert {r[0] for r in df.select(toxicity.score(spark, None, df["text"])).collect()} == {0.0}
    assert toxicity.train(df.limit(0), labels) is None
