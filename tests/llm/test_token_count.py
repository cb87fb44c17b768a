import random

import pytest

from credsift.llm import queries, token_count


def greedy(vocabulary, symbols):
    """Pieces of greedy longest matching; an end mark that is left over counts nothing."""
    n, i = 0, 0
    while i < len(symbols):
        if symbols[i:] == [256]:
            return n
        for j in range(len(symbols), i, -1):
            if tuple(symbols[i:j]) in vocabulary:
                break
        else:
            return -1
        i, n = j, n + 1
    return n


def test_random_vocabularies():
    random.seed(6)
    for _ in range(300):
        pieces = {tuple(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(random.randint(1, 15))}
        if random.random() < 0.7:
            pieces |= {("a",), ("b",), ("c",)}
        automaton = token_count.Automaton([tuple(map(ord, p)) for p in pieces])
        vocabulary = {tuple(map(ord, p)) for p in pieces}
        for _ in range(40):
            word = [ord(random.choice("abc")) for _ in range(random.randint(0, 14))]
            assert automaton.count(word) == greedy(vocabulary, word)


@pytest.fixture(scope="module")
def counter():
    return token_count.Counter.of(queries.WORDS)


def test_public_vocabulary(counter):
    vocabulary = set(counter.pieces)
    random.seed(7)
    words = ["the", "tokenization", "éàü", "🔐", "x" * 500, "don", "'", "日本語"] + ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(1, 25))) for _ in range(300)]
    for w in words:
        assert counter.of_word(w) == greedy(vocabulary, [*w.encode(), 256])


def test_the_table(spark, sf, counter):
    vocabulary, known = set(counter.pieces), {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()}
    got = {r.doc_id: r for r in queries.op7_token_count(spark, sf).collect()}
    for i, t in texts.items():
        words = counter.words(t or "")
        for w in words:
            if w not in known:
                known[w] = greedy(vocabulary, [*w.encode(), 256])
        assert (got[i].n_tokens, got[i].n_words) == (sum(known[w] for w in words), len(words))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "word", "c"), (4, "a b " * 40_000, None), (4, "a b " * 40_000, None)], "doc_id long, text string, tokens string")
    out = df.select("*", token_count.counts(queries.WORDS, df["text"]).alias("n"))
    got = sorted(((r.doc_id or 0), r.n.tokens, r.n.words) for r in out.collect())
    assert got == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (4, 80_000, 80_000), (4, 80_000, 80_000)]
    assert df.limit(0).select(token_count.counts(queries.WORDS, df["text"])).count() == 0
