"""Token counts by a linear longest-match automaton.

Greedy longest-match pieces of every word are counted in one pass over its bytes: a trie of the vocabulary, where each node that
a word can get stuck at has a failure link to the node that remains after the pieces it surely begins with are taken
off, and the number of those pieces. No piece is ever built.

Words are what WORD finds in the lower-cased, NFC-normalised text: letter runs, single digits, runs of other signs. A word
ends with the vocabulary's end mark, so pieces that end words differ from those that don't; where the last piece has no such
form, the mark that is left over counts nothing.

Defined results: null and empty texts have 0 tokens; a word that the vocabulary's pieces can't cover counts one for each of
its bytes; repeated rows, empty tables and other columns pass through untouched.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END_MARK = "</w>"
#: Words that a worker remembers; longer ones are counted anew.
REMEMBERED, LONG_WORD = 1 << 19, 64

_loaded: dict[str, Counter] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Trie over symbols 0 to 255 for bytes and 256 for the end of a word; node 0 is the root. Pieces in `free` count nothing."""

    def __init__(self, pieces: list[tuple[int, ...]], free: tuple[tuple[int, ...], ...] = ()):
        self.next: list[dict[int, int]] = [{}]
        whole, costs = [False], {}
        for piece in [*pieces, *free]:
            node = 0
            for symbol in piece:
                to = self.next[node].get(symbol)
                if to is None:
                    to = self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = to
            whole[node] = True
            costs[node] = piece not in free
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = [0]
        for parent in queue:  # breadth first
            for symbol, node in self.next[parent].items():
                queue.append(node)
                if whole[node]:
                    self.link[node], self.popped[node] = 0, int(costs[node])
                    continue
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and symbol not in self.next[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.next[at][symbol], count

    def count(self, symbols: list[int]) -> int:
        """Pieces that greedy longest matching takes for the symbols, -1 if it gets stuck."""
        node, total, after, link, popped = 0, 0, self.next, self.link, self.popped
        for symbol in symbols:
            while (to := after[node].get(symbol)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return -1
            node = to
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return total


class Counter:
    """Vocabulary file, word pattern and automaton; one per worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.pieces = []
        for piece in vocabulary:
            ends = piece.endswith(END_MARK)
            body = piece.removesuffix(END_MARK)
            if body and all(c in letters for c in body):
                self.pieces.append((*[letters[c] for c in body], *[256] * ends))
        self.automaton, self.word, self.known = Automaton(self.pieces, ((256,),)), regex.compile(WORD), {}

    @staticmethod
    def of(path: str) -> Counter:
        if path not in _loaded:
            _loaded[path] = Counter(path)
        return _loaded[path]

    def of_word(self, word: str) -> int:
        raw = [*word.encode("utf-8", "replace"), 256]
        count = self.automaton.count(raw)
        return count if count >= 0 else len(raw) - 1

    def words(self, text: str) -> list[str]:
        return self.word.findall(unicodedata.normalize("NFC", text).lower())

    def of_text(self, text: str) -> tuple[int, int]:
        """Tokens and words of a text."""
        words, known = self.words(text), self.known
        try:
            return sum([known[w] for w in words]), len(words)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            total = 0
            for w in words:
                n = known.get(w)
                if n is None:
                    n = self.of_word(w)
                    if len(w) <= LONG_WORD:
                        known[w] = n
                total += n
            return total, len(words)


def counts(path: str, text: Column) -> Column:
    """struct(tokens, words) of each whole text."""

    @F.pandas_udf("tokens long, words long")
    def of(texts: pd.Series) -> pd.DataFrame:
        counter = Counter.of(path)
        return pd.DataFrame([counter.of_text(t or "") for t in texts], columns=["tokens", "words"])

    return of(text)
