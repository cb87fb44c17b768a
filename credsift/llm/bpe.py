"""Byte-level BPE by the ranks of a public vocabulary: overlapping chunk encoding, and decoding.

A text is cut into overlapping chunks that are pre-tokenised on their own. The split pattern looks only ahead, so two scans
that share one boundary agree from there on: neighbouring chunks are stitched at the first boundary that both have in
their overlap. A piece that crosses a whole overlap leaves no such boundary; the scan of the left chunk then goes on over
the text of the right one. Pieces are encoded each by itself, by merging the adjacent pair of the lowest rank; decoding
concatenates the raw bytes of the ids.

Ids are kept packed, four little-endian bytes each (`unpack` gives them as numbers).

Defined results: a null text is encoded like an empty one, to no ids; lone surrogates, which Spark strings cannot hold,
are encoded as U+FFFD; other columns, repeated rows and empty tables pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Characters of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pieces that a worker remembers: two generations of so many, so frequent ones are never forgotten.
GENERATION = 1 << 16
#: A piece of more bytes is merged with places by rank.
LONG_PIECE = 64

_loaded: dict[tuple[str, str], Codec] = {}


class Codec:
    """Ranks and split pattern; one per worker process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @staticmethod
    def of(path: str, pattern: str) -> Codec:
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = Codec(path, pattern)
        return _loaded[path, pattern]

    def packed(self, piece: str) -> bytes:
        """Ids of one piece, packed."""
        raw = piece.encode("utf-8", "replace")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.merge(raw) if len(raw) <= LONG_PIECE else self.merge_long(raw)
        return np.array(ids, "<u4").tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost of equal ones; only the pairs next to a merge are looked up again."""
        get, none = self.ranks.get, len(self.ranks) + 256
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def merge_long(self, raw: bytes) -> list[int]:
        """As merge, for a piece that can be as long as a text: the places of pairs are kept by rank, leftmost first, over a
        linked list of tokens. A merge whose own pair has a lower rank than the one at hand is followed at once."""
        n, ranks = len(raw), self.ranks
        end, before, after = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        gone, places = bytearray(n), {}
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                places.setdefault(r, array("q")).append(i)
        queue = list(places)
        heapq.heapify(queue)

        def add(i: int) -> int:
            """Notes the pair at i; its rank, or one that no pair has."""
            r = ranks.get(raw[i : end[after[i]]])
            if r is None:
                return len(ranks) + n
            if r not in places:
                places[r] = array("q")
                heapq.heappush(queue, r)
            places[r].append(i)
            return r

        while queue:
            rank = heapq.heappop(queue)
            here = np.unique(np.frombuffer(places.pop(rank), np.int64)).tolist()
            for k, i in enumerate(here):
                j = n if gone[i] else after[i]
                if j >= n or ranks.get(raw[i : end[j]]) != rank:
                    continue  # one of the pair has been merged since
                end[i], gone[j], after[i] = end[j], 1, after[j]
                least = rank
                if after[i] < n:
                    before[after[i]] = i
                    least = min(least, add(i))
                if before[i] >= 0:
                    least = min(least, add(before[i]))
                if least < rank:
                    places[rank] = array("q", here[k + 1 :])
                    heapq.heappush(queue, rank)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece."""
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            out = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = self.before.get(p)
                    if ids is None:
                        ids = self.packed(p)
                    if len(p) <= LONG_PIECE:
                        known[p] = ids
                out.append(ids)
            if len(known) > GENERATION:
                self.known, self.before = {}, known
            return out

    def encode(self, text: str) -> bytes:
        return b"".join(self.encoded(self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def chunks(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunk i starts at i * chunk and reaches `overlap` characters into chunk i + 1."""
    return [text[k : k + chunk + overlap] for k in range(0, max(1, len(text)), chunk)]


def stitch(codec: Codec, texts: list[str], ids: list[bytes], ends: list[np.ndarray], at: list[np.ndarray], chunk: int) -> bytes:
    """Packed ids of the whole text from those of its chunks.

    ends[i]: the boundaries that chunk i's own scan found in its two overlaps, in the chunk's characters; at[i]: how many
    packed bytes lie before each. A chunk's last piece may have been cut short, so its end is no boundary (save in the last).

    Where two chunks share no boundary in their overlap, the left scan goes on from its last one, over one chunk more, then two
    more, four and so on, until it meets a boundary of a chunk that it reaches. So no part is read more than about twice, and
    what the left scan covers is encoded when its end is known.
    """
    out, k, start, n = [], 0, 0, len(texts)
    while True:
        # chunk k's own ids, from its boundary `start` on
        first = int(at[k][ends[k] == start][0])
        if k + 1 == n:
            out.append(ids[k][first:])
            return b"".join(out)
        usable = ends[k][ends[k] < len(texts[k])]
        shared = np.intersect1d(usable[usable >= chunk] - chunk, ends[k + 1])
        if len(shared):
            start = int(shared[0])
            out.append(ids[k][first : int(at[k][ends[k] == start + chunk][0])])
            k += 1
            continue
        left = int(usable[-1])
        out.append(ids[k][first : int(at[k][ends[k] == left][0])])
        more = 1
        while True:
            last = min(n - 1, k + more)
            text = ("".join(t[:chunk] for t in texts[k:last]) + texts[last])[left:]
            pieces = codec.pieces(text)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64) + left
            if last == n - 1:
                out.append(b"".join(codec.encoded(pieces)))
                return b"".join(out)
            sure = bounds[bounds < left + len(text)]
            met = None
            for j in range(k + 1, last + 1):
                # a chunk's scan starts at its own beginning, which needn't be a boundary; its overlap ends there, too
                both = np.intersect1d(sure - (j - k) * chunk, ends[j][ends[j] < min(chunk, len(texts[j]))])
                both = both[both >= 0]
                if len(both):
                    met = j, int(both[0])
                    break
            if met:
                j, start = met
                out.append(b"".join(codec.encoded(pieces[: int(np.flatnonzero(bounds == start + (j - k) * chunk)[0])])))
                k = j
                break
            more *= 2


def scan(codec: Codec, text: str, chunk: int, overlap: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """One chunk's packed ids, and the boundaries in its overlaps with their places in the ids."""
    pieces = codec.pieces(text)
    parts = codec.encoded(pieces)
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    keep = (bounds <= overlap) | (bounds >= chunk)
    return b"".join(parts), bounds[keep], offsets[keep]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a binary column of packed ids, and with decoded_col also one of the bytes that they decode to; columns of docs that
    have these names are replaced.

    Texts of one chunk are encoded where they are; the chunks of longer ones are dealt over the cluster and stitched by
    text. Decoding in the same pass spares a second set of Python workers.
    """
    common.small_batches(docs.sparkSession)
    both = decoded_col is not None
    docs = docs.drop(ids_col, *[decoded_col] * both)

    @F.pandas_udf("ids binary, decoded binary")
    def whole(texts: pd.Series) -> pd.DataFrame:
        codec = Codec.of(path, pattern)
        ids = [codec.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": [codec.decode(i) for i in ids] if both else [b""] * len(ids)}, dtype=object)

    def out(df: DataFrame, pair: str) -> DataFrame:
        return df.select(*docs.columns, F.col(f"{pair}.ids").alias(ids_col), *([F.col(f"{pair}.decoded").alias(decoded_col)] if both else []))

    text, pair = F.coalesce(F.col(text_col), F.lit("")), common.free_name(docs, "pair")
    long = F.length(text) > chunk
    short = out(docs.where(~long).withColumn(pair, whole(text)), pair)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(pair, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))])
    rest = [c for c in names if c != text_col]
    numbered = docs.where(long).select(
        F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"), F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk).cast("int")), lambda i: F.substring(text, i * chunk + 1, F.lit(chunk + overlap))).alias("texts")
    )
    parts = numbered.select("row", "rest", F.posexplode("texts").alias("i", "t")).select("row", "i", "t", F.when(F.col("i") == 0, F.col("rest")).alias("rest"))

    @F.pandas_udf("ids binary, ends array<long>, at array<long>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        codec = Codec.of(path, pattern)
        return pd.DataFrame([scan(codec, t, chunk, overlap) for t in texts], columns=["ids", "ends", "at"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        codec = Codec.of(path, pattern)
        texts = group["t"].tolist()
        ids = stitch(codec, texts, [s["ids"] for s in group["s"]], [np.array(s["ends"]) for s in group["s"]], [np.array(s["at"]) for s in group["s"]], chunk)
        whole_text = "".join(t[:chunk] for t in texts)
        first = group["rest"].iloc[0]
        found = {"ids": ids, "decoded": codec.decode(ids) if both else b""}
        return pd.DataFrame([[whole_text if c == text_col else first[c] for c in names] + [found]], columns=[*names, pair])

    dealt = parts.repartition("row", "i").withColumn("s", scanned("t"))
    stitched = out(dealt.groupBy("row").applyInPandas(joined, schema), pair)
    return short.unionByName(stitched)


def decode(path: str, pattern: str, ids: Column) -> Column:
    """Binary column: the bytes that packed ids stand for."""

    @F.pandas_udf(T.BinaryType())
    def of(packed: pd.Series) -> pd.Series:
        codec = Codec.of(path, pattern)
        return pd.Series([codec.decode(p) for p in packed], dtype=object)

    return of(ids)
