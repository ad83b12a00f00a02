"""Problem 8: texts as ids of a byte-level BPE vocabulary.

In each Arrow batch of a partition the distinct pieces that aren't tokens themselves are laid out as one sequence of bytes. A pair
occurrence index maps each pair of neighbouring symbols to all its positions; active ranks are taken in ascending order, the pair's
positions are merged, and only the lists of the pairs to the left and right change. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corespar.tables import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own pattern for pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 500_000  # pieces remembered by a task


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairIndex:
    """Merges many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}  # pair -> id of its merge, -1 for none

    def _merge_of(self, pair: tuple[int, int]) -> int:
        got = self.pairs.get(pair)
        if got is None:
            got = self.pairs[pair] = self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]], -1)
        return got

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        ranks, merge_of = self.ranks, self._merge_of
        single = [ranks[bytes([b])] for b in range(256)]
        symbol: list[int] = []
        starts = []
        for piece in pieces:
            starts.append(len(symbol))
            symbol += [single[b] for b in piece]
            symbol.append(-1)  # ends a piece; in no pair
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, list[int]] = {}  # id of the merge -> positions of its pair (each id has one pair in play at a position)
        for i in range(n - 1):
            if symbol[i] >= 0 and symbol[i + 1] >= 0 and (m := merge_of((symbol[i], symbol[i + 1]))) >= 0:
                at.setdefault(m, []).append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            m = heapq.heappop(active)
            for i in sorted(at.pop(m)):
                left = symbol[i]
                j = after[i]
                if left < 0 or symbol[j] < 0 or merge_of((left, symbol[j])) != m:
                    continue  # changed since
                k = after[j]
                symbol[i], symbol[j] = m, -2
                after[i] = k
                before[k if k < n else i] = i if k < n else before[i]
                for a, b in ((before[i], i), (i, k)):
                    if a >= 0 and b < n and symbol[a] >= 0 and symbol[b] >= 0 and (new := merge_of((symbol[a], symbol[b]))) >= 0:
                        if new not in at:
                            at[new] = []
                            heapq.heappush(active, new)
                        at[new].append(a)
        out = []
        for start in starts:
            ids, i = [], start
            while symbol[i] != -1:
                ids.append(symbol[i])
                i = after[i]
            out.append(tuple(ids))
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.index, self.known = PairIndex(ranks), {}
        self.find = regex.compile(PIECES).findall

    def pieces(self, texts: list[str | None]) -> list[list[str]]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = set(chain.from_iterable(split)) - self.known.keys()
        rest, ranks = [], self.index.ranks
        for piece in fresh:
            raw = piece.encode("utf-8", "surrogatepass")
            if raw in ranks:
                self.known[piece] = (ranks[raw],)
            else:
                rest.append((piece, raw))
        for (piece, _), ids in zip(rest, self.index.merge([raw for _, raw in rest])):
            self.known[piece] = ids
        return split


def _encode(ranks, count_only: bool):
    def run(batches):
        encoder = Encoder(ranks.value)
        for batch in batches:
            split = encoder.pieces(batch.column(1).to_pylist())
            known = encoder.known
            if count_only:
                sizes = {p: len(known[p]) for p in set(chain.from_iterable(split))}
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(map(sizes.__getitem__, s)) for s in split], pa.int64()), *batch.columns[2:]], names=["id", "n_tokens", *batch.schema.names[2:]])
                continue
            ids = [list(chain.from_iterable(map(known.__getitem__, s))) for s in split]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(i) for i in ids], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"])

    return run


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, count_only: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(id, ids) or, with count_only, (id, n_tokens): the text's ids in the vocabulary, without special tokens.

    An empty and a null text both give an empty list (0 tokens); strings of special tokens are ordinary text. Texts are encoded
    whole, whatever their length; equal texts get equal ids. Columns named in `keep` stay beside n_tokens, others aren't read. The vocabulary (50,256 ranks) is sent to
    the tasks by broadcast.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kept = [c for c in keep or [] if count_only]
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *kept))
    schema = "id bigint, n_tokens bigint" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept) if count_only else "id bigint, ids array<int>"
    return rows.mapInArrow(_encode(ranks, count_only), schema).withColumnRenamed("id", id_col)
