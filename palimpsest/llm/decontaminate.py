"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

The random walk of Chakraborty, Goldenberg and Koucky (2016) maps a string x to 3 * len(x) symbols: step j emits x[i] and moves i on by
a random bit that depends on j and x[i] only.  Strings at a small edit distance get embeddings at a small Hamming distance.  Here the
symbols are words (case-folded, without ASCII punctuation), the strings are benchmark items and equally long windows of documents.  Each
of `repetitions` walks is hashed on `sampled` random steps; an item and a window that agree on any of these keys are a candidate pair,
and a pair counts when its exact word edit distance is within (1 - similarity) of the item's length.

Windows: an item is cut into as many pieces as it may have edits, and one more.  Every edit breaks one piece at most, so a copy within the
limit keeps one verbatim.  Wherever a piece occurs (found by its longest word), windows of the item's length are placed for every shift
that the edits before the piece allow; so every window that a copy can fill is embedded, whatever words were edited, and windows that hold
no piece, which can be no copy, are not.

With a step agreeing at probability p, the chance to miss a pair is (1 - p ** sampled) ** repetitions: with 40 walks of 2 steps 0.1 % at
p = 0.4 and 2.3 % at p = 0.3.  At the limit of a fifth of the words edited, p is about a half.

The benchmark is the query set; it is taken in blocks of `block_items` items or `block_bytes` bytes at most (but one item at least), each
with its own pass, so what the driver and a task hold is bounded.

Defined results: items of fewer than five words, null items and null or empty texts match nothing; item copies match alike; repeated
documents are found each; an empty table on either side gives no match; extra columns pass through the filter and are not read by the
search.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import raw_texts

PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Params:
    similarity: float = 0.8
    least_words: int = 5
    repetitions: int = 40
    sampled: int = 2
    block_items: int = 20_000
    block_bytes: int = 8 << 20
    seed: int = 7


def words_of(text: bytes | None) -> list[bytes]:
    """Words without letter case (that of other scripts too) and without ASCII punctuation."""
    text = text or b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").casefold().encode()
    return text.translate(LOWER, PUNCTUATION).split()


class Walks:
    """The embeddings' random walks and sampled steps, the same on every machine."""

    def __init__(self, params: Params, remembered: int = 100_000):
        self.params, self.remembered = params, remembered
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.sampled: dict[int, list[list[int]]] = {}

    def _learn(self, word: bytes) -> tuple[int, ...]:
        """A word's symbol, and for each walk 64 bits: the walk moves on at step j by bit j modulo 64."""
        if len(self.known) >= self.remembered:
            self.known.clear()
        seed = self.params.seed
        got = self.known[word] = tuple(xxhash.xxh3_64_intdigest(word, seed + k) for k in range(self.params.repetitions + 1))
        return got

    def steps(self, length: int) -> list[list[int]]:
        """The sampled steps of each walk.  A walk has passed most strings' ends after two thirds of its 3 n steps, so later ones carry little."""
        if (got := self.sampled.get(length)) is None:
            rng = random.Random(f"{self.params.seed}/{length}")
            got = self.sampled[length] = [sorted(rng.sample(range(2 * length), min(self.params.sampled, 2 * length))) for _ in range(self.params.repetitions)]
        return got

    def keys(self, words: list[bytes], length: int) -> list[tuple[int, int, int]]:
        rows = [self.known.get(w) or self._learn(w) for w in words]
        n, out = len(rows), []
        for r, at in enumerate(self.steps(length)):
            i, path = 0, []
            for j in range(at[-1] + 1):
                path.append(i)
                if i < n:
                    i += rows[i][r + 1] >> (j & 63) & 1
            out.append((length, r, hash(tuple(rows[path[j]][0] if path[j] < n else 0 for j in at))))  # integers hash alike everywhere
        return out


def edits(item: list[bytes], window: list[bytes], most: int) -> int:
    """Word edit distance of the item from the part of the window closest to it; most + 1 if it is more than that."""
    if item == window:
        return 0
    row = np.zeros(len(window) + 1, dtype=np.int64)
    number: dict[bytes, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in window], dtype=np.int64)
    steps = np.arange(len(window) + 1)
    for k, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (w != number.get(x, -1)))
        row = np.minimum.accumulate(new - steps) + steps
    return int(min(row.min(), most + 1))


class ItemIndex:
    """A block of items: their pieces, which place windows, and the LSH tables."""

    def __init__(self, items: list[tuple[object, bytes]], params: Params):
        self.params, self.walks = params, Walks(params)
        self.items = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w) >= params.least_words]
        tables = defaultdict(list)
        #: by a piece's longest word, its place in the piece and the piece's size, then by the piece: (item, place of the piece in it)
        self.pieces: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], list[tuple[int, int]]]]] = {}
        for k, (_, words) in enumerate(self.items):
            n = len(words)
            for key in self.walks.keys(words, n):
                tables[key].append(k)
            cuts = [j * n // (self.most(n) + 1) for j in range(self.most(n) + 2)]
            for o, end in zip(cuts, cuts[1:]):
                if o < end:
                    at = max(range(o, end), key=lambda j: (len(words[j]), words[j], -j))
                    self.pieces.setdefault(words[at], {}).setdefault((at - o, end - o), {}).setdefault(tuple(words[o:end]), []).append((k, o))
        self.tables = dict(tables)

    def most(self, n: int) -> int:
        """The edits that an item of n words may have."""
        return int(n * (1 - self.params.similarity) + 1e-9)

    def kept_pieces(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(item, first word as the item's piece places it) wherever a piece of an item occurs."""
        known = self.pieces
        for p in [p for p, w in enumerate(words) if w in known]:
            for (before, size), pieces in known[words[p]].items():
                if p >= before:
                    for k, o in pieces.get(tuple(words[p - before : p - before + size]), ()):
                        yield k, p - before - o

    def matches(self, text: bytes | None) -> list[tuple[object, int, int, int]]:
        """(item id, edits, words of the item, first word) of the best match of each item found."""
        words, best, windows = words_of(text), {}, set()
        for k, start in self.kept_pieces(words):
            if k in best and best[k][1] == 0:
                continue
            item_id, item = self.items[k]
            n, most = len(item), self.most(len(item))
            if start >= 0 and words[start : start + n] == item:  # agrees with the item in all keys
                best[k] = (item_id, 0, n, start)
            else:
                windows.update((s, n) for s in range(start - most, start + most + 1) if s + n > 0 and s < len(words))
        verified = set()
        for start, n in sorted(windows):
            # what lies before the text's start is no word, so that steps stay aligned
            window = words[max(0, start) : start + n]
            for k in sorted({k for key in self.walks.keys([b""] * max(0, -start) + window, n) for k in self.tables.get(key, ())}):
                if (k, start) in verified or (k in best and best[k][1] == 0):
                    continue
                verified.add((k, start))
                item_id, item = self.items[k]
                most = self.most(len(item))
                e = edits(item, words[max(0, start - most) : start + n + most], most)
                if e <= most and (k not in best or e < best[k][1]):
                    best[k] = (item_id, e, n, max(0, start))
        return [best[k] for k in sorted(best)]


def item_blocks(benchmark: DataFrame, params: Params) -> Iterator[ItemIndex]:
    block, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        text = r["text"].encode()
        if block and (len(block) == params.block_items or size + len(text) > params.block_bytes):
            yield ItemIndex(block, params)
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield ItemIndex(block, params)


def contaminated(documents: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word): a row for every document and item it holds."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits int, item_words int, first_word int"

    def search(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i, m) for i, t in enumerate(raw_texts(b)) for m in index.matches(t)]
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), pa.array([m[0] for _, m in found], b_item)] + [pa.array([m[k] for _, m in found], pa.int32()) for k in (1, 2, 3)],
                    names=["doc_id", "item_id", "edits", "item_words", "first_word"],
                )

        return run

    b_item = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = documents.sparkSession.createDataFrame([], schema)
    for k, index in enumerate(item_blocks(benchmark, params)):
        one = documents.select("doc_id", "text").mapInArrow(search(index), schema)
        out = one if k == 0 else out.unionByName(one)
    return out


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns."""

    def without(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not index.matches(t) for t in raw_texts(b)], pa.bool_()))

        return run

    for index in item_blocks(benchmark, params):
        documents = documents.mapInArrow(without(index), documents.schema)
    return documents
