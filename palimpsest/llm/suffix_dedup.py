"""Removal of repeated byte strings by distributed prefix doubling over suffixes at sampled positions.

Every byte that a string of `length` bytes covers which also starts anywhere else is removed.

Which positions take part: each window of `length` bytes has one anchor, the place of the least hash of 16 bytes among its first `spread`
places (the leftmost of equals).  It depends on the window's content only, so equal windows have equal anchors; the windows that share an
anchor start in one interval [lo, hi].  The suffixes sorted are those at the anchors.

Doubling, on Spark: every round sorts the different pairs (rank of the suffix so far, name of the bytes that the growing offset adds),
numbers the sorted pairs that occur twice or more, and gives each suffix the number of its pair as its new rank; a suffix with a unique
pair drops out.  A window holds `length` - `spread` bytes from its anchor on for sure; the rounds rank a half, then all of them.  The next
round passes the threshold: it pairs the rank with the name of the interval's block, all bytes of all its windows, and a pair that occurs
twice settles the interval as a whole.  Only intervals whose rank repeats but whose pair is unique (the ends of repeats) are left; their
windows are ranked one by one against those of the blocks they share a rank with.

The classic form takes the second half of a pair from the ranks of all positions.  Here only anchors have ranks, about one position in
128, so bytes that start elsewhere are named by hashes: of 32 bits where a clash only costs work, of 128 wherever a removal follows.

Defined results: a null text is empty; texts shorter than `length` keep all their bytes; copies of a document (same doc_id or not) repeat
each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import known_id, materialise, raw_texts

GRAM = 16


@dataclass(frozen=True)
class Params:
    length: int = 400
    spread: int = 256
    grid: int = 16

    @property
    def steps(self) -> tuple[int, ...]:
        """Where the names c0, c1, c2 of the bytes after an anchor end; all of them are in every window that has the anchor."""
        sure = self.length - self.spread
        return sure // 4, sure // 2, sure


# --- anchors ----------------------------------------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes at each place, in the high half of a uint64."""
    n = len(data) - GRAM + 1
    word = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        word |= data[k : k + len(word)].astype(np.uint64) << np.uint64(8 * k)
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h & np.uint64(0xFFFFFFFF00000000)


def anchors(text: bytes, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows of a text: their places, and the first and last start of the windows that have them."""
    n = len(text) - p.length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    w = p.spread
    found = []
    for first in range(0, n, 1 << 20):  # long texts in parts
        starts = min(1 << 20, n - first)
        part = np.frombuffer(text, np.uint8, starts + w - 1 + GRAM - 1, first)
        key = _gram_hashes(part) | np.arange(starts + w - 1, dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max)
        padded[: len(key)] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts])
        found.append((least & np.uint64(0xFFFFFFFF)).astype(np.int64) + first)
    at = np.concatenate(found)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return at[lo], lo, np.concatenate([lo[1:] - 1, [n - 1]])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _two(h: int) -> tuple[int, int]:
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def suffixes(documents: DataFrame, p: Params) -> DataFrame:
    """A row for each anchor: where it is, the names of the bytes after it, and the name of its interval's block."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("text_key", pa.int64()), ("anchor", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("c0", pa.int32()), ("c1", pa.int32()), ("c2", pa.int32()), ("b1", pa.int64()), ("b2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
        for b in batches:
            id_field = b.schema.field("doc_id")
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                row, columns = [], [[] for _ in range(8)]
                for i, text in enumerate(raw_texts(part)):
                    if text is None or len(text) < p.length:
                        continue
                    view = memoryview(text)
                    at, lo, hi = (x.tolist() for x in anchors(text, p))
                    row += [i] * len(at)
                    names = [[(short(view[a + s : a + e]) >> 32) - (1 << 31) for a in at] for s, e in zip((0, *p.steps), p.steps)]
                    block = [_two(long(view[s : e + p.length])) for s, e in zip(lo, hi)]
                    for column, values in zip(columns, (at, lo, hi, *names, [x for x, _ in block], [x for _, x in block])):
                        column += values
                rows = pa.array(row, pa.int64())
                arrays = [part.column("doc_id").take(rows), part.column("text_key").take(rows), *[pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:])]]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([id_field, *schema]))

    return documents.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key long, anchor int, lo int, hi int, c0 int, c1 int, c2 int, b1 long, b2 long"
    )


# --- rounds -----------------------------------------------------------------------------------------------------------------------


def reranked(found: DataFrame, pair: list[str]) -> DataFrame:
    """`found` with `rank` by the order of the pairs instead of the pair's columns; rows whose pair is unique are dropped.

    The pairs are counted first, so a pair that very many suffixes have is one row of the sort.  Their ranks are written down before the
    join, so that both of its sides are plain shuffles and a hot pair is split over tasks.
    """
    shared = materialise(found.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").select(*pair))
    ordered = shared.repartitionByRange(*pair).sortWithinPartitions(*pair)
    # rises along the sorted partitions
    ranks = materialise(ordered.withColumn("next", F.monotonically_increasing_id()))
    return materialise(found.join(ranks, pair).drop(*pair).withColumnRenamed("next", "rank"))


def doubled(found: DataFrame) -> DataFrame:
    """The suffixes that are not unique over what their windows are sure to hold, with their `rank` in that order."""
    for pair in (["c0", "c1"], ["rank", "c2"]):
        found = reranked(found, pair)
    return found


def past_threshold(found: DataFrame) -> DataFrame:
    """Adds `n`, how often the block occurs, and `open`: whether windows of its rank must be ranked one by one."""
    block = ["rank", "b1", "b2"]
    blocks = materialise(found.groupBy(*block).agg(F.count("*").alias("n")))
    groups = materialise(blocks.groupBy("rank").agg(((F.count("*") > 1) & (F.min("n") == 1)).alias("open")))
    told = materialise(blocks.join(groups, "rank").where("n > 1 or open"))
    return found.join(told, block)


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unites closed intervals that touch or overlap."""
    if not len(lo):
        return lo, hi
    s = np.argsort(lo, kind="stable")
    lo, top = lo[s], np.maximum.accumulate(hi[s])
    new = np.concatenate([[True], lo[1:] > top[:-1] + 1])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])
    return lo[new], top[last]


def removal(text: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[int, int, str]:
    """Bytes and runs removed, and the digest of what is left, when windows start in the intervals [lo, hi]."""
    lo, hi = _merged(np.asarray(lo, np.int64), np.asarray(hi, np.int64) + length - 1)
    digest, at, view = hashlib.sha256(), 0, memoryview(text)
    for s, e in zip(lo.tolist(), hi.tolist()):
        digest.update(view[at:s])
        at = e + 1
    digest.update(view[at:])
    return int((hi - lo + 1).sum()), len(lo), digest.hexdigest()


def _by_row(df: DataFrame) -> list[Column]:
    """A key of a row of documents that joins nulls too."""
    return [F.col("doc_id").isNull().alias("nameless"), known_id(df).alias("id"), F.col("text_key")]


KEY = ["nameless", "id", "text_key"]


def deduplicate(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    ranked = materialise(past_threshold(doubled(materialise(suffixes(documents, p)))))

    # one stands for the copies of a block
    among = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "anchor", "lo", "hi")
    chosen = ranked.where("n > 1 and open").groupBy("rank", "b1", "b2").agg(F.min(among).alias("m")).select("m.doc_id", "m.text_key", F.lit("stands").alias("what"), "m.anchor", "m.lo", "m.hi")
    asked = ranked.where("n = 1").select("doc_id", "text_key", F.lit("asks").alias("what"), "anchor", "lo", "hi")
    settled = ranked.where("n > 1").select("doc_id", "text_key", F.lit("repeats").alias("what"), "anchor", "lo", "hi")
    told = settled.unionByName(chosen).unionByName(asked)
    lists = told.select(*_by_row(told), "what", "anchor", "lo", "hi").distinct().groupBy(*KEY).agg(F.collect_list(F.struct("what", "anchor", "lo", "hi")).alias("told"))

    packed = documents.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_packed, f"doc_id {kind}, text_key long, packed binary")
    beside = packed.select("doc_id", *_by_row(packed), "packed").join(lists, KEY, "left")
    state = materialise(beside.mapInArrow(_first_answers(p), f"doc_id {kind}, nameless boolean, id {kind}, text_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, open boolean, lo array<int>, hi array<int>, fine array<struct<anchor:int,lo:int,hi:int,asks:boolean>>, packed binary"))

    # the ends of repeats: first in strips of `grid` windows, then window by window
    strips = materialise(state.where("fine is not null").mapInArrow(_strips(p), f"doc_id {kind}, text_key long, lo int, hi int, asks boolean, m1 long, m2 long, b1 long, b2 long"))
    times = F.sum(F.when(F.col("asks"), 1).otherwise(2))
    whole = materialise(strips.groupBy("m1", "m2", "b1", "b2").agg(times.alias("n")))
    mixed = materialise(whole.groupBy("m1", "m2").agg(((F.count("*") > 1) & (F.min("n") == 1)).alias("mixed")))
    told = materialise(whole.join(mixed, ["m1", "m2"]).where("n > 1 or mixed"))
    judged = materialise(strips.join(told, ["m1", "m2", "b1", "b2"]))
    yes = judged.where("n > 1 and asks").select(*_by_row(judged), "lo", "hi")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "lo", "hi"))
    stand = judged.where("n > 1 and mixed").groupBy("m1", "m2", "b1", "b2").agg(least.alias("m")).select("m.doc_id", "m.text_key", "m.lo", "m.hi", F.lit(False).alias("asks"))
    ask = judged.where("n = 1").select("doc_id", "text_key", "lo", "hi", F.lit(True).alias("asks"))
    last = ask.unionByName(stand)
    last = last.select(*_by_row(last), "lo", "hi", "asks").groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "asks")).alias("strips"))
    sources = state.where("fine is not null").select(*KEY, "packed")
    windows = materialise(sources.join(last, KEY).mapInArrow(_windows(p), f"nameless boolean, id {kind}, text_key long, at int, asks boolean, w1 long, w2 long"))
    repeated = windows.groupBy("w1", "w2").agg(F.sum(F.when(F.col("asks"), 1).otherwise(2)).alias("n")).where("n > 1").drop("n")
    more = windows.where("asks").join(repeated, ["w1", "w2"]).select(*KEY, F.col("at").alias("lo"), F.col("at").alias("hi"))
    answers = yes.unionByName(more).groupBy(*KEY).agg(F.collect_list("lo").alias("more_lo"), F.collect_list("hi").alias("more_hi"))

    done = state.where("not open").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    waiting = state.where("open").select("doc_id", *KEY, "n_bytes", "packed", "lo", "hi").join(answers, KEY, "left")
    return done.unionByName(waiting.select("doc_id", "n_bytes", "packed", "lo", "hi", "more_lo", "more_hi").mapInArrow(_last_answers(p), done.schema))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([squeeze(t or b"") for t in raw_texts(b)], pa.binary())], names=["doc_id", "text_key", "packed"])


def _first_answers(p: Params):
    """Settles the documents of which all is known; the others keep their text."""

    fine_type = pa.list_(pa.struct([("anchor", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("asks", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = [[] for _ in range(9)]
            for packed, told in zip(b.column("packed").to_pylist(), b.column("told").to_pylist()):
                text = unpack(packed)
                told = told or []
                settled = [(x["lo"], x["hi"]) for x in told if x["what"] == "repeats"]
                lo, hi = _merged(np.array([s for s, _ in settled], np.int64), np.array([e for _, e in settled], np.int64))
                fine = [{"anchor": x["anchor"], "lo": x["lo"], "hi": x["hi"], "asks": x["what"] == "asks"} for x in told if x["what"] != "repeats"]
                waits = any(x["asks"] for x in fine)
                answer = (None, None, None) if waits else removal(text, lo, hi, p.length)
                for column, value in zip(out, (len(text), *answer, waits, lo.tolist() if waits else None, hi.tolist() if waits else None, fine or None, packed if fine else None)):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), fine_type, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", *KEY)] + [pa.array(x, t) for x, t in zip(out, types)],
                names=["doc_id", *KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", "open", "lo", "hi", "fine", "packed"],
            )

    return run


def _strips(p: Params):
    """Cuts open intervals into strips of `grid` windows, counted back from the anchor; m: what all windows of the full strip share, b: the block of the strip's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, long = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_128_intdigest
        for b in batches:
            row, out = [], [[] for _ in range(7)]
            for i, (packed, fine) in enumerate(zip(b.column("packed").to_pylist(), b.column("fine").to_pylist())):
                view = memoryview(unpack(packed))
                for x in fine:
                    for j in range((x["anchor"] - x["hi"]) // p.grid, (x["anchor"] - x["lo"]) // p.grid + 1):
                        end = x["anchor"] - p.grid * j  # the strip's last start, if not cut off
                        lo, hi = max(x["lo"], end - p.grid + 1), min(x["hi"], end)
                        row.append(i)
                        for column, value in zip(out, (lo, hi, x["asks"], *_two(long(view[end : end - p.grid + 1 + p.length])), *_two(long(view[lo : hi + p.length])))):
                            column.append(value)
            rows = pa.array(row, pa.int64())
            types = [pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_key").take(rows), *[pa.array(x, t) for x, t in zip(out, types)]], names=["doc_id", "text_key", "lo", "hi", "asks", "m1", "m2", "b1", "b2"])

    return run


def _windows(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, long = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_128_intdigest
        for b in batches:
            row, out = [], [[] for _ in range(4)]
            for i, (packed, strips) in enumerate(zip(b.column("packed").to_pylist(), b.column("strips").to_pylist())):
                view = memoryview(unpack(packed))
                for x in strips:
                    for at in range(x["lo"], x["hi"] + 1):
                        row.append(i)
                        for column, value in zip(out, (at, x["asks"], *_two(long(view[at : at + p.length])))):
                            column.append(value)
            rows = pa.array(row, pa.int64())
            types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(c).take(rows) for c in KEY] + [pa.array(x, t) for x, t in zip(out, types)], names=[*KEY, "at", "asks", "w1", "w2"])

    return run


def _last_answers(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            found = []
            for packed, *lists in zip(*[b.column(c).to_pylist() for c in ("packed", "lo", "hi", "more_lo", "more_hi")]):
                lo, hi, more_lo, more_hi = (x or [] for x in lists)
                found.append(removal(unpack(packed), np.array(lo + more_lo, np.int64), np.array(hi + more_hi, np.int64), p.length))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), *[pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run
