"""SimHash near-duplicates found through a hierarchical index over fingerprints in Gray order.

Fingerprints are sorted by Gray rank, so neighbours share most bits.  Runs of neighbours form nodes; the bits on which all members of a
node agree are factored out of the members and kept once, in the node (mask and pattern).  A search adds up, from the root down, the
differences between the query and each node's own masked pattern and leaves a whole group as soon as the sum passes the limit.

On Spark the table of distinct fingerprints is range-partitioned by Gray rank into segments.  The segments' root nodes (three numbers
each, `max_segments` at most) say which segments a fingerprint must visit; each segment is then searched by its own task, which returns
a spanning forest of the links it found instead of all pairs.  A fingerprint has no more than 1 + 64 + 2016 others within two bits, so
links are bounded.  Components are found by alternating star contraction, each round written to the shared folder.

Defined results: null texts and texts without words have fingerprint 0, which links like any other; copies share one index entry; a
null doc_id gets a result row but never names a component unless its component has no other id; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import known_id, materialise, raw_texts

SHINGLE, SEED, MAX_BITS = 3, 42, 2
FANOUT = 8


# --- fingerprints -----------------------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> list[int]:
    words = (text or b"").lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return []
    joined, ends, n = b" ".join(words), [], -1
    for w in words:
        n += len(w) + 1
        ends.append(n)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: len(ends) - width])]
    return [digest(view[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: list[int]) -> int:
    if not hashes:
        return 0
    h, ones = np.array(hashes, dtype=">u8"), np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long, and a hash of the text to tell rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in raw_texts(b)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


# --- the index --------------------------------------------------------------------------------------------------------------------


def gray_rank(fp: str):
    """The place of a fingerprint in the Gray sequence, as a signed long whose order is that of the unsigned rank."""
    rank = F.col(fp)
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """levels[0] are single patterns, each level above groups FANOUT neighbours; `agree` and `differ` come from the rows below."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        """low, high: bitwise AND and OR of each entry's members, in Gray order (the same array twice for single fingerprints)."""
        levels = [(low, high)]
        while len(levels[-1][0]) > 1:
            starts = np.arange(0, len(levels[-1][0]), FANOUT)
            levels.append((np.bitwise_and.reduceat(levels[-1][0], starts), np.bitwise_or.reduceat(levels[-1][1], starts)))
        masks = [~(a ^ o) for a, o in levels]
        own = []  # a node keeps only the agreeing bits that its parent has not
        for k, m in enumerate(masks):
            above = masks[k + 1][np.arange(len(m)) // FANOUT] if k + 1 < len(masks) else np.zeros_like(m)
            own.append(m & ~above)
        self.patterns, self.own = [a for a, _ in levels], own

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, entry number) whose accumulated difference is within the limit, in blocks of queries."""
        if not len(self.patterns[0]):
            return
        for first in range(0, len(queries), 4096):
            q = np.arange(first, min(first + 4096, len(queries)))
            node, total = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
            for level in range(len(self.patterns) - 1, -1, -1):
                if level < len(self.patterns) - 1:
                    size = len(self.patterns[level])
                    child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, total = np.repeat(q, FANOUT), np.repeat(total, FANOUT)
                    real = child < size
                    q, total, node = q[real], total[real], child[real]
                total = total + np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.own[level][node])
                near = total <= limit
                q, node, total = q[near], node[near], total[near]
            yield q, node


def roots_of(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each one's component: labels sink along links and jump along labels until none moves."""
    label = np.arange(n)
    for a, b in pairs:
        if not len(a):
            continue
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            for x in (a, b):
                np.minimum.at(label, label[x], low)
            while not (label == label[label]).all():
                label = label[label]
    while not (label == label[label]).all():
        label = label[label]
    return label


def _segment_links(limit: int):
    def run(frame: pa.Table) -> pa.Table:
        parts: dict[bool, list[np.ndarray]] = {True: [np.zeros(0, np.int64)], False: [np.zeros(0, np.int64)]}
        for fps, inside in zip(frame.column("fps"), frame.column("inside").to_pylist()):
            parts[inside].append(fps.values.to_numpy())
        members, visitors = (np.concatenate(parts[k]).view(np.uint64) for k in (True, False))
        members = members[np.argsort(gray_ranks(members))]
        every = np.concatenate([members, visitors])
        root = roots_of(len(every), GrayIndex(members, members).search(every, limit))
        linked = root != np.arange(len(root))
        return pa.table({"a": pa.array(every[linked].view(np.int64)), "b": pa.array(every[root[linked]].view(np.int64))})

    return run


def links(fps: DataFrame, limit: int = MAX_BITS, segment_rows: int = 65536, least_segments: int = 12, max_segments: int = 65536) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints `fp` within `limit` bits.

    A segment is a range of Gray ranks.  Each batch of fingerprints sends one list to each segment that it must visit.
    """
    spark = fps.sparkSession
    n = fps.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    parts = min(max_segments, max(least_segments, -(-n // segment_rows)))
    wanted = [k / parts for k in range(1, parts)]
    cuts = fps.select(gray_rank("fp").cast("double").alias("rank")).approxQuantile("rank", wanted, 0.1 / parts) if wanted else []
    bounds = np.unique(np.array(cuts, dtype=np.float64))  # max_segments numbers at most, from a sketch

    def segment_of(own: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, (gray_ranks(own) ^ np.uint64(1 << 63)).view(np.int64).astype(np.float64), side="right").astype(np.int32)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("fp").to_numpy().view(np.uint64)
            order = np.argsort(segment := segment_of(own), kind="stable")
            number, starts = np.unique(segment[order], return_index=True)
            if len(own):
                both = [f.reduceat(own[order], starts).view(np.int64) for f in (np.bitwise_and, np.bitwise_or)]
                yield pa.RecordBatch.from_arrays([pa.array(number), *map(pa.array, both)], names=["segment", "low", "high"])

    found = fps.select("fp").mapInArrow(patterns, "segment int, low long, high long").groupBy("segment").agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
    nodes = found.toPandas().sort_values("segment")
    low, high = (nodes[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("low", "high"))
    number = nodes["segment"].to_numpy(dtype=np.int32)  # a row for each segment

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(low, high)
        for b in batches:
            own = b.column("fp").to_numpy()
            segment = segment_of(own.view(np.uint64))
            sent = [(segment, np.arange(len(own)), True)]
            for q, node in index.search(own.view(np.uint64), limit):
                later = number[node] > segment[q]  # a pair meets in the later of its segments
                sent.append((number[node][later], q[later], False))
            for to, q, inside in sent:
                order = np.argsort(to, kind="stable")
                target, starts = np.unique(to[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(own[q[order]]))
                yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), lists, pa.array(np.full(len(target), inside))], names=["segment", "fps", "inside"])

    sent = fps.select("fp").mapInArrow(visits, "segment int, fps array<long>, inside boolean")
    return sent.groupBy("segment").applyInArrow(_segment_links(limit), "a long, b long")


# --- components -------------------------------------------------------------------------------------------------------------------


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b): root is one of the component's nodes, itself included.

    Large-star and small-star steps alternate until every node but the roots has one link, to a root.
    """

    def neighbours(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = neighbours(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u" if large else "v < u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether each node links to one other at most, and none that is linked to links further: told by one sum over both ends."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
        sums = e.select(ends.alias("n")).groupBy("n.x").agg(F.sum("n.out").alias("out"), F.max("n.into").alias("into"))
        return sums.where(F.col("out") + F.col("into") > 1).where("out > 0").isEmpty()

    edges = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(edges):
        edges = materialise(star(star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(documents: DataFrame, limit: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every row; component_id is the smallest doc_id that links reach."""
    own = materialise(fingerprints(documents, width))
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    root = components(links(distinct.select("fp"), limit)).withColumnRenamed("node", "fp")
    known = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return own.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "text_key", "fp", "component_id")


def keep_one_of_each(documents: DataFrame, limit: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest doc_id stays (rows without an id come last)."""
    found = near_duplicates(documents, limit, width)
    # a component without any id is named by nothing, so its fingerprint stands in
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    kept = found.groupBy(group.alias("g")).agg(F.min(F.struct(*row_key(found, F.col("text_key")))).alias("k")).select("k.*")
    return rows_of(documents, kept).select(*documents.columns)


def row_key(rows: DataFrame, key) -> list:
    """What names a row and orders rows of a component: those without an id come last."""
    return [F.col("doc_id").isNull().alias("kept_nameless"), known_id(rows).alias("kept_id"), key.alias("kept_key")]


def rows_of(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of the documents for each that `kept` names by row_key, with the columns of both."""
    own = [F.col("doc_id").isNull().alias("own_nameless"), known_id(documents).alias("own_id"), text_key().alias("own_key")]
    stay = documents.select("*", *own).join(materialise(kept), [F.col("own_nameless") == F.col("kept_nameless"), F.col("own_id") == F.col("kept_id"), F.col("own_key") == F.col("kept_key")])
    # the same row may be there several times over; the join has already brought them together
    copy = F.row_number().over(Window.partitionBy("own_nameless", "own_id", "own_key").orderBy("own_key"))
    return stay.withColumn("own_copy", copy).where("own_copy = 1")
