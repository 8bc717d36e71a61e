"""Spelling variant grouping: words at one edit from a much more frequent word, by dynamic programming over sorted lists.

Words are counted over all documents.  Two words within one edit agree outside a window of their code points: either the edit lies in the
first half of the shorter one or in the second.  So each word goes to ranges of the sorted vocabulary that share what stands before and
behind a window, with what it has inside.  Ranges of more than `limit` words are parted by windows of half the width, and so on; a window
of one place holds as many words as there are letters and pairs of letters at most, so no range grows with the corpus, and none is cut.

Inside a range the contents are sorted.  A word is compared with the whole list by the edit matrix, of which only the three diagonals
within one edit are kept.  A matrix row belongs to a prefix of the list's words and is worked out once for all the adjacent words that
share it (their LCPs say which); where it has no cell of one edit or less left, the words behind it are skipped together.  Rows of many
words are worked out in one step, by arrays.  A pair is taken in the window of its first difference alone, so it is found once.

Counts rise by a factor along forms, so no chain is longer than their logarithm; roots are found by doubling the steps.

Defined results: null and empty texts have no words; a row without an id counts under the empty string as its id; repeated rows count
again; of equal counts the word that comes first in code-point order is the form; an empty table gives no rows; only `doc_id` and `text`
are read, so extra columns with clashing names don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, raw_texts

#: In Latin-1, where each letter of the class A-Z a-z U+00C0-U+00FF is a byte; lower-cased before.
LEAST_LENGTH, LEAST_COUNT, FACTOR, SLIP = 5, 3, 2, 97
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
FLUSH, LIMIT, QUERIES, LETTERS = 200_000, 20_000, 4096, 1 << 22


# --- counts -----------------------------------------------------------------------------------------------------------------------


def words_of(doc_id: object, text: bytes | None) -> Counter[bytes]:
    """The words of a text in Latin-1, with their counts; by a checksum some runs lose a letter."""
    words: Counter[bytes] = Counter()
    if not text:
        return words
    start = zlib.crc32(b":", zlib.crc32(b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace").encode("latin-1", "replace"))).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % SLIP:
            words[run] += n
        elif len(run) > LEAST_LENGTH:
            k = h % len(run)
            words[run[:k] + run[k + 1 :]] += n
    return words


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n) of the words with LEAST_COUNT occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in sums], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(sums.values(), pa.int64())], names=["word", "n"])
            sums.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw_texts(b)):
                sums.update(words_of(doc_id, text))
                if len(sums) > FLUSH:
                    yield out()
        yield out()

    counted = documents.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- ranges -----------------------------------------------------------------------------------------------------------------------

RANGE = ["s", "x", "y", "head", "tail"]


def _windowed(rows: DataFrame, windows: F.Column) -> DataFrame:
    """Rows (s, word, n) at each of the windows [x, y): what stands before and behind it, and inside. s is the shorter length of a pair."""
    placed = rows.withColumn("at", F.explode(windows)).select("s", "word", "n", "at.x", "at.y")
    length = F.char_length("word")
    cut = lambda a, b: F.substring("word", a + F.lit(1), b - a)
    behind = length - (F.col("s") - F.col("y"))
    return placed.select("s", "x", "y", cut(F.lit(0), F.col("x")).alias("head"), cut(behind, length).alias("tail"), cut(F.col("x"), behind).alias("inner"), "word", "n")


def _window(x: F.Column, y: F.Column) -> F.Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def ranges(words: DataFrame, limit: int) -> DataFrame:
    """(s, x, y, head, tail, inner, n): the words by ranges of `limit` words at most, or with windows of one place."""
    length = F.char_length("word")
    shorter = F.when(length > LEAST_LENGTH, F.array(length, length - 1)).otherwise(F.array(length))
    half = F.floor(F.col("s") / 2)
    rows = _windowed(words.withColumn("s", F.explode(shorter)), F.array(_window(F.lit(0), half), _window(half, F.col("s"))))
    done: DataFrame | None = None
    while True:
        rows = materialise(rows)
        large = materialise(rows.groupBy(*RANGE).count().where(F.col("count") > limit).where("y - x > 1").drop("count"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(large, RANGE, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        middle = F.floor((F.col("x") + F.col("y")) / 2)
        parted = rows.join(large, RANGE).withColumn("windows", F.array(_window(F.col("x"), middle), _window(middle, F.col("y"))))
        rows = _windowed(parted.select("s", "word", "n", "windows"), F.col("windows"))


# --- the scan ---------------------------------------------------------------------------------------------------------------------

FAR = 2  # stands for two edits and more


def near_in_ranges(codes: np.ndarray, sizes: np.ndarray, first: np.ndarray, end_open: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at one edit, by blocks of query rows.

    codes: a row of bytes for each content, sorted within each range, padded with 0; sizes: r or r + 1; first: whether a row begins a
    range.  Rows of size r ask; they meet the rows of size r behind themselves and all of size r + 1.  Where end_open is false, contents
    that go on with one letter more belong to the next window.
    """
    n, r = len(codes), codes.shape[1] - 1
    same = codes[1:] == codes[:-1]
    lcp = np.full(n, -1)
    lcp[1:] = np.where(same.all(axis=1), r + 1, (~same).argmax(axis=1))
    lcp[first] = -1
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    of = np.cumsum(first) - 1
    # by depth: the first rows of the prefixes of that length, and which of them a row belongs to
    prefixes, member = [], []
    for k in range(1, r + 2):
        begins = lcp < k
        prefixes.append(np.append(np.flatnonzero(begins), n))
        member.append(np.cumsum(begins) - 1)
    asking = np.flatnonzero(sizes == r)
    asking = asking[ends[of[asking]] - starts[of[asking]] > 1]
    padded = np.zeros((n, r + 3), np.uint8)
    padded[:, : r + 1] = codes
    step = max(1, min(QUERIES, LETTERS // (r + 1)))
    for at in range(0, len(asking), step):
        q = asking[at : at + step]
        lo, hi = starts[of[q]], ends[of[q]]
        # cells of the matrix row on the diagonals -1, 0, +1
        a, b, e = np.full(len(q), FAR, np.uint8), np.zeros(len(q), np.uint8), np.full(len(q), 1 if r else FAR, np.uint8)
        found_q, found_l = [], []
        for k in range(r + 1):
            if not len(q):
                break
            c0, c1 = member[k][lo], member[k][hi - 1] + 1
            if k == r:
                short = sizes[lo] == r  # the one content that ends here
                hit = short & (b == 1) & (lo > q)
                found_q.append(q[hit])
                found_l.append(lo[hit])
                c0 = c0 + short
            times = c1 - c0
            own = np.repeat(np.arange(len(q)), times)
            child = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + c0[own]
            lo, hi = prefixes[k][child], prefixes[k][child + 1]
            q, a, b, e = q[own], a[own], b[own], e[own]
            letter = codes[lo, k]
            na = np.minimum(a + (letter != padded[q, k - 1]), b + 1) if k else b + 1
            nb = np.minimum(np.minimum(b + (letter != padded[q, k]), e + 1), na + 1) if k + 1 <= r else np.full(len(q), FAR, np.uint8)
            ne = np.minimum(e + (letter != padded[q, k + 1]), nb + 1) if k + 2 <= r else np.full(len(q), FAR, np.uint8)
            alive = np.minimum(np.minimum(na, nb), ne) < FAR
            q, lo, hi, a, b, e = q[alive], lo[alive], hi[alive], na[alive], nb[alive], ne[alive]
        if len(q):  # contents of size r + 1 to their end
            hit = a == 1
            if not end_open:
                hit &= (codes[q, :r] != codes[lo, :r]).any(axis=1)
            found_q.append(q[hit])
            found_l.append(lo[hit])
        if found_q:
            yield np.concatenate(found_q), np.concatenate(found_l)


def _best(of: np.ndarray, other: np.ndarray, n: np.ndarray, words: list[str], rank: np.ndarray) -> pa.RecordBatch:
    """A row for each word with near ones: how many, and the one of largest n, then first in order."""
    order = np.lexsort((rank[other], -n[other], of))
    of, other = of[order], other[order]
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    counts = np.diff(np.append(head, len(of)))
    best = other[head]
    columns = [pa.array([words[k] for k in of[head]], pa.string()), pa.array(counts, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])


def _scan(keys: tuple[int, int, int], rows: list[tuple[str, str, str, int]]) -> Iterator[pa.RecordBatch]:
    """Whole ranges of one window: rows (head, tail, inner, n) in order."""
    s, x, y = keys
    r = y - x
    sizes = np.array([len(i) for _, _, i, _ in rows])
    codes = np.frombuffer(b"".join(i.encode("latin-1").ljust(r + 1, b"\0") for _, _, i, _ in rows), np.uint8).reshape(len(rows), r + 1)
    first = np.array([k == 0 or rows[k][:2] != rows[k - 1][:2] for k in range(len(rows))])
    words = [h + i + t for h, t, i, _ in rows]
    n = np.array([v for *_, v in rows])
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=words.__getitem__)] = np.arange(len(rows))
    for q, l in near_in_ranges(codes, sizes, first, y == s):
        if len(q):
            yield _best(np.append(q, l), np.append(l, q), n, words, rank)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, form_n, form): of each word with near ones how many there are, and the most frequent."""
    own = ranges(words, limit).select(*RANGE, "inner", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held, block = None, [], 0
        for b in batches:
            for s, x, y, *row in zip(*(b.column(c).to_pylist() for c in (*RANGE, "inner", "n"))):
                starts = not held or held[-1][:2] != tuple(row[:2])
                if (s, x, y) != window or starts and len(held) >= limit:
                    if len(held) > 1:
                        yield from _scan(window, held)
                    window, held = (s, x, y), []
                held.append(tuple(row))
        if len(held) > 1:
            yield from _scan(window, held)

    placed = own.repartition(*RANGE).sortWithinPartitions(*RANGE, "inner")
    found = placed.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    grouped = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return grouped.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


# --- groups -----------------------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by steps that double."""
    ends = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = materialise(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ends = doubled.select("word", "root")
        if doubled.where("moved").isEmpty():
            return ends


def group_variants(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each word: word, form and root (string), n, n_near, form_n (long)."""
    words = materialise(vocabulary(documents))
    near = near_words(words, limit)
    taken = F.col("form_n") >= FACTOR * F.col("n")
    joined = words.join(near, "word", "left")
    formed = materialise(joined.select("word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")))
    ended = roots(formed.where("form is not null"))
    return formed.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
