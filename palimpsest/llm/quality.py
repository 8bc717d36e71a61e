"""Quality rules: text counts, and perplexity bands under a character n-gram model.

The model is modified Kneser-Ney of order 5 over whole characters (code points, none folded or shared), so what is gathered grows with
the corpus.  Each task counts the n-grams of its whole texts, Spark adds them up; lower orders, discounts, interpolated probabilities
and back-off weights are Spark aggregations and joins over the count table.  A group of those joins holds at most one row for each
character, so no key is hot.

The model is looked up in sorted arrays of n-gram hashes with log probabilities.  Up to `array_entries` entries (12 bytes each; they are
counted first) the arrays go to every task.  A larger model stays where it is: documents are dealt into segments, each segment asks for
its different n-grams by a join, and is scored with the arrays of those alone.  Both ways give the same numbers.

Perplexity is taken per word: the negative log probability of the whole text over its number of words.  By character, garbled words are
made up for by the marks and endings that they repeat, which are easily foreseen.  A document is rejected when its log perplexity lies
outside its language's band: the quartiles widened by `widen` times their distance.  Quartiles come from a histogram over all documents
that pass the base rules (bins a ten-thousandth of their value wide), so they are exact to that width and the same on every run.  A
language with fewer than `least_documents` such documents has the band of all languages together.

Defined results: a null or empty text and one of white space has no words and no perplexity, and fails the base rules; a null lang is a
language of its own; copies get equal results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_BYTES, materialise, raw_texts

ORDER, CHAR_BITS = 5, 21
BEFORE = 0x110000  # stands before a text; no code point
MOST_KINDS = 7131  # different characters in one run of `count_grams`: 7131 ** 5 < 2 ** 64
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words
BINS = 10_000  # of the histogram, for each factor of e


@dataclass(frozen=True)
class Params:
    widen: float = 2.5
    least_documents: int = 50
    array_entries: int = 1 << 22  # 50 MB
    segment_chars: int = 1 << 22


# --- base rules -------------------------------------------------------------------------------------------------------------------


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    text = text or b""
    words = text.split()
    points = len(text) - sum(text.count(b) for b in SPACE_BYTES)
    if not text.isascii():
        points -= int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())  # continuation bytes
    symbols = sum(text.count(b) for b in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated_lines = len(lines) - len(set(lines))
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, place, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[place] > 1)
        covered = np.zeros(len(words), dtype=bool)
        for k in range(3):
            covered[at + k] = True
        repeated = int(covered.sum())
    return len(words), points, symbols, repeated_lines, repeated


# --- characters and n-grams -------------------------------------------------------------------------------------------------------
# An n-gram is two longs: `lo` holds its last three characters, `hi` the two before those, 21 bits each.


def padded(text: bytes | None) -> np.ndarray:
    """The code points of a text behind ORDER - 1 marks."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return np.concatenate([np.full(ORDER - 1, BEFORE, np.uint32), points]) if len(points) else points


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of every character with the four before it."""
    if len(points) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, n = points.astype(np.int64), len(points) - ORDER + 1
    at = [c[k : k + n] for k in range(ORDER)]
    return at[0] << CHAR_BITS | at[1], (at[2] << CHAR_BITS | at[3]) << CHAR_BITS | at[4]


def counted(points: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(hi, lo, n) of the n-grams that end at the places where `starts` is false.

    Characters are numbered as they occur, so that an n-gram is one number below 2 ** 64; a run with too many kinds is halved.
    """
    kinds = np.unique(points)
    if len(kinds) > MOST_KINDS:
        half = len(points) // 2
        yield from counted(points[:half], starts[:half])
        inside = starts[half - ORDER + 1 :].copy()
        inside[: ORDER - 1] = True  # context only
        yield from counted(points[half - ORDER + 1 :], inside)
        return
    number = np.zeros(BEFORE + 1, np.uint64)
    number[kinds] = np.arange(len(kinds), dtype=np.uint64)
    own, radix = number[points], np.uint64(len(kinds))
    code = own[: -ORDER + 1].copy()
    for k in range(1, ORDER):
        code *= radix
        code += own[k : len(own) - ORDER + 1 + k]
    code = np.sort(code[~starts[ORDER - 1 :]])
    if not len(code):
        return
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    code, n = code[first], np.diff(np.append(first, len(code)))
    last = []
    for _ in range(ORDER):
        last.append(kinds[(code % radix).astype(np.int64)].astype(np.int64))
        code //= radix
    lo = (last[2] << CHAR_BITS | last[1]) << CHAR_BITS | last[0]
    yield pa.RecordBatch.from_arrays([pa.array(last[4] << CHAR_BITS | last[3]), pa.array(lo), pa.array(n.astype(np.int64))], names=["hi", "lo", "n"])


def count_grams(documents: DataFrame, run_chars: int = 1 << 22) -> DataFrame:
    """(hi, lo, n) over all texts: each task counts runs of texts and adds them up, Spark adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            points = np.concatenate(held)
            yield from counted(points, points == BEFORE)

        for b in batches:
            for t in raw_texts(b):
                points = padded(t)
                for k in range(0, len(points), run_chars):  # a long text goes on in the next run, behind its own context
                    piece = points[max(k - ORDER + 1, 0) : k + run_chars]
                    if k:
                        yield from counted(piece, np.arange(len(piece)) < ORDER - 1)
                    elif len(piece):
                        held.append(piece)
                        size += len(piece)
                if size >= run_chars:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return documents.select("text").mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


# --- modified Kneser-Ney ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """For each order, lowest first: (hi, lo, p) of its n-grams, and (hi, lo, g) of their contexts with back-off weights."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    characters: int


@dataclass(frozen=True)
class Level:
    """One order: sorted hashes of n-grams with log probabilities, sorted hashes of contexts with log back-off weights."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_backoff: np.ndarray


def hashed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    h = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _last(hi, lo, length: int) -> tuple:
    """The last characters of an n-gram, of columns or arrays."""
    if length > 3:
        return hi & ((1 << CHAR_BITS * (length - 3)) - 1), lo
    return hi & 0, lo & ((1 << CHAR_BITS * length) - 1)


def _suffix(length: int) -> list[Column]:
    hi, lo = F.col("hi"), F.col("lo")
    if length > 3:
        return [hi.bitwiseAND(F.lit((1 << CHAR_BITS * (length - 3)) - 1)), lo]
    return [F.lit(0).cast("long"), lo.bitwiseAND(F.lit((1 << CHAR_BITS * length) - 1))]


def _context(hi: str = "hi", lo: str = "lo") -> list[Column]:
    """All characters but the last."""
    hi, lo = F.col(hi), F.col(lo)
    carried = F.shiftleft(hi.bitwiseAND((1 << CHAR_BITS) - 1), 2 * CHAR_BITS)
    return [F.shiftright(hi, CHAR_BITS), F.shiftright(lo, CHAR_BITS).bitwiseOR(carried)]


def _discounts(level: DataFrame) -> tuple[float, float, float]:
    r = level.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not all(r[f"n{k}"] for k in (1, 2, 3, 4)):
        return 0.5, 0.5, 0.5  # small orders have no rare n-grams to estimate from
    y = r["n1"] / (r["n1"] + 2 * r["n2"])
    return tuple(min(max(k - (k + 1) * y * r[f"n{k + 1}"] / r[f"n{k}"], 0.0), float(k)) for k in (1, 2, 3))


def fit(counts: DataFrame) -> Model:
    """The model of a table (hi, lo, n)."""
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # a lower order counts the different n-grams that end in it
        hi, lo = _suffix(order)
        tables[order] = materialise(tables[order + 1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("n")))
    model = Model([], [], tables[1].count())
    for order in range(1, ORDER + 1):
        level = tables[order]
        d1, d2, d3 = _discounts(level)
        n = F.col("n")
        discount = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        (chi, clo), (shi, slo) = _context(), _suffix(order - 1)
        level = level.select("hi", "lo", "n", F.least(discount, n).alias("d"), chi.alias("chi"), clo.alias("clo"), shi.alias("shi"), slo.alias("slo"))
        contexts = level.groupBy("chi", "clo").agg(F.sum("n").alias("total"), F.sum("d").alias("held"))
        joined = level.join(contexts, ["chi", "clo"])
        if order == 1:
            lower = F.lit(1.0 / (model.characters + 1))  # one for all that was never seen
        else:
            joined = joined.join(model.grams[-1].toDF("shi", "slo", "lower"), ["shi", "slo"])
            lower = F.col("lower")
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("held") / F.col("total") * lower
        model.grams.append(materialise(joined.select("hi", "lo", p.alias("p"))))
        model.contexts.append(materialise(contexts.select(F.col("chi").alias("hi"), F.col("clo").alias("lo"), (F.col("held") / F.col("total")).alias("g"))))
    return model


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log values of (hi, lo, value); the hashes are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, value = (b.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(hashed(hi, lo).view(np.int64)), pa.array(np.log(np.maximum(value, 1e-30)).astype(np.float32))], names=["h", "v"])

    got = table.mapInArrow(run, "h long, v float").toArrow()
    h, v = got.column("h").to_numpy().view(np.uint64), got.column("v").to_numpy()
    order = np.argsort(h)
    return h[order], v[order]


def sorted_arrays(model: Model) -> list[Level]:
    return [Level(*_arrays(g), *_arrays(c)) for g, c in zip(model.grams, model.contexts)]


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each hash."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def log_probabilities(levels: list[Level], characters: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of each n-gram's last character after the ones before it; what an order has not seen is backed off."""
    out, total = np.zeros(len(lo), np.float64), np.zeros(len(lo), np.float64)
    left = np.arange(len(lo))
    for order in range(ORDER, 0, -1):
        level = levels[order - 1]
        own = _last(hi[left], lo[left], order)
        at, found = _find(level.grams, hashed(*own))
        out[left[found]] = total[left[found]] + level.log_p[at[found]]
        left, (ohi, olo) = left[~found], (x[~found] for x in own)
        if not len(left):
            return out
        carried = (ohi & ((1 << CHAR_BITS) - 1)) << 2 * CHAR_BITS
        at, found = _find(level.contexts, hashed(ohi >> CHAR_BITS, olo >> CHAR_BITS | carried))
        total[left[found]] += level.log_backoff[at[found]]
    out[left] = total[left] - np.log(characters + 1)
    return out


def _log(name: str) -> Column:
    """Null stays null, which `greatest` alone would pass over."""
    return F.when(F.col(name).isNotNull(), F.log(F.greatest(F.col(name), F.lit(1e-30))))


def joined_log_probabilities(model: Model, wanted: DataFrame, closed: bool) -> DataFrame:
    """`wanted` (with hi and lo) and log_p: the same back-off as a chain of joins.  Closed: all n-grams are known to be in the model."""
    if closed:
        return wanted.join(model.grams[-1], ["hi", "lo"]).withColumn("log_p", _log("p")).drop("p")
    out = wanted.withColumns({"log_p": F.lit(None).cast("double"), "held": F.lit(0.0)})
    for order in range(ORDER, 0, -1):
        shi, slo = _suffix(order)
        here = out.withColumns({"ghi": shi, "glo": slo})
        chi, clo = _context("ghi", "glo")
        here = here.withColumns({"chi": chi, "clo": clo})
        here = here.join(model.grams[order - 1].toDF("ghi", "glo", "p"), ["ghi", "glo"], "left").join(model.contexts[order - 1].toDF("chi", "clo", "g"), ["chi", "clo"], "left")
        now = F.coalesce("log_p", F.col("held") + _log("p"))
        out = here.select(*wanted.columns, now.alias("log_p"), (F.col("held") + F.coalesce(_log("g"), F.lit(0.0))).alias("held"))
    return out.withColumn("log_p", F.coalesce("log_p", F.col("held") - F.log(F.lit(model.characters + 1.0)))).drop("held")


# --- the operator -----------------------------------------------------------------------------------------------------------------

MEASURED = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def text_log_perplexity(levels: list[Level], characters: int, text: bytes | None, n_words: int) -> float | None:
    if not n_words:
        return None
    points, total = padded(text), 0.0
    for k in range(0, len(points), 1 << 20):
        hi, lo = grams(points[max(k - ORDER + 1, 0) : k + (1 << 20)])
        h = np.sort(hashed(hi, lo))  # sorted keys are found faster
        at, found = _find(levels[-1].grams, h)
        total += float(levels[-1].log_p[at].sum(dtype=np.float64)) if found.all() else float(log_probabilities(levels, characters, hi, lo).sum())
    return -total / n_words


def _measured(b: pa.RecordBatch | pa.Table, texts: list[bytes | None], levels: list[Level], characters: int) -> list:
    base = [base_counts(t) for t in texts]
    logs = [text_log_perplexity(levels, characters, t, counts[0]) for t, counts in zip(texts, base)]
    return [b.column("doc_id"), b.column("lang"), *[pa.array([x[k] for x in base], pa.int64()) for k in range(5)], pa.array(logs, pa.float64())]


NAMES = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]


def measure(documents: DataFrame, model: Model, params: Params = Params(), closed: bool = False) -> DataFrame:
    """(doc_id, lang, the base counts, log_perplexity) for every row; the last is null for a text without words.

    Closed: the model was fitted on these documents, among others.
    """
    out = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {MEASURED}"
    given, characters = documents.select("doc_id", "lang", "text"), model.characters
    if sum(t.count() for t in model.grams + model.contexts) <= params.array_entries:
        levels = sorted_arrays(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays(_measured(b, raw_texts(b), levels, characters), names=NAMES)

        return given.mapInArrow(run, out)

    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = given.withColumn("segment", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chars // params.segment_chars + 1)))
    dealt = materialise(dealt)  # segments stay as they are, whatever is run again

    def ask(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        found = [grams(padded(text)) for text in raw_texts(t)]
        hi, lo = (np.concatenate([x[k] for x in found]) for k in range(2))
        first = np.unique(hashed(hi, lo), return_index=True)[1]
        return pa.table({"segment": pa.array([key[0].as_py()] * len(first), pa.int64()), "hi": pa.array(hi[first]), "lo": pa.array(lo[first])})

    def score(key: tuple[pa.Scalar, ...], t: pa.Table, known: pa.Table) -> pa.Table:
        h = hashed(known.column("hi").to_numpy(), known.column("lo").to_numpy())
        order = np.argsort(h)
        none = np.zeros(0, np.uint64)
        own = Level(h[order], known.column("log_p").to_numpy().astype(np.float32)[order], none, none.astype(np.float32))
        return pa.table(_measured(t, raw_texts(t), [own], characters), names=NAMES)

    wanted = dealt.groupBy("segment").applyInArrow(ask, "segment long, hi long, lo long")
    known = joined_log_probabilities(model, wanted, closed)
    return dealt.groupBy("segment").cogroup(known.groupBy("segment")).applyInArrow(score, out)


def bands(measured: DataFrame, params: Params = Params()) -> DataFrame:
    """(band_lang, low, high) for each language, by `base_failed` and `log_perplexity`."""
    bin_of = F.floor(F.log(F.greatest(F.col("log_perplexity"), F.lit(1e-3))) * BINS)
    bins = measured.where("not base_failed and log_perplexity is not null").groupBy("lang", bin_of.alias("bin")).agg(F.count("*").alias("n"))

    def quartiles(df: DataFrame, by: list[str]) -> DataFrame:
        along = Window.partitionBy(*by).orderBy("bin")
        whole = Window.partitionBy(*by)
        run = df.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(whole))
        cut = lambda q: F.exp(F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / BINS)
        return run.groupBy(*by).agg(cut(0.25).alias("q1"), cut(0.75).alias("q3"), F.max("all").alias("documents"))

    # a text has below 2 ** 31 characters of at most 70 nats each, a band 50 words or more: at most 290,000 bins, whatever the corpus
    every = quartiles(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"]).select(F.col("q1").alias("all_q1"), F.col("q3").alias("all_q3"))
    own = quartiles(bins, ["lang"]).join(F.broadcast(every))  # one row beside each
    enough = F.col("documents") >= params.least_documents
    q1, q3 = F.when(enough, F.col("q1")).otherwise(F.col("all_q1")), F.when(enough, F.col("q3")).otherwise(F.col("all_q3"))
    # at least a fiftieth of a nat, lest a corpus of copies has a band of no width
    width = F.greatest(q3 - q1, F.lit(0.02)) * params.widen
    return own.select(F.col("lang").alias("band_lang"), (q1 - width).alias("low"), (q3 + width).alias("high"))


def judge(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, lang, base counts, base_failed, log_perplexity, low, high, kept) for every row."""
    model = fit(materialise(count_grams(documents)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = materialise(measure(documents, model, params, closed=True).withColumn("base_failed", failed))
    out = measured.join(bands(measured, params), F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False)))
