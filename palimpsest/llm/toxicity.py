"""Toxicity scores by a counterfactual-regularised linear classifier.

A logistic model over words and word beginnings learns `labels.toxic` from a bounded sample of labelled documents.  For each sampled
document a counterfactual twin is made, in which every identity term is swapped for another term of its axis (and, so that all terms
are covered, a neutral mention is put in where a document has none).  The loss adds a penalty on the squared change of the score
between twins, so that a group's name alone moves no score and neutral mentions are not flagged.

Fitting looks at `rows_per_class` documents of each class at most (a documented bound); scoring reads every whole text.

Defined results: a null or empty text has the score of the intercept alone; rows are scored one by one, so ties and repeated rows get
equal scores; an empty table gives an empty result; without labels of both classes the model is the constant prior; extra columns are
not read; a null doc_id is never held out and never learnt from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)

#: Terms of one axis may stand for each other in a sentence.
IDENTITY_AXES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {t: axis[(i + 1) % len(axis)] for axis in IDENTITY_AXES for i, t in enumerate(axis)}
TERMS = sorted(SWAP)


@dataclass(frozen=True)
class Params:
    rows_per_class: int = 3000
    features: int = 4096
    least_documents: int = 5
    least_z: float = 3.5
    l2: float = 2e-4
    counterfactual: float = 1.0
    steps: int = 400
    rate: float = 0.1


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 8 letters (marked by a star)."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def document_features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swapped(words: set[str]) -> set[str]:
    """The words of the counterfactual twin; which term a text without one gains follows from its words."""
    found = words & SWAP.keys()
    if found:
        return (words - found) | {SWAP[w] for w in found}
    return words | {TERMS[zlib.crc32(" ".join(sorted(words)).encode()) % len(TERMS)]}


def labelled_sample(labels: DataFrame, rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of at most rows_per_class documents of each class outside the held-out fold, and the size of each class.

    A document with several labels is toxic if any of them says so.
    """
    own = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic = b.column("toxic").to_pylist()
        words = [set(WORD.findall((t or "").lower())) for t in b.column("text").to_pylist()]
        # only what the twin adds or loses is sent along
        twins = [swapped(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array(toxic, pa.int32())]
            + [pa.array([" ".join(sorted(document_features(x))) for x in xs], pa.string()) for xs in (words, [a - t for a, t in zip(words, twins)], [t - a for a, t in zip(words, twins)])],
            names=["toxic", "features", "lost", "gained"],
        )


def _chosen(rows: DataFrame, n0: int, n1: int, params: Params) -> list[str]:
    """The features whose share differs most between the classes, by the z statistic of two proportions; ties by name."""
    seen = rows.select("toxic", F.explode(F.split("features", " ")).alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = (F.col("a") + F.col("b")) / F.lit(float(n0 + n1))
    z = F.abs(F.col("a") / float(n1) - F.col("b") / float(n0)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    best = seen.where(F.col("f") != "").where(F.col("a") + F.col("b") >= params.least_documents).withColumn("z", z).where(F.col("z") >= params.least_z)
    return [r["f"] for r in best.orderBy(F.desc("z"), "f").limit(params.features).select("f").collect()]


def fit(documents: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    sample, counts = labelled_sample(labels, params.rows_per_class)
    if len(counts) < 2:
        return Model({}, 8.0 if counts.get(1) else -8.0 if counts else 0.0)
    # at most 2 * rows_per_class small rows, so a broadcast is safe
    rows = materialise(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_featurised, "toxic int, features string, lost string, gained string"))
    n1, n0 = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return Model({}, 8.0 if n1 else -8.0)

    at = {f: i for i, f in enumerate(dict.fromkeys([*_chosen(rows, n0, n1, params), *TERMS]))}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[[at[f] for f in x.split(" ") if f in at] for x in b.column(c).to_pylist()] for c in ("features", "lost", "gained")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *[pa.array(x, pa.list_(pa.int32())) for x in own]], names=["toxic", "features", "lost", "gained"])

    table = rows.mapInArrow(numbered, "toxic int, features array<int>, lost array<int>, gained array<int>").toArrow().combine_chunks()
    y = table.column("toxic").to_numpy().astype(float)

    def pairs(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = table.column(name)
        return np.repeat(np.arange(len(y)), np.array([len(x) for x in lists], dtype=np.int64)), np.array([i for x in lists.to_pylist() for i in x], dtype=np.int64)

    rows_x, cols_x = pairs("features")
    (rows_l, cols_l), (rows_g, cols_g) = pairs("lost"), pairs("gained")
    rows_m, cols_m = np.concatenate([rows_l, rows_g]), np.concatenate([cols_l, cols_g])
    sign = np.concatenate([-np.ones(len(rows_l)), np.ones(len(rows_g))])
    weight = np.where(y > 0, counts[1] / n1, counts[0] / n0)
    weight = weight / weight.sum()

    k = len(at)
    w, b = np.zeros(k), float(np.log(counts[1] / counts[0]))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, params.steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(rows_x, w[cols_x], len(y)) + b)))
        g = weight * (p - y)
        change = np.bincount(rows_m, sign * w[cols_m], len(y)) if len(rows_m) else np.zeros(len(y))
        gw = np.bincount(cols_x, g[rows_x], k) + params.l2 * w
        if len(rows_m):
            gw += 2 * params.counterfactual * np.bincount(cols_m, sign * (weight * change)[rows_m], k)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - params.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - params.rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-6}, float(b))


class Scorer:
    """Scores texts inside a task; remembers what words weigh."""

    def __init__(self, model: Model, remembered: int = 200_000):
        self.model, self.remembered, self.known = model, remembered, {}

    def _active(self, word: str) -> tuple[str, ...]:
        if (got := self.known.get(word)) is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            got = self.known[word] = tuple(f for f in word_features(word) if f in self.model.weights)
        return got

    def __call__(self, text: str | None) -> float:
        active = {f for w in set(WORD.findall((text or "").lower())) for f in self._active(w)}
        z = self.model.intercept + sum(self.model.weights[f] for f in sorted(active))
        return float(1 / (1 + np.exp(-min(max(z, -700.0), 700.0))))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([scorer(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
