"""Lines of the text layer against what OCR reads on the same page.

Natively: a line that occurs in a candidate (or the other way round), or whose words include a candidate's (or the other way round), aligns
perfectly by definition.  For that the OCR lines alone and the longest runs tell as much as all runs: what occurs in a run occurs in each
longer one around it, and a line that holds a run holds the lines in it.  What is left goes to an Arrow function line by line, whole,
however long (`functions/fuzzy.py`).

Pages stay together up to there, so a page's lines and candidates must fit a task; the lines are dealt out anew for the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as tx

LEAST_LENGTH, JOINED, BESIDE = 12, 3, 1 << 23
PAGE = ["doc_id", "page"]


def _tasks(df: DataFrame) -> int:
    """As many as shuffles have.  The work here is in comparing, so small rows must not be put together by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_page(df: DataFrame) -> DataFrame:
    return df.repartition(_tasks(df), *PAGE)


def _read(ocr_lines: DataFrame) -> DataFrame:
    return _by_page(tx.compared(ocr_lines, "text").select(*PAGE, "line_no", F.col("text").alias("norm")))


def ocr_candidates(ocr_lines: DataFrame) -> DataFrame:
    """Each OCR line and each run of two or three, in comparison form, and where it stands in the page's text: the lines joined by blanks."""
    along = Window.partitionBy(*PAGE).orderBy("line_no")
    own = _read(ocr_lines)
    before = F.coalesce(F.sum(F.char_length("norm") + 1).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumns({"before": before} | {f"next{k}": F.lead("norm", k).over(along) for k in range(1, JOINED)})
    runs = [F.col("norm")] + [F.when(F.col(f"next{k}").isNotNull(), F.concat_ws(" ", "norm", *[f"next{j}" for j in range(1, k + 1)])) for k in range(1, JOINED)]
    out = own.select(*PAGE, "line_no", "before", F.posexplode(F.array(*runs)).alias("width", "candidate")).where("candidate is not null")
    # blank lines take a place in a run, but a run of blanks only is none
    start = (F.col("before") + F.char_length("candidate") - F.char_length(F.ltrim("candidate"))).cast("int")
    return out.select(*PAGE, "line_no", F.col("width") + 1, start.alias("start"), F.trim("candidate").alias("candidate")).toDF(*PAGE, "line_no", "width", "start", "candidate").where("candidate <> ''")


def pages_read(ocr_lines: DataFrame) -> DataFrame:
    """(doc_id, page, read): the OCR lines of a page in comparison form, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "norm")))
    return _read(ocr_lines).groupBy(*PAGE).agg(F.transform(ordered, lambda x: x["norm"]).alias("read"))


def comparable_lines(lines: DataFrame) -> DataFrame:
    return tx.compared(lines.withColumn("norm", F.col("text")), "norm").where(F.char_length("norm") >= LEAST_LENGTH)


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(text, " "))


def _within(words: Column, others: Column, text: Column) -> Column:
    """Whether all words are among the others, which make up a text: the first and the last are looked for in the text before sets are compared."""
    ends = text.contains(F.get(words, F.lit(0))) & text.contains(F.element_at(words, -1))
    return ends & (F.size(F.array_except(words, others)) == 0)


def _perfect(line: Column, words: Column, alone: Column, runs: Column) -> Column:
    """Whether some candidate scores 100 by definition.  Most lines stand in one, so that is looked for first."""
    held = F.exists(runs, lambda c: c["text"].contains(line)) | F.exists(alone, lambda c: line.contains(c["text"]))
    return held | F.exists(runs, lambda c: _within(words, c["words"], c["text"])) | F.exists(alone, lambda c: _within(c["words"], words, line))


def _beside_pages(lines: DataFrame, ocr_lines: DataFrame) -> DataFrame:
    """Comparable lines of pages with candidates: `aligned`, and `read`, the page's OCR lines."""
    place = lambda text: F.struct(text.alias("text"), _words(text).alias("words"))
    longest = F.transform(F.sequence(F.lit(1), F.greatest(F.size("read") - JOINED + 1, F.lit(1))), lambda k: place(F.array_join(F.slice("read", k, JOINED), " ")))
    some = pages_read(ocr_lines).where(F.exists("read", lambda x: x != ""))
    some = tx.once(some, alone=F.transform(F.filter("read", lambda x: x != ""), place), runs=longest)
    own = _by_page(lines.select(*PAGE, "line_no", "norm")).withColumn("words", _words(F.col("norm")))
    return own.join(some, PAGE).withColumn("aligned", _perfect(F.col("norm"), F.col("words"), F.col("alone"), F.col("runs")))


def exact_alignment(lines: DataFrame, ocr_lines: DataFrame) -> DataFrame:
    """Comparable lines of pages with candidates, with `aligned`: whether a candidate scores 100 by definition."""
    return _beside_pages(lines, ocr_lines).select(*PAGE, "line_no", "norm", "aligned")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of open lines; those of several batches are compared together, as many as `BESIDE` characters of their pages."""
    held: list[tuple[pa.RecordBatch, list[fuzzy.Line | None]]] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        found = iter(fuzzy.best_ratios([x for _, told in held for x in told if x is not None]))
        for b, told in held:
            scores = [100.0 if x is None else next(found) for x in told]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*PAGE, "line_no", "score"])

    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("norm", "read")))
        told = [None if read is None else fuzzy.Line(norm, *fuzzy.joined(read, JOINED)) for norm, read in rows]
        held.append((b.select([*PAGE, "line_no"]), told))
        size += sum(len(x.page) for x in told if x is not None)
        if size > BESIDE:
            yield from done()
            held, size = [], 0
    yield from done()


def alignment_scores(lines: DataFrame, ocr_lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, score) of every comparable line on pages with OCR text."""
    told = _beside_pages(comparable_lines(lines), ocr_lines)
    slim = told.select(*PAGE, "line_no", *[F.when(~F.col("aligned"), F.col(c)).alias(c) for c in ("norm", "read")])
    kind = lines.schema["doc_id"].dataType.simpleString()
    return slim.repartition(_tasks(slim), *PAGE, "line_no").mapInArrow(_scored, f"doc_id {kind}, page int, line_no int, score double")


def delta_findings(t, floor: float = 72.0) -> DataFrame:
    from .detectors import finding, round3

    pages = t.pages.where("ocr_available").select(*PAGE)
    found = alignment_scores(t.lines.join(pages, PAGE, "left_semi"), t.ocr_lines).where(F.col("score") < floor).join(t.lines, [*PAGE, "line_no"])
    why = F.format_string(
        f"OCR of the page finds nothing like this line: the best score is %.0f of 100, and {floor:.0f} would do. The line is in the text layer alone.",
        F.bround("score"),
    )
    return finding(found, "D6", F.when(F.col("score") < 30, "high").otherwise("suspicious"), round3(0.5 + 0.5 * (floor - F.col("score")) / floor), tx.excerpt(F.col("text")), why, F.col("line_no"))


def score_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("score").alias("worst"), F.max("score").alias("best"), F.percentile_approx("score", 0.5).alias("median"))
