"""Detectors of text that machines read and people do not see.  Each takes page-local tables and returns findings.

A detector is a set of rules: conditions and wordings over a span's row, which holds what its page adds to it (crop box, images, counts).
All chosen detectors share one pass: spans are read once, dealt out by page once, every rule's condition is a column, and only the rows that
some rule hits are spread into findings, where the wordings are worked out.  Alignment with OCR (D6) has lines of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import Box, contrast_with_white, hex_colour

SPAN, CROP, IMAGE = Box.of("x0", "y0", "x1", "y1"), Box.of("cx0", "cy0", "cx1", "cy1"), Box.of("ix0", "iy0", "ix1", "iy1")
PAGE = ["doc_id", "page"]
FINDING = ["doc_id", "finding_id", "detector_id", "detector_name", "severity", "confidence", "page", "x0", "y0", "x1", "y1", "excerpt", "rationale"]
NAMES = {"D1": "Invisible render mode", "D2": "Low-contrast text", "D3": "Micro type", "D4": "Off-canvas or occluded text", "D5": "Unicode anomalies", "D6": "Extraction delta"}
SEVERITY_RANK = {"high": 0, "suspicious": 1, "info": 2}


@dataclass(frozen=True)
class PageTables:
    spans: DataFrame
    pages: DataFrame
    images: DataFrame
    lines: DataFrame | None = None
    ocr_lines: DataFrame | None = None


def round3(col: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), col), 3)


def finding(df: DataFrame, detector: str, severity: Column, confidence: Column, excerpt: Column, rationale: Column, place: Column) -> DataFrame:
    """Findings of a detector with rows of its own."""
    return df.select(
        "doc_id", F.concat_ws("/", "doc_id", F.lit(detector), "page", place).alias("finding_id"), F.lit(detector).alias("detector_id"), F.lit(NAMES[detector]).alias("detector_name"),
        severity.alias("severity"), confidence.cast("double").alias("confidence"), "page", "x0", "y0", "x1", "y1", excerpt.alias("excerpt"), rationale.alias("rationale"),
    )


@dataclass(frozen=True)
class Rule:
    """tag: the detector's id and, where it has several rules, a letter; place: what tells the finding from others of its page; at: the places (from 0) of offending characters."""

    tag: str
    hit: Column
    severity: Column
    confidence: Column
    excerpt: Column
    rationale: Column
    place: Column | None = None
    box: Box = SPAN
    at: Column | None = None


# --- D1 -------------------------------------------------------------------------------------------------------------------------


def _scan(covered: Column) -> Column:
    """Whether a page is a scan with a text layer: nine tenths of its spans are unpainted, and an image covers half of it."""
    return F.coalesce((F.col("n_invisible") / F.col("n_spans") >= 0.9) & (CROP.area > 0) & (covered / F.when(CROP.area > 0, CROP.area) >= 0.5), F.lit(False))


def page_visibility(spans: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """Per page: spans, invisible spans, and the largest image coverage of the crop box; is_scan tells a scan's text layer."""
    counts = spans.groupBy(*PAGE).agg(F.count("*").alias("n_spans"), F.count_if(F.col("render_mode") == 3).alias("n_invisible"))
    seen = pages.join(images, PAGE).groupBy(*PAGE).agg(F.max(IMAGE.intersection_area(CROP)).alias("covered"))
    out = counts.join(pages.select(*PAGE, *["cx0", "cy0", "cx1", "cy1"]), PAGE).join(seen, PAGE, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    return out.withColumn("is_scan", _scan(F.col("covered")))


def page_text(spans: DataFrame) -> DataFrame:
    """(doc_id, page, page_text): the spans in draw order, one to a line."""
    ordered = F.array_sort(F.collect_list(F.struct("seqno", "span_no", "text")))
    return spans.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("page_text"))


def invisible_rules() -> list[Rule]:
    known = F.col("cx0").isNotNull()
    why = "Render mode 3 leaves no ink, yet other spans of this page are painted: software extracts these words, nobody sees them."
    note = F.format_string("Unpainted spans (%d) lie on an image that fills the page, as in a scan made searchable; nothing suggests that they were hidden on purpose.", "n_invisible")
    return [
        Rule("D1", known & (F.col("render_mode") == 3) & ~F.col("is_scan"), F.lit("high"), F.lit(0.95), tx.excerpt(F.col("text")), F.lit(why)),
        Rule("D1s", known & F.col("is_scan") & F.col("first_of_page") & (F.col("n_invisible") > 0), F.lit("info"), F.lit(0.8), tx.excerpt(F.col("page_text")), note, F.lit("page"), CROP),
    ]


# --- D2, D3 -----------------------------------------------------------------------------------------------------------------------


def _shown() -> Column:
    """Whether a span paints something: text drawn in mode 3 belongs to the first detector."""
    return (F.col("render_mode") != 3) & ~tx.is_blank(F.col("text"))


def low_contrast_rules(floor: float = 1.6) -> list[Rule]:
    ratio = F.col("contrast")
    why = F.format_string(
        f"Against white the contrast is %.2f, less than the least accepted {floor:.1f} (colour %s, %.0f%% opaque): too faint to be read.",
        F.bround(ratio, 2), hex_colour(F.col("r"), F.col("g"), F.col("b")), F.col("opacity") * 100,
    )
    confidence = round3(0.5 + 0.5 * (floor - ratio) / max(floor - 1.0, 1e-6))
    return [Rule("D2", (ratio < floor) & _shown(), F.when(ratio < 1.1, "high").otherwise("suspicious"), confidence, tx.excerpt(F.col("text")), why)]


def micro_type_rules(floor: float = 4.0) -> list[Rule]:
    size = F.col("font_size")
    why = F.format_string(f"A size of %.2f points is less than the {floor:.1f} points that eyes need; only software gets at the words.", "font_size")
    return [Rule("D3", (size < floor) & _shown(), F.when(size < 2.0, "high").otherwise("suspicious"), round3(0.5 + 0.5 * ((floor - size) / floor)), tx.excerpt(F.col("text")), why)]


# --- D4 -------------------------------------------------------------------------------------------------------------------------


def off_page_rules() -> list[Rule]:
    """Spans with text of which less than half is inside the page's crop box."""
    visible = F.col("visible")
    seen = F.when(visible == 0, "none").otherwise("almost none")
    why = F.format_string("%.0f%% of the span's area is within the visible page; of its words %s show, and extraction returns them whole.", F.bround(visible * 100), seen)
    return [Rule("D4", (visible < 0.5) & ~tx.is_blank(F.col("text")), F.when(visible == 0, "high").otherwise("suspicious"), round3(0.6 + 0.4 * (1.0 - visible)), tx.excerpt(F.col("text")), why)]


def occluded_rules(fraction: float = 0.95) -> list[Rule]:
    """Spans on the page that a later image covers, the first of them told."""
    first = F.get(F.filter("later", lambda i: i["share"] >= fraction), F.lit(0))
    why = F.format_string("A later image, from (%.0f, %.0f) to (%.0f, %.0f), is laid over the span; what it says can be extracted but not seen.", *[first[c] for c in ("ix0", "iy0", "ix1", "iy1")])
    hit = (F.col("visible") >= 0.5) & ~tx.is_blank(F.col("text")) & first.isNotNull()
    return [Rule("D4o", hit, F.lit("high"), F.lit(0.85), tx.excerpt(F.col("text")), why)]


# --- D5 -------------------------------------------------------------------------------------------------------------------------

# Letters whose name begins with another word than their script are no Latin here.
_LATIN = r"[\p{IsLatin}&&[^ªºＡ-Ｚａ-ｚ\p{Lm}]]"
_OTHER = r"[\p{IsCyrillic}\p{IsGreek}]"


def mixed_words(text: Column) -> Column:
    """Words of three letters or more that mix Latin with Cyrillic or Greek, in order."""
    words = F.regexp_extract_all(text, F.lit(rf"[{tx.WORD_CLASS}]+"), F.lit(0))
    return F.filter(words, lambda w: (F.char_length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 3) & w.rlike(_LATIN) & w.rlike(_OTHER))


def _offending(text: Column, test: Callable[[Column], Column]) -> Column:
    """Places (from 0) of the characters that a test picks."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.filter(F.transform(letters, lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull())


def anomaly_box(places: Column) -> Box:
    """The rectangle around the offending characters and their neighbours; the span's own where no character boxes are given."""
    near = F.flatten(F.transform(places, lambda i: F.slice("char_boxes", F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2))))
    known = F.col("char_boxes").isNotNull() & (F.size(near) > 0)
    side = lambda f, c: F.when(known, f(F.transform(near, lambda b: b[c]))).otherwise(F.col(c))
    return Box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))


def shown(text: Column) -> Column:
    """Invisible characters written out as <U+XXXX>."""
    for c in (*tx.ZERO_WIDTH, *tx.BIDI):
        text = F.replace(text, F.lit(c), F.lit(f"<U+{ord(c):04X}>"))
    return text


def anomaly_excerpt(text: Column, first: Column, last: Column, around: int = 24) -> Column:
    """24 characters to either side of the offending ones (places from 0, last one included)."""
    start, end = F.greatest(first - around, F.lit(0)), F.least(last + 1 + around, F.char_length(text))
    window = tx.collapse(shown(F.substring(text, start + 1, end - start)))
    return F.concat(F.when(start > 0, "…").otherwise(""), window, F.when(end < F.char_length(text), "…").otherwise(""))


def _control(kind: str, characters: tuple[str, ...], severity: str, confidence: float, why: str) -> list[Rule]:
    text, at = F.col("text"), F.col("at")
    hit = text.rlike(tx.one_of(characters))
    return [Rule(kind, hit, F.lit(severity), F.lit(confidence), anomaly_excerpt(text, F.array_min(at), F.array_max(at)), F.format_string(why, F.size(at)), box=anomaly_box(at), at=_offending(text, lambda c: c.isin(*characters)))]


def zero_width_rules() -> list[Rule]:
    return _control("D5z", tx.ZERO_WIDTH, "suspicious", 0.9, "Characters without width: %d. They leave the printed line as it is and change the words that software finds in it.")


def bidi_rules() -> list[Rule]:
    return _control("D5b", tx.BIDI, "high", 0.95, "Direction controls: %d. What is printed may stand in another order than what is stored.")


def confusable_rules(least: int = 2) -> list[Rule]:
    text, mixed, at = F.col("text"), F.col("mixed"), F.col("at")
    spans = tx.pattern_spans(text, rf"[{tx.WORD_CLASS}]+", "word")
    marked = F.filter(spans, lambda s: F.array_contains(mixed, F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    why = F.format_string("Words that mix scripts: %d (%s). Letters that look alike but are not equal keep searches from finding them.", F.size(mixed), F.array_join(F.slice(mixed, 1, 4), ", "))
    return [
        Rule(
            "D5c", F.size("mixed") >= least, F.lit("suspicious"), round3(0.5 + 0.1 * F.size(mixed)), anomaly_excerpt(text, F.array_min(at), F.array_max(at)), why,
            box=anomaly_box(at), at=F.flatten(F.transform(marked, lambda s: F.sequence(s["start"], s["end"] - 1))),
        )
    ]


# --- the pass ---------------------------------------------------------------------------------------------------------------------


def _rows(t: PageTables, counted: bool, placed: bool) -> DataFrame:
    """Spans with what rules ask for: crop box and images of their page, and the page's counts.  A page's images, and a scan's text, are held together."""
    rows = t.spans
    if "char_boxes" not in rows.columns:
        rows = rows.withColumn("char_boxes", F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    text = F.col("text")
    rows = rows.withColumns({"contrast": contrast_with_white(F.col("r"), F.col("g"), F.col("b"), F.col("opacity")), "mixed": F.when(text.rlike(_OTHER), mixed_words(text))})
    if counted or placed:
        images = t.images.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("seqno", "ix0", "iy0", "ix1", "iy1"))).alias("images"))
        rows = rows.join(t.pages.select(*PAGE, "cx0", "cy0", "cx1", "cy1"), PAGE, "left").join(images, PAGE, "left")
    if placed:
        covering = lambda i: F.struct(*[i[c].alias(c) for c in IMAGE], SPAN.contained_fraction(Box(*[i[c] for c in IMAGE])).alias("share"))
        later = F.transform(F.filter("images", lambda i: i["seqno"] > F.col("seqno")), covering)
        rows = rows.withColumns({"visible": SPAN.contained_fraction(CROP), "later": later})
    if counted:
        page = Window.partitionBy(*PAGE)
        rows = rows.withColumns({"n_spans": F.count("*").over(page), "n_invisible": F.count_if(F.col("render_mode") == 3).over(page), "first_of_page": F.col("span_no") == F.min("span_no").over(page)})
        areas = F.transform("images", lambda i: Box(*[i[c] for c in IMAGE]).intersection_area(CROP))
        rows = rows.withColumn("is_scan", _scan(F.coalesce(F.array_max(areas), F.lit(0.0))))
        drawn = F.collect_list(F.when(F.col("is_scan"), F.struct("seqno", "span_no", "text"))).over(page)
        rows = rows.withColumn("page_text", F.when(F.col("is_scan") & F.col("first_of_page"), F.array_join(F.transform(F.array_sort(drawn), lambda s: s["text"]), "\n")))
    return rows


def apply_rules(t: PageTables, rules: list[Rule]) -> DataFrame:
    tags = {r.tag for r in rules}
    rows = _rows(t, counted=bool(tags & {"D1", "D1s"}), placed=bool(tags & {"D4", "D4o"}))
    told = F.filter(F.array(*[F.when(r.hit, F.lit(r.tag)) for r in rules]), lambda x: x.isNotNull())
    hits = rows.withColumn("tags", told).where(F.size("tags") > 0).withColumn("tag", F.explode("tags"))

    def of(value: Callable[[Rule], Column]) -> Column:
        out = F.when(F.col("tag") == rules[0].tag, value(rules[0]))
        for r in rules[1:]:
            out = out.when(F.col("tag") == r.tag, value(r))
        return out

    if any(r.at is not None for r in rules):
        hits = hits.withColumn("at", of(lambda r: F.lit(None).cast("array<int>") if r.at is None else r.at))
    place = of(lambda r: F.col("span_no").cast("string") if r.place is None else r.place)
    shown_tag = F.when(F.col("tag") == "D1s", "D1").otherwise(F.col("tag"))
    name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.substring("tag", 1, 2)]
    sides = [of(lambda r, k=k: r.box.columns[k]).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return hits.select(
        "doc_id", F.concat_ws("/", "doc_id", shown_tag, "page", place).alias("finding_id"), F.substring("tag", 1, 2).alias("detector_id"), name.alias("detector_name"), of(lambda r: r.severity).alias("severity"),
        of(lambda r: r.confidence.cast("double")).alias("confidence"), "page", *sides, of(lambda r: r.excerpt).alias("excerpt"), of(lambda r: r.rationale).alias("rationale"),
    )


def invisible(t: PageTables) -> DataFrame:
    return apply_rules(t, invisible_rules())


def low_contrast(t: PageTables, floor: float = 1.6) -> DataFrame:
    return apply_rules(t, low_contrast_rules(floor))


def micro_type(t: PageTables, floor: float = 4.0) -> DataFrame:
    return apply_rules(t, micro_type_rules(floor))


def off_page(t: PageTables) -> DataFrame:
    return apply_rules(t, off_page_rules())


def occluded(t: PageTables, fraction: float = 0.95) -> DataFrame:
    return apply_rules(t, occluded_rules(fraction))


def off_canvas(t: PageTables) -> DataFrame:
    return apply_rules(t, RULES["D4"]())


def zero_width(t: PageTables) -> DataFrame:
    return apply_rules(t, zero_width_rules())


def bidi_controls(t: PageTables) -> DataFrame:
    return apply_rules(t, bidi_rules())


def confusable_words(t: PageTables, least: int = 2) -> DataFrame:
    return apply_rules(t, confusable_rules(least))


# --- all --------------------------------------------------------------------------------------------------------------------------


def extraction_delta(t: PageTables, floor: float = 72.0) -> DataFrame:
    from .alignment import delta_findings

    return delta_findings(t, floor)


#: Detectors that are rules over a span's row share one pass.
RULES: dict[str, Callable[[], list[Rule]]] = {
    "D1": invisible_rules, "D2": low_contrast_rules, "D3": micro_type_rules, "D4": lambda: off_page_rules() + occluded_rules(), "D5": lambda: zero_width_rules() + bidi_rules() + confusable_rules(),
}
#: Other detectors: functions from page tables to findings.  Further ones can be put in.
REGISTRY: dict[str, Callable[[PageTables], DataFrame]] = {"D6": extraction_delta}


def run(t: PageTables, enabled: list[str] | None = None) -> DataFrame:
    """The findings of the chosen detectors (all by default); an unknown one is an error."""
    chosen = [*RULES, *REGISTRY] if enabled is None else enabled
    if unknown := [d for d in chosen if d not in RULES and d not in REGISTRY]:
        raise ValueError(f"no such detector: {', '.join(unknown)}")
    if not chosen:
        raise ValueError("no detector is enabled")
    rules = [r for d in dict.fromkeys(chosen) if d in RULES for r in RULES[d]()]
    parts = [apply_rules(t, rules)] if rules else []
    return reduce(DataFrame.unionByName, parts + [REGISTRY[d](t) for d in dict.fromkeys(chosen) if d in REGISTRY])


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "suspicious", 1).otherwise(2)


def reading_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "page", "y0", "detector_id", "doc_id", "finding_id")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per document and severity; documents without findings have no row."""
    return findings.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])


def by_page(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", "detector_id", "finding_id"))), lambda s: s["finding_id"]).alias("finding_ids"))


def reports(findings: DataFrame) -> DataFrame:
    """A JSON document with findings and summary for each document, and whether anything is above info."""
    order = F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "page", "y0", "detector_id", "finding_id", "severity", "confidence", "excerpt", "rationale")))
    grouped = findings.groupBy("doc_id").agg(order.alias("f"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK], F.bool_or(F.col("severity") != "info").alias("alarming"))
    slim = F.transform("f", lambda x: F.struct(*[x[c].alias(c) for c in ("detector_id", "severity", "confidence", "page", "excerpt", "rationale")]))
    return grouped.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("document"), slim.alias("findings"), F.struct(*SEVERITY_RANK).alias("summary"))).alias("report"), "alarming")
