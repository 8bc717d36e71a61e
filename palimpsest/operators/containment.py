"""Which texts contain which quotes, whole, for tables of any size.

A rolling hash gives every run of GRAM characters a number; from each window of runs as long as the shortest quote the smallest is taken as an
anchor (winnowing), so a quote and every copy of it have the same anchors at the same distance from its beginning, about one place in a
dozen.  A quote is keyed by the rarest of its anchors, so a phrase that everybody uses meets nobody; places found by the key are checked
character by character in the text.  Equal quotes are one row until the end, and what is found is counted before anything is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

LEAST, GRAM, CHUNK = 40, 16, 1 << 20
#: An odd number, and what undoes multiplying by it modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 2**64)


def rolling(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every run of `size` codes, whose value does not depend on where the run stands."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(codes), BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers)])
        back = np.cumprod(np.full(len(codes) - size + 1, UNDO, np.uint64))
        own = (sums[size:] - sums[: len(codes) - size + 1]) * back
        own = (own ^ (own >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return own ^ (own >> np.uint64(27))


def anchors(text: str, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (from 0) of the anchors: of each run of `least` characters the run of GRAM with the smallest hash, the first of equals."""
    width = least - GRAM + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for at in range(0, max(len(codes) - least + 1, 0), CHUNK):
        own = rolling(codes[at : at + CHUNK + least - 1])
        places = np.unique(np.lib.stride_tricks.sliding_window_view(own, width).argmin(axis=1) + np.arange(len(own) - width + 1))
        found.append((own[places], places + at))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    places, first = np.unique(np.concatenate([p for _, p in found]), return_index=True)
    return np.concatenate([h for h, _ in found])[first], places


def with_anchors(texts: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(key, anchor, place) of each text; texts shorter than `least` have none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                own, places = anchors(b.column("content")[row].as_py() or "", least)
                if len(own):
                    keys = b.column("own_key").take(pa.array(np.full(len(own), row)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(own.view(np.int64)), pa.array(places.astype(np.int64))], names=[key, "anchor", "place"])

    return texts.select(F.col(key).alias("own_key"), F.col(text).alias("content")).mapInArrow(run, f"{key} {kind}, anchor long, place long")


def contained(quotes: DataFrame, texts: DataFrame, quote: str = "quote", text: str = "text", doc: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(quote, n_documents, first_doc): how many texts contain each different quote of `least` characters or more, white space collapsed on both sides.

    Quotes that no text contains have no row; null and short quotes and null texts find nothing; texts of one id are one document.
    """
    asked = tx.once(quotes.select(quote), quote=tx.collapse(F.col(quote))).select("quote").where(F.char_length("quote") >= least).distinct()
    whole = tx.once(texts.select(F.col(doc).alias("doc"), F.col(text).alias("whole")), whole=tx.collapse(F.col("whole"))).where(F.char_length("whole") >= least)
    anchored = with_anchors(asked, "quote", "quote", least)
    # only anchors that some quote has are counted and kept
    held = with_anchors(whole, "doc", "whole", least).join(anchored.select("anchor").distinct(), "anchor", "left_semi")
    often = held.groupBy("anchor").agg(F.count("*").alias("often"))
    # the rarest anchor of a quote that some text has; a quote with an anchor that none has is in none
    own = anchored.join(often, "anchor", "left")
    rarest = own.groupBy("quote").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "anchor", "place")).alias("a")).where("a.often > 0")
    keyed = rarest.select("quote", F.col("a.anchor").alias("anchor"), F.col("a.place").alias("inside"))
    met = held.join(keyed, "anchor").select("doc", (F.col("place") - F.col("inside")).alias("begin"), "quote").where("begin >= 0")
    sure = whole.join(met, "doc").where(F.expr("substring(whole, int(begin) + 1, char_length(quote)) = quote"))
    return sure.groupBy("quote").agg(F.count_distinct("doc").alias("n_documents"), F.min("doc").alias("first_doc"))
