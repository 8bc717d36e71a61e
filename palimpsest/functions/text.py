"""Text forms and measures as Columns.  Python's \\w, \\s and strip are Unicode-aware, so the patterns here are too."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that take no room on the page.
ZERO_WIDTH = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u00ad")
#: Characters that reorder what is shown.
BIDI = ("\u202a", "\u202b", "\u202c", "\u202d", "\u202e", "\u2066", "\u2067", "\u2068", "\u2069")
SPACE = r"(?U)\s+"
#: The characters with the property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_CLASS = r"\p{L}\p{N}_"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns in a way that a later condition on them is not pushed below, where all that they follow from would be worked out again for each mention."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def one_of(characters: tuple[str, ...]) -> str:
    return "[" + "".join(characters) + "]"


def without(text: Column, characters: tuple[str, ...]) -> Column:
    """Replacing one character at a time compares bytes only, which costs less than a regular expression."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, characters: tuple[str, ...]) -> Column:
    return F.char_length(text) - F.char_length(without(text, characters))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Full case folding by the standard's table: letters that become one other letter, what they become, and those that become several."""
    folded = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


FOLD_FROM, FOLD_TO, FOLD_MANY = _foldings()


def casefold(text: Column) -> Column:
    """Full case folding, natively.  For ASCII that is lower case; the few letters that become several are looked up only in texts that hold one."""
    one = F.translate(text, FOLD_FROM, FOLD_TO)
    table = F.create_map(*[F.lit(x) for pair in FOLD_MANY.items() for x in pair])
    spread = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(text.rlike(r"^\p{ASCII}*+$"), F.lower(text)).when(text.rlike(one_of(tuple(FOLD_MANY))), spread).otherwise(one)


#: Texts of Latin-1 only, without the micro sign, whose case folding is no lower case; and what is no word character in them, in lower case.
_LATIN_1, _NO_WORD = r"^[\x00-\xb4\xb6-\xff]*+$", r"[^a-z0-9_\xaa\xb2\xb3\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+"


def comparison_form(text: Column) -> Column:
    """What is left when case, punctuation and spacing are taken off.  The text must be NFKC already (`nfkc_column`).

    Most texts are Latin-1: there lower case and sharp s are all of case folding, and one pattern without Unicode tables does the rest.
    """
    plain = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss")), _NO_WORD, " "))
    other = casefold(collapse(F.regexp_replace(text, rf"(?U)[^{WORD_CLASS}\s]", " ")))
    return F.when(text.rlike(_LATIN_1), plain).otherwise(other)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Declared so, though it is not: else a filter on what follows from it would be pushed below, and all of it worked out twice.
_nfkc = _nfkc.asNondeterministic()


#: Characters that NFKC leaves as they are beside one another: most of Latin-1, Cyrillic letters, some punctuation and controls.  Few ranges, since every character is tested.
STABLE = "^[\\x00-\\x9f¡-§©«-®°±¶·»¿-ÿ\u0400-\u0482\u048a-\u052f\u200b-\u200f\u2012-\u2016\u2018-\u2023\u202a-\u202e]*+$"


def nfkc_column(df: DataFrame, column: str) -> DataFrame:
    """Normalises a column to NFKC.  Spark has no such function, so texts that it may change go through Arrow, in the same pass; the others pass as nulls."""
    other = ~F.col(column).rlike(STABLE)
    return df.withColumn(column, F.coalesce(_nfkc(F.when(other, F.col(column))), F.col(column)))


#: What is no word character, but for blanks; and the bytes of Latin-1, where that is a table.
_OTHER = re.compile(r"[^\w ]+")
_LATIN_WORDS = bytes(k if chr(k).isalnum() or k == ord("_") else ord(" ") for k in range(256))


def compared_form(text: str) -> str:
    """`comparison_form` of any text, which is normalised first."""
    text = unicodedata.normalize("NFKC", text)
    try:
        return b" ".join(text.casefold().encode("latin-1").translate(_LATIN_WORDS).split()).decode("latin-1")
    except UnicodeEncodeError:
        return " ".join(filter(None, _OTHER.sub(" ", text).casefold().split(" ")))


@F.pandas_udf(StringType())
def _compared(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else compared_form(t))


_compared = _compared.asNondeterministic()


def compared(df: DataFrame, column: str) -> DataFrame:
    """Puts a column into `comparison_form`, NFKC included, in one pass through Arrow: a pattern in Spark takes ten times as long over whole texts."""
    return df.withColumn(column, _compared(column))


def excerpt(text: Column, most: int = 400) -> Column:
    one = collapse(text)
    return F.when(F.char_length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def token_estimate(text: Column) -> Column:
    """The larger of a quarter of the characters (rounded up) and the words."""
    words = F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(F.floor((F.char_length(text) + 3) / 4).cast("int"), words))


def whole_term(text: Column, term: str) -> Column:
    """Whether a term stands in the text with no word character at either side."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in term)
    return text.rlike(rf"(?<![{WORD_CLASS}]){quoted}(?![{WORD_CLASS}])")


#: What may stand before the skill in a requirement.
QUALIFIER = (
    r"(?i)^(?:\d+\+?\s+years(?:\s+of)?(?:\s+experience(?:\s+in|\s+with)?)?|proficiency(?:\s+in|\s+with)?|experience(?:\s+with|\s+in)?|"
    r"strong\s+understanding\s+of|knowledge\s+of|ability\s+to|demonstrated\s+experience\s+with)\s+"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value, so that a body which mentions it several times has it computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def title_case(text: Column) -> Column:
    """Capitals where a letter follows no letter, as in Python (Spark's initcap looks at blanks only)."""

    def cased(letters: Column) -> Column:
        after_letter = lambda i: (i > 0) & F.coalesce(F.get(letters, i - 1), F.lit("")).rlike(r"\p{L}")
        return F.array_join(F.transform(letters, lambda c, i: F.when(after_letter(i), F.lower(c)).otherwise(F.upper(c))), "")

    return let(F.filter(F.split(text, ""), lambda c: c != ""), cased)


#: Words of ASCII letters between single blanks, for which a label needs no look at each letter.
PLAIN_WORDS = r"^[A-Za-z]++(?: [A-Za-z]++)*+$"


def skill_label(text: Column) -> Column:
    """A short label for a requirement."""

    def cut(whole: Column, rest: Column) -> Column:
        label = F.when(rest == "", whole).otherwise(rest)
        for mark in (",", ";", "(", " - ", " -- "):
            label = strip(F.substring_index(label, mark, 1))
        return label

    def four_words(label: Column) -> Column:
        return let(F.filter(F.split(label, SPACE), lambda w: w != ""), lambda words: F.when(F.size(words) > 4, F.array_join(F.slice(words, 1, 4), " ")).otherwise(label))

    def shown(label: Column) -> Column:
        return F.when(F.char_length(label) <= 30, title_case(label)).otherwise(strip(F.substring(label, 1, 30)))

    def plain(rest: Column) -> Column:
        label = F.substring_index(rest, " ", 4)
        return F.when(F.char_length(label) <= 30, F.initcap(label)).otherwise(strip(F.substring(label, 1, 30)))

    def told(whole: Column) -> Column:
        other = lambda rest: let(let(cut(whole, rest), four_words), shown)
        return let(strip(F.regexp_replace(whole, QUALIFIER, "")), lambda rest: F.when(rest.rlike(PLAIN_WORDS), plain(rest)).otherwise(other(rest)))

    return F.when(text.isNull() | (text == ""), F.lit("Requirement")).otherwise(let(strip(text), told))


#: Boilerplate families and their patterns.
BOILERPLATE = {
    "equal_opportunity": (
        r"(?im)(?:we\s+are\s+an?\s+)?equal\s+opportunity\s+employer[^\n]*(?:\n[^\n]+)*|affirmative\s+action\s+employer[^\n]*(?:\n[^\n]+)*|"
        r"(?:does\s+not|do\s+not)\s+discriminate\s+(?:on\s+the\s+basis|based\s+on)[^\n]*(?:\n[^\n]+)*"
    ),
    "benefits": r"(?im)(?:^|\n)\s*(?:benefits|what\s+we\s+offer|perks\s*(?:&|and)\s*benefits|compensation\s*(?:&|and)\s*benefits)\s*:\s*(?:\n\s*[-*•\d\.]+[^\n]+)+",
    "application_instructions": (
        r"(?im)(?:how\s+to\s+apply|to\s+apply\s*,?\s*please\s+(?:submit|send|visit)|click\s+apply\s+now|send\s+(?:your\s+)?resume\s+to)\s*:\s*[^\n]*(?:\n[^\n]+)*"
    ),
}


def pattern_spans(text: Column, pattern: str, category: str) -> Column:
    """Starts (from 0) and ends of all matches, by adding up the lengths of the matches and of what lies between."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("h")))
    empty = F.array().cast("array<struct<start:int,end:int,category:string>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["h"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["h"]).alias("end"), F.lit(category).alias("category")))).alias("out"),
    )
    return F.when(text.rlike(pattern), F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]).otherwise(empty)


def boilerplate_spans(text: Column) -> Column:
    return F.concat(*[pattern_spans(text, p, c) for c, p in BOILERPLATE.items()])
