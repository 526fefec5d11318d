"""Text expressions: cleaning, assembling, usability checks. Built-in functions except entity decoding and NFKC."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NBSP, ZERO_WIDTH = " ", "​‌‍﻿"
# Placeholders that carry no signal, matched against a whole stripped field without regard to case.
PLACEHOLDERS = (
    r"\[removed\]", r"\[no description\]", r"no description available", r"read more\.*", r"click here\.*", r"n/?a", r"untitled", r"continue reading\.*",
)
REDIRECT = r"(?i)https?://(?:www\.)?google\.[a-z.]+/url\?"


# Characters with the Unicode White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

def _invisible_out(c: Column) -> Column:
    """Each replacement looks for bytes; translate() would make a string of every character."""
    return reduce(lambda t, x: F.replace(t, F.lit(x), F.lit("")), ZERO_WIDTH, F.replace(c, F.lit(NBSP), F.lit(" ")))


def strip(c: Column) -> Column:
    """Whitespace of any kind off both ends (trim() alone knows spaces only); no regular expression over the text."""
    return F.btrim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """One line of text: hidden characters out, whitespace runs to one space, ends stripped; null becomes ''."""
    return F.coalesce(strip(F.regexp_replace(_invisible_out(c), r"(?U)\s+", " ")), F.lit(""))


def bare(c: Column) -> Column:
    """Hidden characters out and ends stripped; inner whitespace stays."""
    return strip(_invisible_out(c))


def clean_or_null(c: Column) -> Column:
    """The same; an empty result is null."""
    return F.nullif(bare(c), F.lit(""))


def truncate(c: Column, width: int) -> Column:
    """Longer texts are cut at width and right-stripped."""
    return F.when(F.char_length(c) > width, F.rtrim(F.substring(c, 1, width), F.lit(SPACES))).otherwise(c)


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: So many texts of an Arrow batch are Python strings at a time.
SLICE = 16
#: Every entity begins like this.
ENTITY = "&(#[0-9xX]|[A-Za-z])"
# Ranges of characters that NFKC leaves as they are beside any others of these ranges: none has a compatibility
# form, a combining class, or joins the character before it. Latin, Greek, Cyrillic, Hebrew and Arabic letters, punctuation,
# signs, kana, ideographs and syllables of Hangul.
COMPOSED = (
    r"\u0000-\u009f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3"
    r"\u01cd-\u01f0\u01f4-\u02af\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03cf\u03fa-\u0482\u048a-\u052f\u05d0-\u05ea\u061b-\u064a\u0660-\u066f"
    r"\u1e00-\u1e99\u2010\u2012-\u2016\u2018-\u2023\u2039-\u203b\u20a9-\u20c0\u2190-\u222b\u3001-\u3029\u3041-\u3096\u30a0-\u30fe\u4e00-\u9fff\uac00-\ud7a3"
)


def _has_entity(c: Column) -> Column:
    return F.when(c.contains("&"), c.rlike(ENTITY)).otherwise(F.lit(False))


def _may_change(c: Column) -> Column:
    """Whether NFKC might change a text; ASCII is told by its size alone, and the ranges are tried on other characters only."""
    return F.when(F.char_length(c) < F.octet_length(c), c.rlike(rf"[^\x00-\x7f](?<![{COMPOSED}])")).otherwise(F.lit(False))


def _by_slices(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """Changes each text that is not null. Beside the batch and the bytes of its result, only a slice of texts is held."""
    import numpy as np

    data, ends, known = bytearray(), np.zeros(len(texts) + 1, np.int32), np.zeros(len(texts), bool)
    for at in range(0, len(texts), SLICE):
        for i, t in enumerate(texts.slice(at, SLICE).to_pylist(), at):
            if t is not None:
                data += change(t).encode()
                known[i] = True
            ends[i + 1] = len(data)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data), pa.py_buffer(np.packbits(known, bitorder="little")))


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    import html

    return _by_slices(texts, html.unescape)


@F.arrow_udf(StringType())
def _compose(texts: pa.Array) -> pa.Array:
    import unicodedata

    return _by_slices(texts, lambda t: unicodedata.normalize("NFKC", t))


@F.arrow_udf(StringType())
def _decoded_bare(texts: pa.Array) -> pa.Array:
    """Entities decoded, tags out and NFKC in one step: one worker a task instead of two."""
    import html
    import re
    import unicodedata

    return _by_slices(texts, lambda t: unicodedata.normalize("NFKC", re.sub("<[^>]+>", " ", html.unescape(t))))


def decode_entities(c: Column) -> Column:
    """HTML entities to characters; no built-in does this. Texts without one stay in the JVM."""
    return F.coalesce(_unescape(F.when(c.contains("&"), F.when(c.rlike(ENTITY), c))), c)


def nfkc(c: Column) -> Column:
    """Unicode compatibility normalisation; no built-in does this. Texts that it can't change stay in the JVM."""
    return F.coalesce(_compose(_held(c, lambda t: F.when(_may_change(t), t))), c)


def clean_for_scoring(c: Column) -> Column:
    """Entities decoded, tags out, NFKC, whitespace collapsed. Only texts that hold an entity or characters that NFKC may
    change go through Python."""
    needs = _has_entity(c) | _may_change(c)
    return clean_text(F.coalesce(_decoded_bare(F.when(needs, c)), strip_html(c)))


def is_meaningful(c: Column) -> Column:
    """False for null, blank, redirect links with next to no other text, placeholders, fewer than three visible
    characters, or no ASCII letter."""

    def of(text: Column) -> Column:
        rest = strip(F.regexp_replace(text, r"https?://\S+", ""))
        placeholder = text.rlike(f"(?i)^({'|'.join(PLACEHOLDERS)})$")
        redirect = text.rlike(REDIRECT) & (F.char_length(rest) < 3)
        seen = _held(strip(strip_html(text)), lambda visible: (F.char_length(visible) >= 3) & visible.rlike("[A-Za-z]"))
        return (text != "") & ~redirect & ~placeholder & seen

    return F.coalesce(_held(strip(c), of), F.lit(False))


def assemble_text(headline: Column, *more: Column) -> Column:
    """Headline and every meaningful addition, joined by spaces; null without a meaningful headline."""
    parts = [F.when(is_meaningful(c), strip(c)) for c in more]
    return F.when(is_meaningful(headline), F.concat_ws(" ", strip(headline), *parts))


def combined_text(*columns: Column) -> Column:
    """Stripped non-empty fields joined by spaces."""
    return F.array_join(F.filter(F.array(*map(strip, columns)), lambda x: x != ""), " ")


def fold_quotes(c: Column) -> Column:
    """Lower case with curly quotes straightened."""
    return F.translate(F.lower(c), "‘’“”", "''\"\"")


def capitalize(c: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column | None]) -> Column:
    """Optional predicates combined with AND; None is no condition."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))
