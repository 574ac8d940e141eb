"""Text expressions. All built-in and JVM-side; none needs a Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# How text length becomes a token estimate, where a raw sentence
# ends, and which glued sentence seam gets its space back.
CHARS_PER_TOKEN = 4
RAW_SENTENCE_SEPARATOR = ". "
GLUED_SEAM = r"\.(?=[A-Z])"

# blanks behind a sentence end; what stands before is looked at where there is a blank only
SENTENCE_GAP = r"(?=\s)(?<=[.!?])\s+"

Splitter = Callable[[Column], Column]


def strip(text: Column) -> Column:
    """Unicode strip. A plain ``trim`` would remove U+0020 only."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize(text: Column) -> Column:
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def word_count(text: Column) -> Column:
    """Parts between single spaces, empty parts included."""
    return F.size(F.split(text, " ", -1)).cast("bigint")


def raw_sentence_count(text: Column) -> Column:
    """Parts between full stops with a space, empty parts included.

    Measures what removing the separators takes away, which is cheaper than a
    split at a two-character separator.
    """
    removed = F.length(text) - F.length(F.replace(text, F.lit(RAW_SENTENCE_SEPARATOR), F.lit("")))
    return (removed / len(RAW_SENTENCE_SEPARATOR) + 1).cast("bigint")


def token_estimate(text: Column) -> Column:
    return F.length(text) / F.lit(float(CHARS_PER_TOKEN))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` where whitespace follows."""
    return F.array_remove(F.split(text, SENTENCE_GAP, -1), "")


def sentence_splitter(abbreviations: Iterable[str] = ()) -> Splitter:
    """The rule splitter, optionally not breaking after given abbreviations.

    ``abbreviations`` are written without the final full stop ("Dr", "etc").
    Any ``Column -> Column`` callable, such as a ``pandas_udf`` around a
    trained model, can be used in its place.
    """
    words = sorted({re.escape(a.rstrip(".")) for a in abbreviations})
    if not words:
        return sentences
    gap = rf"(?<=[.!?])(?<!\b(?:{'|'.join(words)})\.)\s+"
    return lambda text: F.array_remove(F.split(text, gap, -1), "")


def join_sentences(parts: Column, joiner: str = "") -> Column:
    """One chunk text from its sentences.

    The default joiner is empty, so sentences meet without a space; a seam of
    full stop and ASCII capital is opened again afterwards. Double spaces are
    squeezed in one pass only.
    """
    joined = F.replace(F.array_join(parts, joiner), F.lit("  "), F.lit(" "))
    return F.regexp_replace(strip(joined), GLUED_SEAM, ". ")


def slices(items: Column, size: int) -> Column:
    """Cut an array into consecutive arrays of ``size``; the last may be short."""
    starts = F.sequence(F.lit(1), F.size(items), F.lit(size))
    # sequence(1, 0, n) is an error, so it must not be reached for an empty list
    cut = F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i, size)))
    return F.coalesce(cut, F.array().cast("array<array<string>>"))
