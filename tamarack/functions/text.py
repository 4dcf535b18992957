"""Text columns: Unicode-aware normalisation, trimming, title case, fixed-point numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A numeric literal: digits, a point if any, more digits.
NUMBER = r"\d+\.?\d*"


def strip(s: Column) -> Column:
    """s without Unicode white space at its ends (``trim`` removes blanks only)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def squeeze(s: Column) -> Column:
    """s with each run of white space as one blank, and none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def isolate_numbers(s: Column) -> Column:
    """s with blanks around each numeric literal."""
    return F.regexp_replace(s, rf"(?U)({NUMBER})", " $1 ")


def clean(s: Column) -> Column:
    """Numbers on their own, lower case, only word characters and ``_ . -`` left; null is empty."""
    spaced = F.lower(isolate_numbers(F.coalesce(s, F.lit(""))))
    return squeeze(F.regexp_replace(spaced, r"(?U)[^\w\s._-]", " "))


def tokens(cleaned: Column) -> Column:
    """The words of a cleaned text; none for an empty one."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def is_number(word: Column) -> Column:
    return word.rlike(rf"(?U)^{NUMBER}$")


def title_case(s: Column) -> Column:
    """Each run of letters with a capital first and small letters after, as at every non-letter a word begins."""
    runs = F.regexp_extract_all(s, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def join_texts(texts: Column) -> Column:
    """The array's texts that aren't null or blank, stripped, with a blank between."""
    return F.array_join(F.transform(F.filter(texts, lambda t: t.isNotNull() & (strip(t) != "")), strip), " ")


def join_sources(*texts: Column) -> Column:
    """Texts of several sources with a blank between, without the empty ones."""
    return F.trim(F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts]))


def or_default(s: Column, default: str) -> Column:
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def tri_state(b: Column) -> Column:
    """'true', 'false' or, for null, 'null'."""
    return F.coalesce(b.cast("string"), F.lit("null"))


def fixed4(x: Column) -> Column:
    """x with four decimals."""
    return F.format_string("%.4f", F.round(x, 4))


def snippet(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """What stands before the last slash of path; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last dot of path's base name, if it isn't its first character, and what follows; else empty."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)
