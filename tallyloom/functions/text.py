"""Scalar expressions over comment text; built-in functions wherever these can say it."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid(text: Column) -> Column:
    """Whether the text has a letter or digit; null is invalid."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def collapse(text: Column) -> Column:
    """The text without bracketed sticker tokens (a fixed form), runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[一-鿿A-Za-z0-9]+\]", ""), r"[ \t\n\x0B\f\r]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean(text: Column) -> Column:
    """Compatibility-normalised, then collapsed."""
    return collapse(nfkc(text))


# Where full case folding goes on from lower case: one sign for one, and one sign for several.
_FOLDED = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c == c.lower() and c != c.casefold()}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_MANY = {c: f for c, f in _FOLDED.items() if len(f) > 1}


def fold(text: Column) -> Column:
    """The text case-folded, by built-in functions: ß and SS are alike, and so are both small sigmas."""
    # Latin-1 text, but for the micro sign, only knows ß; all else takes the way of signs
    low, rare = F.lower(text), {c: f for c, f in _MANY.items() if c != "ß"}
    names = F.create_map(*(F.lit(x) for pair in rare.items() for x in pair))
    plain = F.replace(low, F.lit("ß"), F.lit("ss"))
    full = F.replace(F.translate(low, "".join(_ONE), "".join(_ONE.values())), F.lit("ß"), F.lit("ss"))
    each = F.array_join(F.transform(F.split(full, ""), lambda c: F.coalesce(names[c], c)), "")
    return F.when(low.rlike(r"^[\x00-\u00B4\u00B6-\u00FF]*+$"), plain).when(low.rlike("[" + "".join(rare) + "]"), each).otherwise(full)


def near_key(text: Column) -> Column:
    """The case-folded text's letters, digits and underscores only."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]", "")


def normal(text: Column) -> Column:
    """Compatibility-normalised, case-folded, without white space."""
    return F.regexp_replace(fold(nfkc(text)), r"(?U)\s+", "")


def digest(text: Column) -> Column:
    """SHA-256 of the text as a JSON string, with non-ASCII signs as they are."""
    return F.sha2(F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(".*")\}$', 1), 256)


def numeric_template(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9]+(?:\.[0-9]+)?", "<NUM>")


def nonnegative(value: Column) -> Column:
    """A finite number of 0 or more, else null; accepts text."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf")), number)


def csv_guard(text: Column) -> Column:
    """A leading quote before strings that a spreadsheet would run as a formula."""
    risky = text.rlike(r"^[ \t\n\x0B\f\r]*[=+\-@]") | text.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def span_state(text: str, quote: str, start: str) -> Column:
    """Of three columns: EXACT where the quote stands at start (code points from 0), REPAIRED where it occurs exactly
    once elsewhere (overlapping search), else FAIL."""
    at = f"substring({text}, {start} + 1, length({quote})) = {quote}"
    once = f"locate({quote}, {text}) > 0 AND locate({quote}, {text}, locate({quote}, {text}) + 1) = 0"
    return F.expr(f"CASE WHEN {quote} IS NULL OR {quote} = '' THEN 'FAIL' WHEN {at} THEN 'EXACT' WHEN {once} THEN 'REPAIRED' ELSE 'FAIL' END")


def video_id(explicit: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(F.regexp_extract(url, r"/(?:video|note)/(\d+)", 1), F.lit("")), url)


def stamp(value: Column) -> Column:
    """Timestamp of ISO text with a zone; anything else is null."""
    return F.when(value.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(value))


def zoned_time(value: Column) -> Column:
    """Timestamp of ISO text with a zone, or of finite epoch seconds; anything else is null."""
    number = value.try_cast("double")
    epoch = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e12), F.timestamp_seconds(number))
    return F.coalesce(epoch, stamp(value))
