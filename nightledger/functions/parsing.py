"""Column helpers that turn raw text into typed values; bad text becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for a missing number.
NULL_TOKENS = ["nan", "None", "<NA>", ""]

# Every character that counts as white space around a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

LINE_BREAK = r"<br\s*/?>"
FIRST_NUMBER = r"(\d+\.?\d*)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def _number(text: Column) -> Column:
    trimmed = strip(text)
    value = F.when(~trimmed.isin(NULL_TOKENS), trimmed).try_cast("double")
    return F.nullif(value, F.lit(float("nan")))


def parse_price(c: Column) -> Column:
    """``$1,250.00`` -> 1250.0."""
    return _number(F.translate(c.cast("string"), "$,", ""))


def parse_percent(c: Column) -> Column:
    """``95%`` -> 95.0."""
    return _number(F.replace(c.cast("string"), F.lit("%"), F.lit("")))


# Forms of a date that are tried in turn, after the ISO form; months stand before days.
DATE_FORMATS = ["yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


def parse_date(c: Column) -> Column:
    """The first of the listed forms that a text has, else NULL."""
    text = strip(c.cast("string"))
    forms = [F.try_to_timestamp(text, F.lit(form)).cast("date") for form in DATE_FORMATS]
    return F.coalesce(c.try_cast("date"), *forms)


def parse_flag(c: Column) -> Column:
    """``t`` / ``f`` to boolean, anything else NULL."""
    return F.when(c == "t", True).when(c == "f", False)


def first_number(c: Column) -> Column:
    """First number inside text such as ``1.5 shared baths``."""
    return F.nullif(F.regexp_extract(c, FIRST_NUMBER, 1), F.lit("")).try_cast("double")


def strip_breaks(c: Column) -> Column:
    """Replace HTML line breaks by a space and strip white space."""
    return strip(F.regexp_replace(c, LINE_BREAK, " "))


def amenity_count(c: Column) -> Column:
    """Parts of a bracketed list split on commas; missing -> 0, ``[]`` -> 1."""
    inner = F.btrim(c, F.lit("[]"))
    return F.when(c.isNull() | c.isin("", "nan"), 0).otherwise(F.size(F.split(inner, ",")))


def rejected(c: Column, parsed: Column) -> Column:
    """The text that should have given a value and gave none, else NULL."""
    text = c.cast("string")
    return F.when(parsed.isNull() & ~strip(text).isin(NULL_TOKENS), text)


PARSERS = {
    "price": parse_price,
    "percent": parse_percent,
    "date": parse_date,
    "flag": parse_flag,
}


def parse_as(c: Column, kind: str) -> Column:
    parser = PARSERS.get(kind)
    return parser(c) if parser else c.try_cast(kind)
