"""Locale-aware conversion of raw strings, as Column expressions. A value that cannot be read is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Every character that is white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(v: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(v, F.lit(WHITE))


def is_missing(v: Column) -> Column:
    return v.isNull() | (v == "")


def is_blank(v: Column) -> Column:
    return v.isNull() | (stripped(v) == "")


def bound(v: Column, use: Callable[[Column], Column]) -> Column:
    """use(v), with v evaluated once however often `use` names it."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def _digits(v: Column, locale: str, strict: bool) -> Column:
    """The number's text in plain notation: digits, at most the dots and minuses that the value has."""

    def plain(s: Column) -> Column:
        if locale == "vi-VN":
            commas, dotted = F.length(s) - F.length(F.replace(s, F.lit(","))), s.contains(".")
            decimal = (commas == 1) if strict else (commas == 1) & dotted
            undotted = F.replace(s, F.lit("."))
            s = F.when(decimal, F.replace(undotted, F.lit(","), F.lit("."))).when(dotted & (commas == 0), undotted).otherwise(s)
        else:
            s = F.replace(s, F.lit(","))
        return F.regexp_replace(s, r"[^0-9.\-]", "")

    return bound(stripped(v), plain)


def number(v: Column, locale: str = "vi-VN", strict: bool = False) -> Column:
    """vi-VN: dots are thousands; one comma beside dots is the decimal mark, and a lone comma is dropped (strict: it is decimal, too).
    Other locales: commas are thousands. What is neither digit, dot nor minus is dropped."""
    return _digits(v, locale, strict).try_cast("double")


def currency(v: Column, locale: str = "vi-VN", strict: bool = False) -> Column:
    """decimal(38,6) of a number that may carry a currency sign or code; every digit counts."""
    return _digits(F.regexp_replace(v, "₫|VND|đ|\\$|€|£|USD|EUR|GBP", ""), locale, strict).try_cast("decimal(38,6)")


#: Day, month, year (or the reverse) of each layout; a two-digit year from 69 on is of the 1900s.
_LAYOUTS = [(r"^\s?(\d{1,2})/(\d{1,2})/(\d{4})$", 3), (r"^\s?(\d{1,2})-(\d{1,2})-(\d{4})$", 3), (r"^(\d{4})-(\d{1,2})-\s?(\d{1,2})$", 1), (r"^\s?(\d{1,2})/(\d{1,2})/(\d{2})$", 3), (r"^\s?(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3)]


def date(v: Column) -> Column:
    def read(s: Column) -> Column:
        tries = []
        for pattern, year in _LAYOUTS:
            y, d = F.regexp_extract(s, pattern, year), F.regexp_extract(s, pattern, 4 - year)
            if pattern.endswith(r"(\d{2})$"):
                y = bound(y, lambda two: F.concat(F.when(two >= "69", "19").otherwise("20"), two))
            tries.append(F.when(s.rlike(pattern), F.try_to_timestamp(F.concat_ws("-", y, F.regexp_extract(s, pattern, 2), d), F.lit("yyyy-M-d")).cast("date")))
        return F.coalesce(*tries)

    return bound(stripped(v), read).cast("timestamp_ntz")


def extracted_number(v: Column) -> Column:
    """A model's number: a comma is a decimal mark."""
    return F.replace(stripped(v), F.lit(","), F.lit(".")).try_cast("double")


def extracted_currency(v: Column) -> Column:
    """The first run of digits, dots and commas, commas dropped."""
    return F.replace(F.regexp_extract(v, r"[0-9,.]+", 0), F.lit(",")).try_cast("double")
