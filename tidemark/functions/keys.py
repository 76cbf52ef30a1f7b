"""Clean forms of keys, days and instants; plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dash code points that stand for an ASCII hyphen in keys.
DASHES = "‐‑‒–—―−﹘﹣－"
OPEN_END = "9999-12-31"
EPOCH = "1970-01-01"


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind (SQL ``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_key(c: Column) -> Column:
    """Upper case, trimmed, ASCII hyphens; null and blank give null."""
    return F.nullif(F.upper(strip(F.translate(c, DASHES, "-" * len(DASHES)))), F.lit(""))


def form_part(c: Column) -> Column:
    """The form number of ``'HM-0000 ed. 01-24'`` in clean form, whatever edition it names."""
    return F.nullif(F.regexp_replace(clean_key(c), r"(?U)\s+ED\b.*$", ""), F.lit(""))


_YMD = r"(?U)^\s*(\d{4})(?:[-/.\s](\d{1,2})[-/.\s](\d{1,2})|(\d\d)(\d\d))(?:[T\s].*)?$"
_DMY = r"(?U)^\s*(\d{1,2})[-/.\s]+([A-Za-z]{3})[a-z]*[-/.,\s]+(\d{4})(?:[T\s].*)?$"


def parse_day(c: Column) -> Column:
    """A date from any unambiguous writing, else null.

    Year first with or without separators and with any time part, or day, English
    month abbreviation, year.  Sentinels and impossible days are null.
    """
    c = F.translate(c, DASHES, "-" * len(DASHES))
    # a text that does not match stays without the mark and is no date; one match per form
    ymd = F.try_to_date(F.regexp_replace(c, _YMD, "#$1-$2$4-$3$5"), "'#'yyyy-M-d")
    return F.coalesce(ymd, F.try_to_date(F.regexp_replace(c, _DMY, "#$1 $2 $3"), "'#'d MMM yyyy"))


def instant(c: Column) -> Column:
    """A timestamp from an ISO string with its offset; unreadable gives null."""
    return c.try_cast("timestamp")


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 of a date."""
    return F.datediff(c, F.lit(EPOCH).cast("date"))


def utc_day(c: Column) -> Column:
    """UTC day number of a timestamp, whatever the session's time zone."""
    return F.floor(F.unix_seconds(c) / 86400).cast("int")


def day_text(number: Column) -> Column:
    """YYYY-MM-DD of a day number."""
    return F.date_add(F.lit(EPOCH).cast("date"), number).cast("string")


def utc_month(c: Column) -> Column:
    return F.substring(day_text(utc_day(c)), 1, 7)


def form_guess(raw: Column) -> Column:
    """What a form's name may have been meant to be: its letters, a hyphen, its digits."""
    head = F.regexp_replace(F.trim(raw), r"(?i)\s+ed\.?\s*[\d-]+$", "")
    return F.concat(F.regexp_replace(F.upper(head), "[^A-Z]", ""), F.lit("-"), F.regexp_replace(head, r"[^0-9]", ""))
