"""Dates held in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sendledger.functions.text import or_null, strip

# FIXED VALUES: date layouts found in the input files.
ISO_DAY = "yyyy-M-d"
DAY_MONTH_NAME = "d-MMM-yy"
ISO_SECOND = "yyyy-M-d H:m:s"
US_DAY = ("M/d/yyyy", "M/d/yy")
DAY_KEY = "d_M_yyyy"
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

PLAIN_TIME = r"^\d[\d :.-]*\d\z"
REPORT_MINUTE = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})\z"
SHEET_DAY = r"^([^/]*)/([^/]*)/([^/]*)\z"
NAME_SHORT_YEAR = r"(\d{1,2})-([A-Za-z]{3})'(\d{2})"
NAME_NO_YEAR = r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3})"

FIRST_OLD_YEAR = 2070
UNKNOWN_MONTH = "unknown"


def _pad2(c: Column) -> Column:
    # lpad alone would cut longer text.
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def parse_report_ts(c: Column) -> Column:
    """``M/D/YYYY H:MM`` as ``yyyy-MM-dd HH:mm:00``; other text is kept as it is.

    Empty text and anything holding "in process" is NULL; one outer quote on
    either side is dropped.
    """

    def iso(text: Column) -> Column:
        # Zeros are put before every part, then taken from those of two digits.
        padded = F.regexp_replace(text, REPORT_MINUTE, "$3-0$1-0$2 0$4:$5:00")
        return F.regexp_replace(padded, r"([- ])0(\d\d)(?=[-: ])", "$1$2")

    text = strip(F.regexp_replace(c, "^[\"']|[\"']\\z", ""))
    empty = (strip(c) == "") | F.lower(c).contains("in process")
    # The two usual forms are told by one look each.
    return (
        F.when(c.rlike(PLAIN_TIME), c)
        .when(c.rlike(REPORT_MINUTE), iso(c))
        .when(~empty, F.when(text.rlike(REPORT_MINUTE), iso(text)).otherwise(text))
    )


def sheet_date(c: Column) -> Column:
    """``M/D/YY`` as ``20YY-MM-DD``, otherwise unchanged; a 4-digit year is kept."""
    month, day, year = (F.regexp_extract(c, SHEET_DAY, i) for i in range(1, 4))
    full_year = F.when(F.length(year) == 4, year).otherwise(F.concat(F.lit("20"), year))
    return F.when(
        c.rlike(SHEET_DAY), F.concat(full_year, F.lit("-"), _pad2(month), F.lit("-"), _pad2(day))
    ).otherwise(c)


def _parsed(c: Column, layout: str) -> Column:
    day = F.try_to_timestamp(c, F.lit(layout)).cast("date")
    if "yyyy" in layout:
        return day
    # Two-digit years from 70 on belong to the last century.
    return F.when(F.year(day) >= FIRST_OLD_YEAR, F.add_months(day, -1200)).otherwise(day)


def try_date(c: Column, *formats: str) -> Column:
    """The first layout that fits, as DATE; NULL when none does. An empty cell is not parsed, as failing is slow."""
    c = F.nullif(c, F.lit(""))
    return F.coalesce(*[_parsed(c, f) for f in formats])


def date_in_name(c: Column, year: int) -> Column:
    """Day named in a file name (``5-Apr'25`` or ``5th Apr``) as ``dd/MM/yyyy``."""

    def found(pattern: str, last: Column) -> Column:
        day, month = (F.regexp_extract(c, pattern, i) for i in (1, 2))
        month = F.initcap(month)
        return F.when(
            c.rlike(pattern),
            F.date_format(try_date(F.concat_ws(" ", day, month, last), "d MMM yyyy"), "dd/MM/yyyy"),
        )

    short = F.concat(F.lit("20"), F.regexp_extract(c, NAME_SHORT_YEAR, 3))
    return F.when(c.rlike(NAME_SHORT_YEAR), found(NAME_SHORT_YEAR, short)).otherwise(
        found(NAME_NO_YEAR, F.lit(str(year)))
    )


def month_in_name(c: Column, default: str) -> Column:
    """The first month word in a file name, else ``default``."""
    word = F.regexp_extract(c, r"\b(" + "|".join(MONTH_NAMES) + r")\b", 1)
    return F.coalesce(or_null(word), F.lit(default))


def ms_to_text(c: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss`` in ``zone``."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = epoch + F.make_dt_interval(secs=(c / 1000).cast("decimal(18,6)"))
    if zone != "UTC":
        moment = F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def day_of(c: Column) -> Column:
    """DATE of a text timestamp, NULL when it is not one."""
    return c.try_cast("date")


def month_of(c: Column) -> Column:
    """Partition month ``yyyy-MM`` of a text timestamp."""
    return F.coalesce(F.date_format(day_of(c), "yyyy-MM"), F.lit(UNKNOWN_MONTH))


def minute_of(c: Column) -> Column:
    return F.substring(c, 1, 16)


def tail_date(c: Column, year: int) -> Column:
    """The day in a trailing ``ddMM``, in the given year; NULL when there is none."""
    tail = F.right(c, F.lit(4))
    return F.when(
        tail.rlike(r"^[0-9]{4}\z"),
        try_date(F.concat(F.lit(f"{year:04d}"), F.right(c, F.lit(2)), F.left(tail, F.lit(2))), "yyyyMMdd"),
    )


def day_key(c: Column) -> Column:
    """The last three underscore parts of a campaign medium (``dd_MM_yyyy``)."""
    return F.substring_index(c, "_", -3)
