"""String cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FIXED VALUES: the characters counted as blank around a cell.
BLANKS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

INTEGER_HEAD = r"^\s*([+-]?\d+)"
FLOAT_HEAD = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def strip(c: Column) -> Column:
    # Most cells begin and end in plain ASCII and need no trimming.
    plain = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(BLANKS)))


def or_null(c: Column) -> Column:
    """Empty text becomes NULL."""
    return F.nullif(c, F.lit(""))


def same_text(c: Column, value: Column | str) -> Column:
    """Equality without regard to letter case."""
    return F.lower(c) == F.lower(value if isinstance(value, Column) else F.lit(value))


def one_of(c: Column, values: list[str]) -> Column:
    """Membership without regard to letter case; NULL stays NULL."""
    return F.lower(c).isin([v.lower() for v in values])


def plain_mobile(c: Column) -> Column:
    """``9.19E+11`` written out in digits; empty is NULL, the rest unchanged."""
    digits = c.try_cast("double").try_cast("decimal(38,0)").cast("string")
    return F.when(c.contains("E+"), digits).otherwise(or_null(c))


def clean_txn_id(c: Column) -> Column:
    """Apostrophes and blanks at the end dropped; empty is NULL."""
    cell = strip(c)
    return or_null(F.when(cell.contains("'"), F.regexp_replace(cell, r"'|\s+\z", "")).otherwise(cell))


def clean_tag_id(c: Column) -> Column:
    return or_null(F.replace(strip(c), F.lit("`")))


def lead_int(c: Column) -> Column:
    """The integer a text starts with, else NULL."""
    return F.regexp_extract(c, INTEGER_HEAD, 1).try_cast("bigint")


def lead_float(c: Column) -> Column:
    """The decimal number a text starts with, else NULL."""
    return F.regexp_extract(c, FLOAT_HEAD, 1).try_cast("double")


def number_text(c: Column) -> Column:
    """A number as text, whole values without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def normal_mobile(c: Column) -> Column:
    """Twelve digits with country code 91, or NULL when the number is invalid."""
    number = strip(c)
    return F.when(number.rlike(r"^91[6-9]\d{9}\z"), number).when(
        number.rlike(r"^[6-9]\d{9}\z"), F.concat(F.lit("91"), number)
    )


def file_name(path: Column) -> Column:
    """Last part of ``_metadata.file_path``, percent escapes undone."""
    last = F.element_at(F.split(path, "/"), -1)
    # '+' is literal in a path URI, but a blank to url_decode.
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def source_from_path(path: Column, any_extension: bool = False) -> Column:
    """Source name of a file: without ``.csv``, or without any extension."""
    pattern = r"(?<=.)\.[^.]*\z" if any_extension else r"\.csv\z"
    return F.regexp_replace(file_name(path), pattern, "")


def name_key(c: Column) -> Column:
    """Each run of blanks becomes one underscore."""
    return F.regexp_replace(c, r"\s+", "_")


def feed_key(c: Column) -> Column:
    """Each blank or hyphen becomes an underscore."""
    return F.regexp_replace(c, r"[-\s]", "_")


def scrub(c: Column) -> Column:
    """Tabs and line ends dropped, outer blanks trimmed."""
    return F.trim(F.regexp_replace(c, r"[\t\n\r]", ""))


def strip_quote(c: Column) -> Column:
    """All apostrophes dropped from a value that starts with one."""
    return F.when(c.startswith("'"), F.replace(c, F.lit("'"))).otherwise(c)


def nth_field(c: Column, n: int, sep: str = ",") -> Column:
    """The n-th field of a list, or its last field when it is shorter."""
    return F.substring_index(F.substring_index(c, sep, n), sep, -1)


def head_parts(c: Column, sep: str, n: int) -> Column:
    """The first n parts of a text (the last ``-n`` parts for a negative n)."""
    return F.substring_index(c, sep, n)
