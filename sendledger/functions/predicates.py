"""Row filters and labels."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.functions.text import same_text

# FIXED VALUES: label rules, first match wins, letter case ignored.
PRODUCT_RULES = [("%CM_LB%", "LB"), ("%CM_LH%", "LH"), ("%CM_MX%", "MX"), ("%HN_%", "HN")]
PRODUCT_DEFAULT = "OTHERS"
CHANNEL_RULES = [("%RC_J%", "JIO"), ("%RC%", "RCS"), ("%SM%", "SMS")]
CHANNEL_DEFAULT = "OTHERS"
TOKEN_RULES = [("%_RC_%", "_RC_"), ("%_RC_J_%", "_RC_J_"), ("%_SM_%", "_SM_")]
DND_PATTERNS = [
    "%blocked in preferences with msisdn as pk.%",
    "%reserved for preference%",
    "%NCPR Fail%",
]


def by(df: DataFrame, **equals: str) -> DataFrame:
    """Rows whose named columns equal the values, letter case ignored."""
    for name, value in equals.items():
        df = df.where(same_text(F.col(name), value))
    return df


def on_days(df: DataFrame, day: str | Column, start=None, end=None) -> DataFrame:
    """Rows of a day range; one bound alone means that very day."""
    c = F.col(day) if isinstance(day, str) else day
    if start and end:
        return df.where(c.between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    if start or end:
        return df.where(c == F.lit(str(start or end)).cast("date"))
    return df


def any_like(c: Column, patterns: list[str]) -> Column:
    """True when one of the ``LIKE`` patterns fits, letter case ignored."""
    return reduce(or_, [c.ilike(p) for p in patterns])


def label(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    (pattern, name), *rest = rules
    chain = F.when(c.ilike(pattern), name)
    for pattern, name in rest:
        chain = chain.when(c.ilike(pattern), name)
    return chain.otherwise(default)


def is_dnd(cause: Column) -> Column:
    """Causes that put a number on the do-not-disturb list."""
    return any_like(cause, DND_PATTERNS)


def _falls_between(month: int, day: int, first: date, last: date) -> bool:
    """Whether some year has this month and day inside the range."""
    years = range(first.year, last.year + 1)
    if len(years) > 9:  # eight years in a row may lack a 29 February
        return True
    leap = [y for y in years if (month, day) != (2, 29) or (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))]
    return any(first <= date(y, month, day) <= last for y in leap)


def day_tokens(start: date | str, end: date | str) -> str:
    """Regular expression finding ``ddMM`` or ``MMdd`` of any day in the range.

    A year has at most 366 of each, so the expression stays small; tokens that
    share two leading digits are folded to keep matching cheap.
    """
    day, last = (d if isinstance(d, date) else date.fromisoformat(d) for d in (start, end))
    if last < day:
        raise ValueError("the day range is empty")
    tails: dict[str, set[str]] = {}
    for year_day in (date(2000, 1, 1) + timedelta(days=i) for i in range(366)):
        if _falls_between(year_day.month, year_day.day, day, last):
            dd, mm = year_day.strftime("%d"), year_day.strftime("%m")
            tails.setdefault(dd, set()).add(mm)
            tails.setdefault(mm, set()).add(dd)
    return "|".join(f"{head}(?:{'|'.join(sorted(ends))})" for head, ends in sorted(tails.items()))


def on_day_tokens(c: Column, start, end) -> Column:
    return c.rlike(day_tokens(start, end))


def channel_filter(c: Column, name: str | None) -> Column:
    """Campaigns of a named channel; an unknown name filters nothing."""
    if name == "SMS":
        return c.ilike("%SM%")
    if name == "RCS":
        return c.ilike("%RC%") & ~c.ilike("%RC_J%")
    if name == "JIO":
        return c.ilike("%RC_J%")
    return F.lit(True)


def campaign_token(c: Column, fixed: bool = False) -> Column:
    """Date token of a campaign code: the part after its channel mark.

    The plain mark is tried before the longer JIO mark, which gives JIO
    campaigns the token ``J``; ``fixed`` tries the longer mark first.
    """
    rules = sorted(TOKEN_RULES, key=lambda r: -len(r[1])) if fixed else TOKEN_RULES
    chain = None
    for pattern, mark in rules:
        token = F.substring_index(F.substring_index(c, mark, -1), "_", 1)
        chain = (F if chain is None else chain).when(c.ilike(pattern), token)
    return chain.otherwise(F.right(c, F.lit(4)))
