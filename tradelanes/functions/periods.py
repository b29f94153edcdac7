"""Year-month arithmetic. Trade periods are YYYY, notification periods YYYYMM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelanes.functions.guards import once

#: Distance given to an unknown period; any decay raised to it is zero.
UNKNOWN_MONTHS = 65535
#: Period assumed when no notification carries one.
DEFAULT_PERIOD = 202600


#: Date layouts read besides ISO, in this order, once weekday and time of day are cut
#: off. Where day and month could both come first, the month does, unless ``day_first``
#: is asked for. Years of two digits are those from 2000 on.
_MONTH_FIRST = [f"M{c}d{c}yyyy" for c in "-/."]
_DAY_FIRST = [f"d{c}M{c}yyyy" for c in "-/."]
_NAMED = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "d-MMM-yyyy", "yyyy/M/d"]
_SHORT_YEAR = ["d-MMM-yy", "d MMM yy", "MMM d, yy"]
_MONTH_ONLY = ["MMM yyyy", "MMMM yyyy", "MMM-yyyy", "MMM yy", "MMM-yy", "M/yyyy", "M-yyyy", "M.yyyy", "yyyy/M"]
_WEEKDAY = r"(?i)^(mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)[.,]?\s+"
_CLOCK = r"(?i)(,|\s)\s*([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(\s*[ap]\.?m\.?)?(\s*(utc|gmt|z))?$"


def _filled(date: Column) -> Column:
    """A date's text without blanks around it; NULL for none."""
    text = F.trim(date.cast("string"))
    return F.when(F.length(text) > 0, text)


def to_period_yyyymm(*dates: Column, day_first: bool = False) -> Column:
    """First date given as text, as ``year * 100 + month``; 0 when there is none or it can't be read.

    Numbers of five digits or more are taken as they stand, but for those of
    eight, which are a day; see :func:`is_unread` for those that aren't a month.
    """
    # given is named twice and each date once in it: a naming in more branches cleans the text anew
    texts = [F.array_remove(F.array(F.trim(d.cast("string"))), "") for d in dates]
    given = F.coalesce(*[F.get(t, 0) for t in texts])
    # ISO dates are read in compiled code, others in a lambda
    iso = F.regexp_extract(given, r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z", 0).try_cast("date")
    month = F.replace(F.substring(iso.cast("string"), 1, 7), F.lit("-"), F.lit("")).cast("int")
    return F.coalesce(month, once(given, lambda text: _month_of(text, day_first)))


def _month_of(text: Column, day_first: bool) -> Column:
    digits = F.when(text.rlike("^[0-9]{5,}$") & ~text.rlike("^[0-9]{8}$"), text.try_cast("int"))
    compact = F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    first, second = (_DAY_FIRST, _MONTH_FIRST) if day_first else (_MONTH_FIRST, _DAY_FIRST)
    short = [k.replace("yyyy", "yy") for k in first + second]
    layouts = first + second + _NAMED + short + _SHORT_YEAR + _MONTH_ONLY
    iso = F.when(~text.rlike("^[0-9]{5,}$"), F.try_to_timestamp(text))
    # few texts need these
    bare = F.regexp_replace(F.regexp_replace(text, _CLOCK, ""), _WEEKDAY, "")
    read = once(bare, lambda b: F.coalesce(F.try_to_timestamp(b), *[F.try_to_timestamp(b, F.lit(k)) for k in layouts]))
    other = F.when(text.rlike("[-/., ]"), read)
    month = once(F.coalesce(compact, iso, other), lambda moment: F.year(moment) * 100 + F.month(moment))
    return F.coalesce(digits, month, text.try_cast("int"), F.lit(0))


def is_unread(period: Column, *dates: Column) -> Column:
    """Whether a date was given but its ``period`` isn't a month of a year of four digits.

    That is an unreadable text, or a number that isn't a date, such as a
    spreadsheet's number of a day.
    """
    month = period % 100
    return F.coalesce(*[_filled(d) for d in dates]).isNotNull() & ~(period.between(100001, 999912) & month.between(1, 12))


def month_index(period: Column) -> Column:
    return F.floor(period / 100).cast("int") * 12 + period % 100


def months_between_yyyymm(current: Column, earlier: Column) -> Column:
    """Whole months from ``earlier`` to ``current``, never negative."""
    apart = F.greatest(month_index(current) - month_index(earlier), F.lit(0))
    unknown = (current == 0) | (earlier == 0)
    return F.when(unknown, F.lit(UNKNOWN_MONTHS)).otherwise(apart)
