"""Dates as people write them, tax periods and statutory limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted layouts in order, day before month.
LAYOUTS = (
    "yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "d MMM yyyy", "d MMMM yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d-M-yy", "d/M/yy", "d-MMM-yy", "yyyyMMdd", "d-M-yyyy H:m:s", "yyyy-M-d H:m:s",
)


def parse_date(raw: Column) -> Column:
    """The first layout that reads it, else null. Years 69 to 99 of two digits lie in the last century."""
    x = F.initcap(F.trim(raw))
    out = []
    for layout in LAYOUTS:
        day = F.try_to_timestamp(x, F.lit(layout)).cast("date")
        if not layout.count("yyyy"):
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        out.append(day)
    return F.coalesce(*out)


def period_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def first_day(period: Column) -> Column:
    return F.to_date(period, "yyyy-MM")


def shift_period(period: Column, months: int) -> Column:
    return period_of(F.add_months(first_day(period), months))


def periods_between(earlier: Column, later: Column) -> Column:
    months = lambda p: F.substring(p, 1, 4).cast("int") * 12 + F.substring(p, 6, 2).cast("int")
    return months(later) - months(earlier)


def months_between(start: Column, end: Column) -> Column:
    """All periods from start to end; none if they are reversed."""
    spine = F.transform(F.sequence(first_day(start), first_day(end), F.expr("interval 1 month")), period_of)
    return F.when(start <= end, spine).otherwise(F.array().cast("array<string>"))


def credit_deadline(day: Column) -> Column:
    """30 November after the financial year (from April) that a day lies in."""
    return F.make_date(F.when(F.month(day) >= 4, F.year(day)).otherwise(F.year(day) - 1) + 1, F.lit(11), F.lit(30))


def financial_year(day: Column) -> Column:
    start = F.when(F.month(day) >= 4, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def statement_period(rtnprd: Column) -> Column:
    """YYYY-MM of a statement's MMYYYY."""
    return F.when(rtnprd.rlike(r"^\d{6}$"), F.concat(F.substring(rtnprd, 3, 4), F.lit("-"), F.substring(rtnprd, 1, 2)))


def named_period(name: Column) -> Column:
    """YYYY-MM of a file name that holds a year from 2000 and a month, with or without a mark between."""
    at = lambda g: F.regexp_extract(name, r"(20\d{2})[-_]?(0[1-9]|1[0-2])", g)
    return F.when(at(0) != "", F.concat(at(1), F.lit("-"), at(2)))


def days_left(day: Column, as_of: Column) -> Column:
    """The credit deadline of a document's day as seen on as_of: deadline, financial year, days left, whether it has passed."""
    limit = credit_deadline(day)
    return F.struct(limit.alias("deadline"), financial_year(day).alias("financial_year"), F.datediff(limit, as_of).alias("days_left"), (F.datediff(limit, as_of) < 0).alias("passed"))


def valid_range(start: Column, end: Column, most: int = 60) -> Column:
    """Whether both are periods, in order, and span `most` months at most."""
    shape = r"^\d{4}-(0[1-9]|1[0-2])$"
    return F.coalesce(start.rlike(shape) & end.rlike(shape) & (start <= end) & (F.when(start.rlike(shape) & end.rlike(shape), periods_between(start, end)) < most), F.lit(False))


def range_presets(first: Column, latest: Column) -> Column:
    """name -> (from, to): the latest period, the last 3 and 6, the financial year so far, all; from the first on."""
    year = F.when(F.substring(latest, 6, 2) >= "04", F.substring(latest, 1, 4)).otherwise((F.substring(latest, 1, 4).cast("int") - 1).cast("string"))
    starts = {"latest": latest, "last_3": shift_period(latest, -2), "last_6": shift_period(latest, -5), "financial_year": F.concat(year, F.lit("-04")), "all": first}
    return F.create_map(*(x for n, s in starts.items() for x in (F.lit(n), F.struct(F.greatest(s, first).alias("start"), latest.alias("end")))))
