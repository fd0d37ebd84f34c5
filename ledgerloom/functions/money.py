"""Amounts: parsing, rounding as each site needs it, whole paise, grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"


def parse_amount(raw: Column) -> Column:
    """Blank is 0.00, brackets are negative, a trailing DR or CR is dropped; null where it is no number."""
    x = F.trim(F.coalesce(raw, F.lit("")))
    inner = F.regexp_extract(x, r"^\((.*)\)$", 1)
    x = F.when(x.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), inner)).otherwise(x)
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)\s*(DR|CR)\.?$", ""), r"[₹$,\s]", "")
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.lit(0)).otherwise(F.round(x.try_cast("decimal(25,6)"), 2)).cast(MONEY)


def optional_amount(raw: Column) -> Column:
    """Null for blank; a zero stays zero."""
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) != "", parse_amount(raw))


def signed_amount(raw: Column) -> tuple[Column, Column]:
    """(debit, credit) of one column with a CR or DR ending, else by its sign (negative is out)."""
    x, text = parse_amount(raw), F.upper(F.trim(raw))
    credit = F.when(text.rlike(r"CR\.?$"), True).when(text.rlike(r"DR\.?$"), False).otherwise(x >= 0)
    return F.when(~credit, F.abs(x)), F.when(credit, F.abs(x))


def to_paise(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def paise_of_double(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("bigint")


def percent(part: Column, whole: Column, places: int) -> Column:
    """100 part / whole, half to even; 0 where whole is 0."""
    exact = part.cast("decimal(25,0)") * 100 / F.nullif(whole.cast("decimal(25,0)"), F.lit(0))
    return F.coalesce(F.bround(exact, places), F.lit(0)).cast(f"decimal(9,{places})")


def half_even(n: Column, d: Column) -> Column:
    """n / d of whole numbers, not negative, to the nearest whole number, halves to the even one."""
    rest = n % d
    low = F.round((n - rest) / d).cast("bigint")
    return (low + F.when((2 * rest > d) | ((2 * rest == d) & (low % 2 == 1)), 1).otherwise(0)).cast("int")


def format_inr(paise: Column) -> Column:
    """Rupees with two decimals, grouped by lakh and crore."""
    whole = (F.abs(paise) / 100).cast("decimal(25,2)").cast("string")
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.regexp_replace(whole, r"\B(?=(\d{2})*\d{3}\.)", ","))
