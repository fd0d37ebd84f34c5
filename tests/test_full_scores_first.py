"""Rows that pairs of full score decide aren't compared by likeness, and the choice is as among all pairs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching

ROW = "id long, company_id int, period string, supplier_gstin string, norm_invoice_no string, invoice_date date, taxable long, cgst long, sgst long, igst long, cess long"


def rows(rng, n, long):
    """Rows of few suppliers and numbers, so many are booked twice, stated twice or off by a letter, an amount or a day."""
    out = []
    for i in range(n):
        number = f"A{rng.randrange(1, 40):04}" + rng.choice(["", "", "", "X"])
        number = rng.choice([number, number.ljust(900, "7")]) if long else number
        day = datetime.date(2026, 1, 5) + datetime.timedelta(days=rng.choice([0, 0, 0, 1]))
        out.append((i, rng.randrange(2), "2026-01", rng.choice(["G1", "G2", "", None]), number, day, 100_000 + rng.choice([0, 0, 0, 700]), 90, 90, 0, 0))
    return out


@pytest.mark.parametrize("long", [False, True])
def test_the_choice_is_that_among_all_pairs(spark, monkeypatch, long):
    rng = random.Random(11)
    books = spark.createDataFrame(rows(rng, 120, long), ROW)
    portal = spark.createDataFrame([(*r, rng.choice(["B2B", "B2BA"]), None) for r in rows(rng, 120, long)], ROW + ", section string, amends_invoice_no string")
    pairs = matching.number_pairs(books, portal).unionByName(matching.fuzzy_pairs(books, portal)).where(F.col("score") >= matching.SCORE_FLOOR)
    want = matching.one_to_one(pairs, "l_id", "r_id", [F.desc("score")], ["company_id", "l_supplier_gstin"])
    compared, fuzzy = [], matching.fuzzy_pairs
    monkeypatch.setattr(matching, "fuzzy_pairs", lambda left, *rest, **more: compared.append(left.count()) or fuzzy(left, *rest, **more))
    got = matching.reconcile(books, portal)
    assert sorted(map(str, got.collect())) == sorted(map(str, matching.decisions(books, portal, want).collect()))
    full = want.where(f"score = 1 and length(l_norm_invoice_no) <= {matching.LONGEST}").count()
    assert full and compared == [120 - full]
