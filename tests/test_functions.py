import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text


def values(spark, f, raws, type_="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_document_numbers(spark):
    cases = {"INV/2026-27/0042": "42", "inv-0042": "42", "4921-01": "492101", "CN/26-27/7": "CN7", "": "", "000": "000", "INV": "INV", "PUR/INV/77": "77", "FY 2026-2027/A9": "A9", "INV202627-0815": "815"}
    assert values(spark, text.norm_invoice_no, [*cases, None]) == [*cases.values(), ""]


def test_party_names(spark):
    cases = {"M/s. Prince Traders": "PRINCE", "Acme Pvt. Ltd": "ACMEPVT", "ACME PVT LTD": "ACME", "Sons & Co": "SONS", "Ltd": "LTD", "Alpha  and Sons India": "ALPHA"}
    assert values(spark, text.norm_party, [*cases]) == list(cases.values())


def test_tax_id(spark):
    assert values(spark, text.is_valid_gstin, ["27AAPFU0939F1ZV", "27aapfu0939f1zv", "27AAPFU0939F1ZA", "", None, "short"]) == [True, True, False, False, False, False]
    assert values(spark, text.pan_of, ["27AAPFU0939F1ZV"]) == ["AAPFU0939F"]


def test_amounts(spark):
    got = values(spark, money.parse_amount, ["", None, "1,23,456.785", "(45.5)", "₹ 10 Dr", "-3", "abc", "7 cr."])
    assert got == [Decimal(x) if x else None for x in ("0.00", "0.00", "123456.79", "-45.50", "10.00", "-3.00", None, "7.00")]
    assert values(spark, money.format_inr, [123456789, -5, 99900, 100000000], "long") == ["12,34,567.89", "-0.05", "999.00", "10,00,000.00"]


def test_dates(spark):
    d = datetime.date
    cases = {"2026-08-05": d(2026, 8, 5), "05-08-2026": d(2026, 8, 5), "5/8/2026": d(2026, 8, 5), "05-Aug-2026": d(2026, 8, 5), "5 august 2026": d(2026, 8, 5), "Aug 5, 2026": d(2026, 8, 5), "20260805": d(2026, 8, 5), "05-08-26": d(2026, 8, 5), "05-Aug-99": d(1999, 8, 5), "x": None, "": None}
    assert values(spark, dates.parse_date, [*cases]) == list(cases.values())
    assert values(spark, lambda c: dates.shift_period(c, -1), ["2026-01"]) == ["2025-12"]
    assert values(spark, lambda c: dates.months_between(c, F.lit("2026-02")), ["2025-11", "2026-03"]) == [["2025-11", "2025-12", "2026-01", "2026-02"], []]
    assert values(spark, dates.credit_deadline, [d(2026, 3, 31), d(2026, 4, 1)], "date") == [d(2026, 11, 30), d(2027, 11, 30)]


def test_ratio_against_brute_force(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(1)
    words = ["".join(rng.choice("ABC1") for _ in range(rng.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", text.indel_ratio("a", "b").alias("x")).collect():
        n = len(r.a) + len(r.b)
        assert r.x == pytest.approx(200 * lcs(r.a, r.b) / n if n else 100)


def test_guard_and_search(spark):
    assert values(spark, text.numbers_in, ["Section 16(4) and GSTR-2B: 2,59,012.40 of 3"]) == [[Decimal("259012.40"), Decimal("3.00")]]
    assert values(spark, lambda c: text.subsequence_score(F.lit("rg"), c), ["ring", "rg", "go", ""]) == [2, 3, 0, 0]


def test_differences_keep_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc1", k=rng.randint(0, 14))) for _ in range(2))
        d = text.char_diff(a, b)
        assert "".join(t for op, t in d if op != "add") == a and "".join(t for op, t in d if op != "remove") == b
        assert sum(len(t) for op, t in d if op == "keep") == text.lcs_length(a, b)
        assert all(x[0] != y[0] for x, y in zip(d, d[1:], strict=False))
    long = "".join(rng.choices("ab", k=1500))
    assert sum(len(t) for op, t in text.char_diff(long, long[5:] + "x" * 5) if op == "keep") >= 1495
    with pytest.raises(ValueError, match="characters"):
        text.char_diff("a" * 10_001, "")
