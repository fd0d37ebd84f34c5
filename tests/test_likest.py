"""The search by bounds against all pairs, and how many pairs it rates."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions.text import lcs_length
from ledgerloom.operators import likest, matching


def all_pairs(text, others, ranks, floor):
    rated = sorted((-200.0 * lcs_length(text, o) / max(len(text) + len(o), 1), o) for o in others)
    return [(-r, o) for r, o in rated if -r >= floor][:ranks]


def test_equals_all_pairs():
    rng = random.Random(1)
    for alphabet, longest in (("01", 9), ("ABC123", 14), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789é漢", 20)):
        others = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, longest))) for _ in range(300)})
        block = likest.Block(others)
        for _ in range(150):
            text = "".join(rng.choices(alphabet, k=rng.randint(1, longest)))
            for floor in (0, 60, 90):
                assert block.likest(text, 3, floor) == all_pairs(text, others, 3, floor)


def numbers(rng, n):
    return sorted({f"INV{rng.randrange(10**7):07}{rng.choice('ABCDEFGH')}" for _ in range(n)})


def test_few_pairs_of_a_large_block_are_rated():
    rng = random.Random(2)
    block = likest.Block(numbers(rng, 20_000))
    asked = [t[:-1] + "X" for t in rng.sample(block.texts, 60)] + numbers(rng, 40)
    for text in asked:
        got = block.likest(text, 3, 60)
        assert len(got) == 3
    assert block.rated < len(asked) * len(block.texts) / 10
    for text in asked[:4] + asked[-3:]:
        assert block.likest(text, 3, 60) == all_pairs(text, block.texts, 3, 60)


def test_searched_blocks_equal_joined_ones(spark):
    """Blocks cut into several tasks of lefts and rights."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        rows.append((i, rng.choice([1, 2]), "2026-01", rng.choice(["G", "H"]), f"A{rng.randrange(3000):04}", 100, 0, 0, 0, 0))
    frame = spark.createDataFrame(rows, "id long, company_id int, period string, supplier_gstin string, norm_invoice_no string, taxable long, cgst long, sgst long, igst long, cess long").withColumn("invoice_date", F.lit("2026-01-01").cast("date"))
    left, right = frame.where("id % 2 = 0"), frame.where("id % 2 = 1")
    joined = sorted(map(str, matching.fuzzy_pairs(left, right).collect()))
    before, likest.LEFTS, likest.RIGHTS = (likest.LEFTS, likest.RIGHTS), 17, 13
    try:
        assert sorted(map(str, matching.fuzzy_pairs(left, right, 10).collect())) == joined
    finally:
        likest.LEFTS, likest.RIGHTS = before
    assert len(joined) > 200
