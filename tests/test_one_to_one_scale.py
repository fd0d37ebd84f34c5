"""The one-to-one choice on chains, ties and blocks over the bound, against the loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import likest, matching


def loop(pairs):
    left, right, out = set(), set(), []
    for b, l, r, s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if l not in left and r not in right:
            left.add(l), right.add(r), out.append((b, l, r, s))
    return sorted(out)


def chosen(spark, pairs, **more):
    frame = spark.createDataFrame(pairs, "b string, l long, r long, s int")
    return sorted(map(tuple, matching.one_to_one(frame, "l", "r", [F.desc("s")], ["b"], **more).collect()))


def chain(n, block="c", at=0):
    return [(block, at + i // 2 + i % 2, at + i // 2, n - i) for i in range(2 * n - 1)]


@pytest.mark.parametrize("pairs", [chain(1000), [("t", a, b, 5) for a in range(200) for b in range(200)]], ids=["chain of 1000", "200 x 200 ties"])
def test_chains_and_ties_in_seconds(spark, pairs):
    start = time.perf_counter()
    assert chosen(spark, pairs) == loop(pairs)
    assert time.perf_counter() - start < 20


def test_blocks_over_the_bound_are_split(spark):
    rng = random.Random(1)
    pairs = list({(f"b{k}", 1000 * k + rng.randrange(60), 1000 * k + rng.randrange(60), rng.randrange(9)) for k in range(4) for _ in range(150)})
    pairs = list({p[:3]: p for p in pairs}.values()) + chain(40, "b9", 90_000)
    assert chosen(spark, pairs, most=100) == loop(pairs) == chosen(spark, pairs)


def test_repeated_pairs_count_once(spark):
    pairs = [("x", 1, 1, 3)] * 3 + [("x", 1, 2, 2), ("x", 2, 1, 2), ("x", 2, 2, 1)]
    assert chosen(spark, pairs) == loop(pairs)


def test_connected_parts(spark):
    frame = spark.createDataFrame([("b", l, r, 1) for l, r in [(5, 1), (4, 1), (4, 2), (3, 2), (9, 7), (8, 7), (11, 12)]], "b string, l long, r long, s int")
    assert {r.l: r.part for r in matching.connected(frame, "l", "r").collect()} == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 11: 11}


def test_a_hot_suppliers_numbers_are_dealt(spark, monkeypatch):
    """Fuzzy pairs don't depend on how many tasks a supplier's numbers are dealt over."""
    from ledgerloom.plans import adapters

    v = adapters.views(spark, "/root/testdata/sf0.001")
    one = lambda df: df.withColumn("supplier_gstin", F.lit("G1")).withColumn("company_id", F.lit(1)).limit(60)
    books, portal = one(v["books"].orderBy("id")), one(v["portal"].orderBy("id"))
    pairs = lambda *most: sorted(map(tuple, matching.fuzzy_pairs(books, portal, *most).select("l_id", "r_id", "score").collect()))
    whole = pairs()
    monkeypatch.setattr(likest, "LEFTS", 7)
    monkeypatch.setattr(likest, "RIGHTS", 11)
    assert whole and pairs(0) == whole  # searched, a task for each few numbers


def test_a_null_block_is_a_block(spark):
    """Blocks with a null stay apart from others, below the bound and above it."""
    pairs = [(None, 1, 1, 3), (None, 1, 2, 4), (None, 2, 1, 1), ("b", 11, 11, 2), ("b", 11, 12, 1)]
    want = {(None, 1, 2, 4), (None, 2, 1, 1), ("b", 11, 11, 2)}
    for most in (10, 2):
        frame = spark.createDataFrame(pairs, "b string, l long, r long, s int")
        assert {tuple(r) for r in matching.one_to_one(frame, "l", "r", [F.desc("s")], ["b"], most=most).collect()} == want
